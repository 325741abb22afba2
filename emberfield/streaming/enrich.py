"""Enrichment of arriving incidents against static roll-ups.

Preparing, nearest-snapshot attachment, static attachment and rates keep no state, so the batch
operators run on a streaming DataFrame as they are: stream-static joins, no watermark needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from emberfield import constants as K
from emberfield.operators.nearest import attach_snapshot
from emberfield.plans.incidents import feature_table, prepare_incidents


def enrich(
    incidents: DataFrame, census: DataFrame, static: Sequence[DataFrame] = (),
    years: Sequence[int] = tuple(K.SNAPSHOT_YEARS),
) -> DataFrame:
    """Features of batch or streaming incidents from ready roll-up tables."""
    facts = attach_snapshot(prepare_incidents(incidents), census, years, ["neighborhood"])
    facts = facts.withColumnRenamed("snapshot_year", "acs_year")
    for table in static:
        facts = facts.join(table, "neighborhood", "left")
    return feature_table(facts)


def write_features(features: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append the files that are new since the last call to a parquet table and stop.

    Progress is kept beside the table unless ``checkpoint`` names another place. It must belong to the
    table: the table's own log skips batch numbers it has seen, so fresh progress would lose rows.
    """
    place = checkpoint or f"{path.rstrip('/')}/_progress"
    return (features.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", place).outputMode("append")
            .trigger(availableNow=True).start())
