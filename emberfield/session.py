"""Session helpers: settings, the shared work folder and materialised intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: Without it shuffle files stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "emberfield", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join handling on.

    Shuffle partition count and memory are left to the deployment; pass them through ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a local-mode session uses its warehouse; for a cluster session it is an error,
    since executors may not share any other folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.conf.get("spark.master", "").startswith("local"):
        named = spark.conf.get("spark.sql.warehouse.dir") + "/work"
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    return f"{work_dir(spark)}/emberfield/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and it gives Catalyst the real
    size: a later join broadcasts the table only if its files are below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles with adaptive skew handling.
    The shuffle files of the write are deleted with its end, as nothing can read them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    cleanup = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, cleanup)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def materialize_observed(df: DataFrame, metrics: Sequence[Column], keep: Sequence[str], name: str = "table") -> tuple[DataFrame, dict]:
    """Write the columns ``keep`` of ``df`` and return them with ``metrics``, aggregates of the same pass over all rows."""
    watch = Observation()
    table = materialize(df.observe(watch, *metrics).select(*keep), name)
    return table, watch.get


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
