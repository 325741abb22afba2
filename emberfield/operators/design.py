"""Model inputs: standardised columns, dummies, quartile groups, strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.functions.numeric import code_bin
from emberfield.functions.text import leading_code
from emberfield.operators.quantiles import exact_quantiles


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add (x - mean) / sample standard deviation; null where the column does not vary.

    The statistics are one scalar subquery, evaluated once for all columns.
    """
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns
    ]).alias("stats")).scalar()
    return df.withColumns({
        c + suffix: F.try_divide(F.col(c) - stats[c]["m"], stats[c]["s"]) for c in columns})


def one_hot(
    df: DataFrame, column: str, levels: Sequence[str] | None = None,
    prefix: str | None = None, drop_first: bool = True,
) -> DataFrame:
    """Add one 0/1 double per level. Observed levels are sorted; a fixed list keeps its order.

    The level list becomes the column list of the plan; for a column of any cardinality use
    :func:`~emberfield.operators.levels.one_hot_sparse`.
    """
    if levels is None:
        levels = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect())
    kept = list(levels)[1:] if drop_first else list(levels)
    name = prefix or column
    return df.withColumns({
        f"{name}_{level}": F.coalesce(F.col(column) == level, F.lit(False)).cast("double")
        for level in kept})


def design_matrix(
    df: DataFrame, standardised: Sequence[str], controls: Sequence[str] = (),
    category: str | None = None, levels: Sequence[str] | None = None, prefix: str = "cat",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` plus constant, standardised columns, controls and category dummies as columns.

    For inspection or other estimators; :func:`~emberfield.operators.regression.fit_ols` works on
    the plain columns and never builds the dummies.
    """
    out = zscore(df, standardised)
    out = out.withColumns({"const": F.lit(1.0), **{c: F.col(c + "_z") for c in standardised}})
    names = [*keep, "const", *standardised, *controls]
    if category:
        before = set(out.columns)
        out = one_hot(out, category, levels, prefix)
        names += [c for c in out.columns if c not in before]
    return out.select(*names)


def exclusive_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) > low) & (F.col(column) < high))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def stratum(df: DataFrame, code: str, bounds: tuple[int, int]) -> DataFrame:
    return df.where(F.col(code).between(*bounds))


def model_input(
    df: DataFrame,
    situation: str = "primary_situation",
    response: str = "response_time_min",
    required: Sequence[str] = (*K.SOCIO_COLUMNS, *K.CONTROL_COLUMNS),
    bounds: tuple[float, float] = (0.0, 60.0),
) -> DataFrame:
    """Rows inside the open response range, with code and code bin, complete in all columns used."""
    # Plain columns are filtered first, before any code is cut out of text.
    usable = complete_cases(exclusive_range(df, response, *bounds), [*required, response])
    coded = (usable.withColumn("incident_code", leading_code(F.col(situation)))
             .withColumn("incident_category", code_bin(F.col("incident_code"))))
    return complete_cases(coded, ["incident_category"])


def model_input_counts(df: DataFrame, response: str = "response_time_min",
                       bounds: tuple[float, float] = (0.0, 60.0)) -> DataFrame:
    """Rows before the range filter, kept and removed, in one pass."""
    kept = F.count_if((F.col(response) > bounds[0]) & (F.col(response) < bounds[1]))
    total = F.count(F.lit(1))
    return df.agg(total.alias("rows"), kept.alias("kept"), (total - kept).alias("removed"))


def with_quartile(df: DataFrame, column: str, out: str = "quartile") -> DataFrame:
    """Add q1..q4 by the linear quartiles of the column: right-closed, the minimum in q1.

    Ties stay together, so groups may differ in size; equal edges leave a group empty. The three
    edges are computed here and enter the plan as literals, so later passes do not repeat them.
    """
    e = exact_quantiles(df, column, {"e1": 0.25, "e2": 0.5, "e3": 0.75}).first()
    c = F.col(column)
    return df.withColumn(out, F.when(c <= F.lit(e["e1"]), "q1").when(c <= F.lit(e["e2"]), "q2")
                         .when(c <= F.lit(e["e3"]), "q3").when(c.isNotNull(), "q4"))


def quartile_profile(df: DataFrame, column: str, measure: str) -> DataFrame:
    """Mean, median and count of a measure per quartile group of another column."""
    grouped = with_quartile(df.select(column, measure), column).where(F.col("quartile").isNotNull())
    return exact_quantiles(
        grouped, measure, {"median": 0.5}, by=["quartile"], extra=[F.avg(measure).alias("mean")])


def sample_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, median, mean, standard deviation, min and max of a column."""
    return exact_quantiles(df, column, {"median": 0.5}, by=by, extra=[
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max")])
