"""Exact quantiles that never hold a group in one task.

The built-in exact ``percentile`` keeps one map of all values of a group in memory, which a hot
group with a third of a very large table would break. Here passes over the rows narrow it down:

1. an approximate sketch per group gives, for every wanted quantile, two values that enclose it;
2. rows inside such a bracket are counted by value, all rows between brackets collapse into one
   count per gap. Both happen in the map-side partial aggregation, so the shuffle carries only
   bracket rows (about ``8 / accuracy`` of the data per quantile);
3. if a wanted rank lies in a gap after all, a sketch of that gap alone gives the next bracket, and
   step 2 runs again for the groups concerned. Every turn leaves a small part of the gap, so this
   ends, and the result is exact whatever the first sketch said.

Exact ranks come from a two-level prefix sum: first over slices of the brackets, then inside the slices
that hold a wanted rank. Slices are cut at quantiles of a sketch over the distinct values of a bracket, so
they are of even size however the values are spread.

``wide_quantiles`` does the same for several columns of one table without turning them into rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.functions.numeric import to_number
from emberfield.session import materialize

ACCURACY = 10_000
SLICES = 256
#: Parts of a gap that its sketch tells apart.
GAP_PARTS = 64
MOST_TURNS = 40


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: dict[str, float | tuple[float, str]],
    by: Sequence[str] = (),
    rule: str = "linear",
    extra: Sequence[Column] = (),
    few_values: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with the columns ``by``, ``n``, one per quantile, and ``extra``.

    ``rule="linear"`` interpolates at ``q * (n - 1)``; ``rule="nearest"`` takes the element with
    that rank rounded half up; a pair ``(q, rule)`` sets it for one quantile. ``n`` counts usable values (nulls and NaN are left out; a null group
    key is a group). ``extra`` are aliased aggregates computed over all rows in the first pass.
    ``few_values=True`` is for measures whose number of distinct values is bounded by their
    domain (whole minutes of a bounded range, small counts): the sketch is then skipped.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    src = df.withColumn("_v", to_number(value))
    margin = 4.0 / accuracy
    wanted = {name: q if isinstance(q, tuple) else (q, rule) for name, q in probs.items()}
    cuts = [F.lit(min(1.0, max(0.0, q + side * margin))) for q, _ in wanted.values() for side in (-1, 1)]
    first = [F.count("_v").alias("n"), *extra]
    if not few_values:
        first.append(F.percentile_approx("_v", F.array(*cuts), accuracy).alias("_cut"))
    summary = materialize(src.groupBy(*by).agg(*first), "quantile-summary")
    picked = _narrow(src.where(F.col("_v").isNotNull()), summary, by, wanted, few_values)

    extras = [c for c in summary.columns if c not in (*by, "n", "_cut")]
    if not by:
        found = picked.select(F.struct(*probs).alias("q")).scalar()
        return summary.select("n", *[found[name].alias(name) for name in probs], *extras)
    right = picked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *probs)
    return (summary.join(right, _same_keys(summary, right, by), "left")
            .select(*by, "n", *probs, *extras))


def _narrow(rows: DataFrame, cuts: DataFrame, by: Sequence[str], wanted: dict[str, tuple[float, str]],
            few_values: bool = False) -> DataFrame:
    """(by, one column per quantile): counts inside the brackets of ``cuts``, with new brackets where one missed."""
    found = None
    for _ in range(MOST_TURNS):
        cut = rows if few_values else _with_cuts(rows, cuts, by)
        cells = materialize(_cells(cut, by, len(wanted), few_values), "quantile-cells")
        picked = _pick(cells, by, wanted)
        if few_values:
            return picked.select(*by, *wanted)
        picked = materialize(picked, "quantile-picked")
        missed = picked.where(reduce(lambda a, b: a | b, [F.col(f"_m_{name}").isNotNull() for name in wanted]))
        settled = picked.where(reduce(lambda a, b: a & b, [F.col(f"_m_{name}").isNull() for name in wanted])).select(*by, *wanted)
        found = settled if found is None else found.union(settled)
        if missed.isEmpty():
            return found
        cuts = materialize(_next_cuts(rows, cuts, missed, by, wanted), "quantile-cuts")
    raise RuntimeError("quantile brackets did not settle")


def _next_cuts(rows: DataFrame, cuts: DataFrame, missed: DataFrame, by: Sequence[str],
               wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(by, _cut) for groups with a missed rank: the part of the gap around it by a sketch of the gap."""
    gaps = [f"_m_{name}" for name in wanted]
    v, fractions = F.col("_v"), F.array(*[F.lit(i / GAP_PARTS) for i in range(GAP_PARTS + 1)])

    def part(i: int, held: Column, old: Column) -> list[Column]:
        """Bracket of quantile ``i`` from the gap ``held``, or the old one where it did not miss."""
        grid = F.percentile_approx(F.when(v.between(held[gaps[i]]["lo"], held[gaps[i]]["hi"]), v), fractions, 10 * GAP_PARTS)
        return [grid.alias(f"_g{i}"), F.first(held[gaps[i]]).alias(gaps[i]), F.first(old).alias("_old")]

    if by:
        left = missed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.struct(*gaps).alias("_held"))
        held = rows.join(left, _same_keys(rows, left, by), "inner").select(*by, "_v", "_held")
        held = _with_cuts(held, cuts, by, "_held")
        sketched = held.groupBy(*by).agg(*_distinct(part, len(gaps), F.col("_held"), F.col("_cut")))
    else:
        one = missed.select(F.struct(*gaps).alias("h")).scalar()
        held = rows.select("_v", one.alias("_held"), cuts.select("_cut").scalar().alias("_cut"))
        sketched = held.agg(*_distinct(part, len(gaps), F.col("_held"), F.col("_cut")))
    ends = []
    for i, gap in enumerate(gaps):
        at = F.floor(F.col(gap)["part"] * GAP_PARTS).cast("int")
        low = F.get(f"_g{i}", F.greatest(at - 2, F.lit(0)))
        high = F.get(f"_g{i}", F.least(at + 3, F.lit(GAP_PARTS)))
        # The ends of the gap are known exactly; a sketch may stay short of them.
        low = F.when(at <= 2, F.col(gap)["lo"]).otherwise(low)
        high = F.when(at >= GAP_PARTS - 3, F.col(gap)["hi"]).otherwise(high)
        ends += [F.coalesce(low, F.col("_old")[2 * i]), F.coalesce(high, F.col("_old")[2 * i + 1])]
    return sketched.select(*by, F.array(*ends).alias("_cut"))


def _distinct(part, n: int, held: Column, old: Column) -> list[Column]:
    """The aggregates of all quantiles; the old brackets only once."""
    columns = [part(i, held, old) for i in range(n)]
    return [c for p in columns for c in p[:2]] + [columns[0][2]]


def _same_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    same = [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(by)]
    return reduce(lambda a, b: a & b, same)


def _with_cuts(rows: DataFrame, summary: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    if not by:
        return rows.withColumn("_cut", summary.select("_cut").scalar())
    right = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_cut")
    return rows.join(right, _same_keys(rows, right, by), "inner").select(*by, "_v", "_cut", *more)


def _cells(rows: DataFrame, by: Sequence[str], n_probs: int, few_values: bool) -> DataFrame:
    """Counts per value inside a bracket and per gap outside; ``_cell`` grows with the value."""
    v = F.col("_v")
    if few_values:
        cell, kept = F.lit(0), v
    else:
        cell, kept = F.lit(0), F.lit(None).cast("double")
        for i in range(n_probs):
            low, high = F.col("_cut")[2 * i], F.col("_cut")[2 * i + 1]
            cell = cell + (v >= low).cast("int") + (v > high).cast("int")
            kept = F.when(v.between(low, high), v).otherwise(kept)
    keyed = rows.select(*by, v, cell.alias("_cell"), kept.alias("_kept"))
    return keyed.groupBy(*by, "_cell", "_kept").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _sliced(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with ``_piece``: even slices of the distinct values of each bracket, growing with the value."""
    fractions = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    edges = cells.where(F.col("_kept").isNotNull()).groupBy(*keys).agg(
        F.percentile_approx("_kept", fractions, 4 * SLICES).alias("_edges"))
    edges = edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_edges")
    piece = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("_kept"))), F.lit(0))
    return cells.join(edges, _same_keys(cells, edges, keys), "left").select(*cells.columns, piece.alias("_piece"))


def _targets(wanted: dict[str, tuple[float, str]], total: Column) -> dict[str, tuple]:
    """Per quantile the two ranks it lies between and the position between them."""
    out = {}
    for name, (q, rule) in wanted.items():
        h = F.lit(float(q)) * (total - 1)
        if rule == "nearest":
            k = F.floor(h + 0.5)
            out[name] = (k, k, F.lit(0.0))
        elif rule == "linear":
            out[name] = (F.floor(h), F.ceil(h), h - F.floor(h))
        else:
            raise ValueError(f"unknown quantile rule {rule!r}")
    return out


def _pick(cells: DataFrame, by: Sequence[str], wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(by, one column per quantile, and ``_m_<quantile>``: the gap its rank lies in, null if it was found)."""
    slice_keys = [*by, "_cell", "_piece"]
    cells = _sliced(cells, [*by, "_cell"])
    slices = cells.groupBy(*slice_keys).agg(F.sum("_c").alias("_size"))
    # One row per gap and slice: at most a few thousand per group, whatever the data size.
    ordered = Window.partitionBy(*by).orderBy("_cell", "_piece")
    slices = (slices
              .withColumn("_end", F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_total", F.sum("_size").over(Window.partitionBy(*by)))
              .withColumn("_start", F.col("_end") - F.col("_size")))
    targets = _targets(wanted, F.col("_total"))

    def holds(k: Column, start: str, end: str) -> Column:
        return (k >= F.col(start)) & (k < F.col(end))

    hit = reduce(lambda a, b: a | b,
                 [holds(k, "_start", "_end") for t in targets.values() for k in t[:2]])
    hits = slices.where(hit).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(slice_keys)], "_start", "_total")
    inside = Window.partitionBy(*slice_keys).orderBy("_kept")
    ranked = (cells.join(hits, _same_keys(cells, hits, slice_keys), "inner")
              .withColumn("_to", F.col("_start")
                          + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_from", F.col("_to") - F.col("_c")))

    def element(k: Column) -> Column:
        """Value with rank ``k``; a gap knows its first and last element only."""
        found = (F.when(F.col("_kept").isNotNull(), F.col("_kept"))
                 .when(k == F.col("_from"), F.col("_lo"))
                 .when(k == F.col("_to") - 1, F.col("_hi")))
        return F.max(F.when(holds(k, "_from", "_to"), found))

    def gap(k: Column) -> Column:
        """The gap that holds rank ``k`` in its inside: its ends and the part of its rows before the rank."""
        inside = F.col("_kept").isNull() & (k > F.col("_from")) & (k < F.col("_to") - 1)
        return F.max(F.when(inside, F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                                             ((k - F.col("_from")) / F.col("_c")).alias("part"))))

    parts = []
    for name, (k0, k1, part) in targets.items():
        parts += [element(k0).alias(f"_a_{name}"), element(k1).alias(f"_b_{name}"),
                  F.max(part).alias(f"_p_{name}"), F.coalesce(gap(k0), gap(k1)).alias(f"_m_{name}")]
    summed = ranked.groupBy(*by).agg(*parts)
    return summed.select(*by, *[
        (F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_p_{name}"))
        .alias(name) for name in wanted], *[f"_m_{name}" for name in wanted])


def wide_quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], rule: str = "linear",
    extra: Callable[[Column], list[Column]] = lambda v: [], accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per column with ``column``, ``n``, one value per quantile, and the aggregates ``extra(v)``.

    All columns share each pass: one row of sketches, one row of counts below every bracket with the values
    next to it, and one count of the values inside brackets, the only ones that become rows.
    """
    margin = 4.0 / accuracy
    wanted = {name: (q, rule) for name, q in probs.items()}
    src = df.select(*[to_number(F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns)])
    cuts = F.array(*[F.lit(min(1.0, max(0.0, q + side * margin))) for q in probs.values() for side in (-1, 1)])

    def one(i: int) -> Column:
        v = F.col(f"_v{i}")
        return F.struct(F.lit(columns[i]).alias("column"), F.count(v).alias("n"),
                        F.percentile_approx(v, cuts, accuracy).alias("_cut"), *extra(v)).alias(f"s{i}")

    row = src.agg(*[one(i) for i in range(len(columns))])
    summary = materialize(row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))), "column-sketches")
    # One row per column of the table: bounded by its schema.
    cut = {r["column"]: r["_cut"] for r in summary.select("column", "_cut").collect() if r["_cut"]}
    brackets = [(i, c, j, name, float(cut[c][2 * j]), float(cut[c][2 * j + 1]))
                for i, c in enumerate(columns) if c in cut for j, name in enumerate(probs)]
    extras = [c for c in summary.columns if c not in ("column", "n", "_cut")]
    if not brackets:
        return summary.select("column", "n", *[F.lit(None).cast("double").alias(name) for name in probs], *extras)

    def outside(i: int, low: float, high: float) -> list[Column]:
        v = F.col(f"_v{i}")
        return [F.count_if(v < low).alias("below"), F.max(F.when(v < low, v)).alias("before"), F.min(F.when(v > high, v)).alias("after")]

    counts = materialize(src.agg(*[F.struct(
        F.lit(c).alias("column"), F.lit(j).alias("_cell"), *outside(i, low, high)).alias(f"s{k}")
        for k, (i, c, j, _, low, high) in enumerate(brackets)]).select(
            F.inline(F.array(*[F.col(f"s{k}") for k in range(len(brackets))]))), "bracket-counts")
    hits = F.array(*[F.when(F.col(f"_v{i}").between(low, high), F.struct(
        F.lit(c).alias("column"), F.lit(j).alias("_cell"), F.col(f"_v{i}").alias("_kept"))) for i, c, j, _, low, high in brackets])
    # Most rows lie in no bracket and give no row here.
    values = src.select(F.inline(F.filter(hits, lambda x: x.isNotNull()))).groupBy("column", "_cell", "_kept").agg(
        F.count(F.lit(1)).alias("_c"))
    ranked = _wide_ranks(materialize(values, "bracket-values"), counts, summary, wanted)
    # A bracket that missed is narrowed for the columns concerned only.
    missed = [r["column"] for r in ranked.where("missed").select("column").distinct().collect()]
    found = ranked.where(~F.col("column").isin(missed)).groupBy("column").pivot("name", list(probs)).agg(F.first("value"))
    if missed:
        long = src.select(*[F.col(f"_v{columns.index(c)}").alias(c) for c in missed]).unpivot([], missed, "column", "_v")
        again = _narrow(long.where(F.col("_v").isNotNull()), summary.where(F.col("column").isin(missed)), ["column"], wanted)
        found = found.unionByName(again.select("column", *probs))
    return summary.join(found, "column", "left").select("column", "n", *probs, *extras)


def _wide_ranks(values: DataFrame, counts: DataFrame, summary: DataFrame, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(column, name, value, missed) per bracket, from the values inside it and the counts below it."""
    sliced = _sliced(values, ["column", "_cell"])
    sizes = sliced.groupBy("column", "_cell", "_piece").agg(F.sum("_c").alias("_size"))
    ordered = Window.partitionBy("column", "_cell").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.withColumn("_end", F.sum("_size").over(ordered)).join(counts.select("column", "_cell", "below"), ["column", "_cell"])
    starts = starts.withColumn("_start", F.col("below") + F.col("_end") - F.col("_size"))
    # The two ranks that each quantile lies between.
    targets = summary.select("column", F.inline(F.array(*[F.struct(
        F.lit(j).alias("_cell"), F.lit(name).alias("name"), k0.alias("k0"), k1.alias("k1"), part.cast("double").alias("part"))
        for j, (name, (k0, k1, part)) in enumerate(_targets(wanted, F.col("n")).items())])))
    held = starts.join(targets, ["column", "_cell"]).where(
        "k0 >= _start and k0 < _start + _size or k1 >= _start and k1 < _start + _size").select(
        "column", "_cell", "_piece", "_start", "k0", "k1")
    inside = Window.partitionBy("column", "_cell", "_piece").orderBy("_kept").rowsBetween(Window.unboundedPreceding, 0)
    at = sliced.join(held, ["column", "_cell", "_piece"]).withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
    at = at.withColumn("_from", F.col("_to") - F.col("_c"))
    elements = at.groupBy("column", "_cell").agg(*[
        F.max(F.when((F.col(k) >= F.col("_from")) & (F.col(k) < F.col("_to")), F.col("_kept"))).alias(f"v{k}") for k in ("k0", "k1")])
    whole = counts.join(sizes.groupBy("column", "_cell").agg(F.sum("_size").alias("_inside")), ["column", "_cell"], "left")
    joined = targets.join(whole, ["column", "_cell"]).join(elements, ["column", "_cell"], "left")
    above = F.col("below") + F.coalesce("_inside", F.lit(0))

    def element(k: str) -> Column:
        return F.coalesce(f"v{k}", F.when(F.col(k) == F.col("below") - 1, F.col("before")).when(F.col(k) == above, F.col("after")))

    value = element("k0") + (element("k1") - element("k0")) * F.col("part")
    return materialize(joined.select("column", "name", value.alias("value"), value.isNull().alias("missed")), "bracket-ranks")


def quantiles_of_counts(
    counts: DataFrame, value: str, n: str, probs: dict[str, float | tuple[float, str]], by: Sequence[str],
    rule: str = "linear",
) -> DataFrame:
    """One row per group with ``by``, ``n`` and the quantiles, from a table that has each value of a group once."""
    wanted = {name: q if isinstance(q, tuple) else (q, rule) for name, q in probs.items()}
    v = F.col(value)
    cells = counts.select(*by, F.lit(0).alias("_cell"), v.alias("_kept"), F.col(n).alias("_c"), v.alias("_lo"), v.alias("_hi"))
    picked = _pick(cells, by, wanted)
    right = picked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *wanted)
    totals = counts.groupBy(*by).agg(F.sum(n).alias("n"))
    return totals.join(right, _same_keys(totals, right, by), "left").select(*by, "n", *wanted)
