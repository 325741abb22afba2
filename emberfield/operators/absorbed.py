"""Linear regression with a categorical effect of any number of levels.

The intercepts of the levels are eliminated inside Spark. Centred at the mean of its level, a column
is orthogonal to every dummy, so the normal equations fall apart into one number per level and a
k x k matrix, the sum of the centred products of all levels. Rows meet their level's means in a join
on (stratum, level); the table of levels stays distributed, and only k x k sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.operators.regression import (
    CONST, FULL_LEVERAGE, Fit, pairs, product_sums, symmetric)
from emberfield.session import materialize


@dataclass
class AbsorbedFit(Fit):
    """Constant and columns of a fit. The constant is that of the first level, as with dummies."""

    wald: float = float("nan")
    restrictions: int = 0

    @property
    def fvalue(self) -> float:
        return self.wald / self.restrictions if self.restrictions else float("nan")

    def _slopes(self):
        # Only the number of restrictions is asked for; the matrix over all levels is never built.
        return np.empty(0), np.empty((0, 0)), self.restrictions


@dataclass
class Absorbed:
    """Fits by stratum (one small object each) and a distributed table of level intercepts."""

    fits: dict[str, AbsorbedFit]
    effects: DataFrame


def fit_absorbed(
    df: DataFrame, y: str, standardised: Sequence[str], controls: Sequence[str] = (), *,
    absorb: str, strata: str | None = None, cov: str = "HC3",
) -> Absorbed:
    """Fit ``y ~ 1 + z(standardised) + controls + dummies(absorb)`` per stratum, dummies absorbed.

    Coefficients, HC3 or classic errors, R2 and the Wald test over all slopes, dummies included, are
    those of the fit with a dummy per level. Incomplete rows are left out. A level with one row has
    leverage one: it takes no part in the errors and its dummy none in the test. ``effects`` holds
    stratum, level, rows and intercept. Without rows there are no fits.
    """
    if cov not in ("HC3", "classic"):
        raise ValueError(f"unknown covariance {cov}")
    spark = df.sparkSession
    names = [*standardised, *controls]
    k = len(names)
    src = df.select(
        (F.col(strata).cast("string") if strata else F.lit("all")).alias("_s"),
        F.col(absorb).cast("string").alias("_g"), F.col(y).cast("double").alias("_y"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)]).dropna()

    # Pass 1: location and spread per stratum, which also keep the sums of products small.
    scale = materialize(src.groupBy("_s").agg(F.avg("_y").alias("_my"), *[
        F.avg(f"_x{i}").alias(f"_m{i}") for i in range(k)], *[
        F.coalesce(F.nullif(F.stddev_samp(f"_x{i}"), F.lit(0.0)), F.lit(float("inf"))).alias(f"_d{i}")
        for i in range(len(standardised))]), "scale")
    spread = [F.col(f"_d{i}") if i < len(standardised) else F.lit(1.0) for i in range(k)]
    scaled = src.join(scale, "_s").select("_s", "_g", (F.col("_y") - F.col("_my")).alias("_y"), *[
        ((F.col(f"_x{i}") - F.col(f"_m{i}")) / spread[i]).alias(f"_x{i}") for i in range(k)])
    xs = [F.col(f"_x{i}") for i in range(k)]

    # Pass 2: means and centred products per level, added up over the levels of a stratum.
    sums = product_sums(scaled, ["_s", "_g"], [*xs, F.col("_y")])
    levels = materialize(sums, "levels")
    n = F.col("s0")
    first = F.min_by(F.struct(n.alias("n"), *[(F.col(f"s1_{i}") / n).alias(f"s1_{i}") for i in range(k + 1)]), "_g")
    totals = levels.groupBy("_s").agg(
        F.sum("rows").alias("rows"), F.sum("s0").alias("s0"), F.count(F.lit(1)).alias("levels"),
        *[F.sum(f"s1_{i}").alias(f"s1_{i}") for i in range(k + 1)],
        *[F.sum(f"s2_{i}_{j}").alias(f"s2_{i}_{j}") for i, j in pairs(k + 1)],
        *[F.sum(F.col(f"s2_{i}_{j}") - F.col(f"s1_{i}") * F.col(f"s1_{j}") / n).alias(f"c_{i}_{j}")
          for i, j in pairs(k + 1)],
        F.sum(F.col(f"s1_{k}") ** 2 / n).alias("between"), F.min("_g").alias("first"), first.alias("at_first"))
    solved = {}
    for r in totals.join(scale, "_s").collect():
        whole, within = symmetric(r, k + 1), symmetric(r, k + 1, "c")[1:, 1:]
        inverse, rank = _bounded_inverse(within[:k, :k], np.diag(whole)[1:k + 1])
        solved[r["_s"]] = dict(
            row=r, whole=whole, within=within, inverse=inverse, rank=rank, beta=inverse @ within[:k, k],
            mean=np.array([r["at_first"][f"s1_{i}"] for i in range(k + 1)]),
            shift=np.array([0.0 if i < len(standardised) else r[f"_m{i}"] for i in range(k)]))
    # Broadcast, or the join would send all rows of a stratum to one task.
    fitted = F.broadcast(spark.createDataFrame(
        [(s, f["beta"].tolist(), [float(f["inverse"][i, j]) * (1 if i == j else 2) for i, j in pairs(k)],
          float(f["row"]["_my"] - f["beta"] @ f["shift"]))
         for s, f in solved.items()], "_s string, _b array<double>, _h array<double>, _c double"))
    effects = levels.join(fitted, "_s").select(
        F.col("_s").alias("stratum"), F.col("_g").alias("level"), F.col("rows").alias("n"),
        (F.col(f"s1_{k}") / n - _dot("_b", [F.col(f"s1_{i}") / n for i in range(k)]) + F.col("_c")).alias("intercept"))

    meats = _meats(scaled, levels, fitted, k) if cov == "HC3" and solved else {}
    fits = {s: _fit(s, f, meats.get(s), names, k) for s, f in solved.items()}
    return Absorbed(fits, effects)


def _bounded_inverse(within: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse of the centred products; what is constant in every level has no product left."""
    unit = np.sqrt(np.where(size > 0, size, 1.0))
    inverse, rank = floored_inverse(within / np.outer(unit, unit))
    return inverse / np.outer(unit, unit), rank


def floored_inverse(m: np.ndarray, floor: float = 1e-11) -> tuple[np.ndarray, int]:
    """Pseudo-inverse of a matrix on unit scale: eigenvalues below ``floor`` count as zero."""
    values, vectors = np.linalg.eigh(m)
    live = values > floor
    return (vectors[:, live] / values[live]) @ vectors[:, live].T, int(live.sum())


def _dot(array: str, columns: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(columns):
        out = out + F.col(array)[i] * c
    return out


def _meats(scaled: DataFrame, levels: DataFrame, fitted: DataFrame, k: int) -> dict:
    """Pass 3: squared residuals over squared room, per level, then what the errors and the test need."""
    means = levels.select("_s", "_g", F.col("s0").alias("_n"), *[
        (F.col(f"s1_{i}") / F.col("s0")).alias(f"_m{i}") for i in range(k + 1)])
    centred = scaled.join(means, ["_s", "_g"]).join(fitted, "_s").select(
        "_s", "_g", "_n", "_b", "_h", (F.col("_y") - F.col(f"_m{k}")).alias("_y"),
        *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(k)])
    xs = [F.col(f"_x{i}") for i in range(k)]
    leverage = 1 / F.col("_n") + _dot("_h", [xs[i] * xs[j] for i, j in pairs(k)])
    resid = centred.select("_s", "_g", *xs, (F.col("_y") - _dot("_b", xs)).alias("_e"), (1 - leverage).alias("_room"))
    free = F.col("_room") > FULL_LEVERAGE
    weight = F.when(free, F.pow(F.col("_e") / F.col("_room"), F.lit(2)))
    parts = product_sums(resid, ["_s", "_g"], xs, weight, [
        F.sum(F.col("_e") * F.col("_e")).alias("ssr"), F.count_if(~free).alias("full")])
    by_level = parts.join(levels.select("_s", "_g", F.col("s0").alias("_n"), F.col(f"s1_{k}").alias("_sy")), ["_s", "_g"])
    # Only levels with a variance of their own: a, b are the level's share of both sides of the test.
    live, w = F.col("s0") > 0, F.col("s0")
    a, b = F.col("_sy"), F.col("_n")
    def over(c): return F.sum(F.when(live, c / w))
    first = F.min_by(F.struct("s0", *[f"s1_{i}" for i in range(k)]), "_g")
    rows = by_level.groupBy("_s").agg(
        F.sum("ssr").alias("ssr"), F.sum("full").alias("full"), F.count_if(live).alias("live"),
        over(a * a).alias("aa"), over(a * b).alias("ab"), over(b * b).alias("bb"),
        *[over(F.col(f"s1_{i}") * a).alias(f"a_{i}") for i in range(k)],
        *[over(F.col(f"s1_{i}") * b).alias(f"b_{i}") for i in range(k)],
        *[F.sum(f"s2_{i}_{j}").alias(f"m_{i}_{j}") for i, j in pairs(k)],
        *[over(F.col(f"s1_{i}") * F.col(f"s1_{j}")).alias(f"o_{i}_{j}") for i, j in pairs(k)],
        first.alias("at_first"))
    return {r["_s"]: r for r in rows.collect()}


def _fit(s: str, f: dict, meat, names: list[str], k: int) -> AbsorbedFit:
    r, inv, beta, within, mean = f["row"], f["inverse"], f["beta"], f["within"], f["mean"][:k]
    n, rank, n_first = r["rows"], f["rank"] + r["levels"], r["at_first"]["n"]
    cross, syy = within[:k, k], f["whole"][k + 1, k + 1] - f["whole"][0, k + 1] ** 2 / n
    out = np.zeros((k + 1, k + 1))
    if meat is None:
        ssr, full = float(within[k, k] - beta @ cross), 0
        s2 = ssr / (n - rank) if n > rank else float("nan")
        out[1:, 1:] = inv * s2
        out[0, 1:] = out[1:, 0] = -inv @ mean * s2
        out[0, 0] = s2 * (1 / n_first + mean @ inv @ mean)
        wald = (r["between"] - f["whole"][0, k + 1] ** 2 / n + beta @ cross) / s2 if s2 else float("nan")
        restrictions = f["rank"] + r["levels"] - 1
    else:
        ssr, full = meat["ssr"], meat["full"]
        core = symmetric(meat, k, "m")[1:, 1:]
        own = meat["at_first"]
        m0, m1 = own["s0"] or 0.0, np.array([own[f"s1_{i}"] or 0.0 for i in range(k)])
        # Influence of a row: its own level's mean, less the slopes at the first level's means.
        out[1:, 1:] = inv @ core @ inv
        out[0, 1:] = out[1:, 0] = inv @ m1 / n_first - out[1:, 1:] @ mean
        out[0, 0] = m0 / n_first ** 2 - 2 * mean @ inv @ m1 / n_first + mean @ out[1:, 1:] @ mean
        wald, restrictions = _wald(meat, core, cross, k)
    # The constant at the original location of the controls.
    coef = np.concatenate([[f["mean"][k] - beta @ mean + r["_my"] - beta @ f["shift"]], beta])
    move = np.eye(k + 1)
    move[0, 1:] = -f["shift"]
    return AbsorbedFit(
        s, [CONST, *names], coef, move @ out @ move.T, n, float(1 - ssr / syy) if syy else float("nan"),
        meat is not None, full, moments=dict(rank=rank, xtx=f["whole"][:k + 1, :k + 1], xty=f["whole"][:k + 1, k + 1], syy=syy),
        wald=float(wald), restrictions=int(restrictions))


def _wald(meat, core: np.ndarray, cross: np.ndarray, k: int) -> tuple[float, int]:
    """Distance of the fit from "no slopes, equal intercepts" in the robust metric, and its dimension.

    The meat is diagonal over the levels, so its inverse needs sums over levels and one k x k inverse.
    """
    if not meat["live"]:
        return float("nan"), 0
    rest = core - symmetric(meat, k, "o")[1:, 1:]
    unit = np.sqrt(np.where(np.diag(core) > 0, np.diag(core), 1.0))
    inverse, rank = floored_inverse(rest / np.outer(unit, unit))
    inverse = inverse / np.outer(unit, unit)
    a = cross - np.array([meat[f"a_{i}"] for i in range(k)])
    b = -np.array([meat[f"b_{i}"] for i in range(k)])
    aa, ab, bb = meat["aa"] + a @ inverse @ a, meat["ab"] + a @ inverse @ b, meat["bb"] + b @ inverse @ b
    return float(aa - ab * ab / bb), rank + meat["live"] - 1
