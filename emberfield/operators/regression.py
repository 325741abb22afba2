"""Linear regression from distributed sums.

Three passes over the rows, each one grouped aggregate whose result has (strata x category levels)
rows, as many as the fit has reported terms:

1. mean and spread per stratum, for standardising and for centring the response;
2. sums of products of the numeric columns per stratum and category level;
3. squared residuals, leverage-weighted where the robust errors need it.

Dummy variables are never built as columns. A dummy is constant inside its level, so its products
with everything else are just the sums of that level; the full matrix is put together from them.
What reaches the driver are these sums; the p x p algebra is done there with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement
from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.numeric import significance_stars

CONST = "const"
FULL_LEVERAGE = 1e-10


@dataclass
class Fit:
    """One fitted model. ``cov`` is the covariance of ``coef`` in the order of ``terms``."""

    stratum: str
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    rsquared: float
    robust: bool
    full_leverage_rows: int = 0
    clusters: int | None = None
    moments: dict = field(default_factory=dict, repr=False)

    @property
    def rank(self) -> int:
        return self.moments["rank"]

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def rsquared_adj(self) -> float:
        if self.df_resid <= 0:
            return float("nan")
        return 1 - (1 - self.rsquared) * (self.n - 1) / self.df_resid

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    @property
    def stat(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.coef / self.se

    @property
    def pvalues(self) -> list[float]:
        """Normal for robust errors, t for classic ones."""
        if self.robust:
            return [erfc(abs(z) / sqrt(2)) for z in self.stat]
        return [f_tail(t * t, 1, self.df_resid) for t in self.stat]

    @property
    def fvalue(self) -> float:
        """Wald statistic of "all slopes are zero" over their number."""
        b, inverse, rank = self._slopes()
        return float(b @ inverse @ b) / rank if rank else float("nan")

    @property
    def f_pvalue(self) -> float:
        df = self.df_resid if self.clusters is None else self.clusters - 1
        return f_tail(self.fvalue, self._slopes()[2], df)

    def _slopes(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Slopes, the inverse of their covariance and its rank, which collinear columns lower."""
        at = [i for i, t in enumerate(self.terms) if t != CONST]
        v = self.cov[np.ix_(at, at)]
        if not at or not np.isfinite(v).all():
            return self.coef[at], np.full_like(v, np.nan), len(at)
        # Scaled to a unit diagonal, so that the units of the slopes do not enter the decision.
        scale = np.sqrt(np.diag(v))
        scale[scale == 0] = 1.0
        inverse, rank = spectral_inverse(v / np.outer(scale, scale), 1e-9)
        return self.coef[at], inverse / np.outer(scale, scale), rank


def spectral_inverse(m: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, int]:
    """Pseudo-inverse of a symmetric matrix and its rank, by one decision on its eigenvalues."""
    values, vectors = np.linalg.eigh(m)
    size = np.abs(values)
    live = size > max(least, 8 * len(m) * np.finfo(float).eps) * size.max(initial=0.0)
    return (vectors[:, live] / values[live]) @ vectors[:, live].T, int(live.sum())


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f): the regularised incomplete beta function by its continued fraction, at every size."""
    if not f == f or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    ratio = d1 * f / d2
    a, b = d2 / 2, d1 / 2
    # x = 1 / (1 + ratio); its logarithm is taken from ratio, because x is close to 1 for large d2.
    log_x, log_y = -log1p(ratio), log(ratio) - log1p(ratio)
    x, y = 1 / (1 + ratio), ratio / (1 + ratio)
    front = exp(_log_gamma_step(a, b) - lgamma(b) + a * log_x + b * log_y)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front / b * _beta_fraction(y, b, a)
    return front / a * _beta_fraction(x, a, b)


def _log_gamma_step(a: float, b: float) -> float:
    """log gamma(a + b) - log gamma(a), without cancellation for large ``a``."""
    if a < 1e4:
        return lgamma(a + b) - lgamma(a)
    return (a + b - 0.5) * log1p(b / a) + b * log(a) - b + 1 / (12 * (a + b)) - 1 / (12 * a)


def _beta_fraction(x: float, a: float, b: float) -> float:
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or 1e-300)
    out = d
    for m in range(1, 1_000_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or 1e-300)
            c = (1.0 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            return out
    raise ArithmeticError("the continued fraction did not converge")


def pairs(k: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(k), 2))


def product_sums(df: DataFrame, by: Sequence[str], columns: Sequence[Column],
                 weight: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Per group: ``s0`` (row count or weight), ``s1_i`` (sums) and ``s2_i_j`` (sums of products)."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(w).alias("s0"),
        *[F.sum(w * c).alias(f"s1_{i}") for i, c in enumerate(columns)],
        *[F.sum(w * columns[i] * columns[j]).alias(f"s2_{i}_{j}") for i, j in pairs(len(columns))],
        *extra)


def symmetric(row, k: int, products: str = "s2") -> np.ndarray:
    """(k+1) x (k+1) matrix of one group with the constant first; other ``products`` come without it."""
    out = np.zeros((k + 1, k + 1))
    if products == "s2":
        out[0, 0] = row["s0"] or 0.0
        for i in range(k):
            out[0, i + 1] = out[i + 1, 0] = row[f"s1_{i}"] or 0.0
    for i, j in pairs(k):
        out[i + 1, j + 1] = out[j + 1, i + 1] = row[f"{products}_{i}_{j}"] or 0.0
    return out


def _assemble(groups: dict[str, np.ndarray], kept: list[str], k: int) -> np.ndarray:
    """Full matrix [constant, k columns, dummies] from one small matrix per category level."""
    out = np.zeros((1 + k + len(kept),) * 2)
    for level, g in groups.items():
        out[:k + 1, :k + 1] += g[:k + 1, :k + 1]
        if level in kept:
            at = k + 1 + kept.index(level)
            out[at, :k + 1] = out[:k + 1, at] = g[0, :k + 1]
            out[at, at] = g[0, 0]
    return out


def fit_ols(
    df: DataFrame,
    y: str,
    standardised: Sequence[str],
    controls: Sequence[str] = (),
    category: str | None = None,
    levels: Sequence[str] | None = None,
    prefix: str = "cat",
    strata: str | None = None,
    cov: str = "HC3",
    cluster: str | None = None,
) -> dict[str, Fit]:
    """Fit ``y ~ 1 + z(standardised) + controls + dummies(category)`` per stratum.

    ``cov`` is ``HC3``, ``classic`` or ``cluster`` (sums of scores per ``cluster`` value, without
    category). ``levels`` fixes the dummy order (first is the reference, levels that do not occur
    get coefficient 0); otherwise the observed levels are sorted. Incomplete rows are left out.

    Every dummy is a term of the result with its covariances, so the driver holds a matrix of that
    size. For a category of any cardinality, and wherever its dummies are not reported, use
    :func:`~emberfield.operators.absorbed.fit_absorbed`.
    """
    if cov == "cluster" and (category or not cluster):
        raise ValueError("cluster errors need a cluster column and no category")
    spark = df.sparkSession
    names = [*standardised, *controls]
    k = len(names)
    src = df.select(
        (F.col(strata).cast("string") if strata else F.lit("all")).alias("_s"),
        (F.col(category).cast("string") if category else F.lit("")).alias("_g"),
        F.col(y).cast("double").alias("_y"),
        *([F.col(cluster).alias("_cl")] if cluster else []),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)]).dropna()

    # Pass 1: location and spread per stratum.
    stats = src.groupBy("_s").agg(F.avg("_y").alias("my"), *[
        F.struct(F.avg(f"_x{i}").alias("m"), F.stddev_samp(f"_x{i}").alias("s")).alias(f"z{i}")
        for i in range(len(standardised))]).collect()
    if not stats:
        return {}
    params = spark.createDataFrame(
        [(r["_s"], r["my"],
          [r[f"z{i}"]["m"] for i in range(len(standardised))] + [0.0] * len(controls),
          [r[f"z{i}"]["s"] or float("inf") for i in range(len(standardised))] + [1.0] * len(controls))
         for r in stats],
        "_s string, my double, m array<double>, s array<double>")
    centre = {r["_s"]: r["my"] for r in stats}
    # Catalyst does not know the size of a table made by the driver, and would send all rows of a stratum to one task.
    scaled = src.join(F.broadcast(params), "_s").select(
        "_s", "_g", *(["_cl"] if cluster else []), (F.col("_y") - F.col("my")).alias("_y"),
        *[((F.col(f"_x{i}") - F.col("m")[i]) / F.col("s")[i]).alias(f"_x{i}") for i in range(k)])
    xs = [F.col(f"_x{i}") for i in range(k)]

    # Pass 2: products of the numeric columns and the response.
    small: dict[str, dict[str, np.ndarray]] = {}
    rows: dict[str, int] = {}
    for r in product_sums(scaled, ["_s", "_g"], [*xs, F.col("_y")]).collect():
        small.setdefault(r["_s"], {})[r["_g"]] = symmetric(r, k + 1)
        rows[r["_s"]] = rows.get(r["_s"], 0) + r["rows"]
    solved = {}
    for s, groups in small.items():
        order = [str(v) for v in levels] if levels is not None else sorted(groups)
        kept = order[1:] if category else []
        xtx = _assemble(groups, kept, k)
        xty = np.concatenate([sum(g[k + 1, :k + 1] for g in groups.values()),
                              [groups[v][0, k + 1] if v in groups else 0.0 for v in kept]])
        inverse, rank = spectral_inverse(xtx)
        syy = sum(g[k + 1, k + 1] for g in groups.values())
        solved[s] = dict(kept=kept, xtx=xtx, xty=xty, inverse=inverse, rank=rank, beta=inverse @ xty, syy=syy)

    # Pass 3: residual sums with the parameters of each stratum and level.
    level_rows = []
    for s, groups in small.items():
        fit = solved[s]
        inv, beta, kept = fit["inverse"], fit["beta"], fit["kept"]
        core = slice(1, k + 1)
        for level in groups:
            at = [0] + ([k + 1 + kept.index(level)] if level in kept else [])
            level_rows.append((
                s, level, float(beta[at].sum()), beta[core].tolist(),
                float(inv[np.ix_(at, at)].sum()), inv[core][:, at].sum(axis=1).tolist(),
                [float(inv[i + 1, j + 1]) * (1 if i == j else 2) for i, j in pairs(k)]))
    fitted = spark.createDataFrame(
        level_rows, "_s string, _g string, b0 double, b array<double>, h0 double, "
        "h1 array<double>, h2 array<double>")
    joined = scaled.join(F.broadcast(fitted), ["_s", "_g"])
    predicted = F.col("b0")
    leverage = F.col("h0")
    for i, x in enumerate(xs):
        predicted = predicted + F.col("b")[i] * x
        leverage = leverage + F.col("h1")[i] * x * 2
    for at, (i, j) in enumerate(pairs(k)):
        leverage = leverage + F.col("h2")[at] * xs[i] * xs[j]
    keep = ["_s", "_g", *(["_cl"] if cluster else []), *[f"_x{i}" for i in range(k)]]
    resid = joined.select(*keep, (F.col("_y") - predicted).alias("_e"),
                          (1 - leverage).alias("_room") if cov == "HC3" else F.lit(1.0).alias("_room"))
    free = F.col("_room") > FULL_LEVERAGE
    weight = F.when(free, F.pow(F.col("_e") / F.col("_room"), F.lit(2)))
    out: dict[str, Fit] = {}
    if cov == "cluster":
        meats, ssr, n_clusters = _cluster_meat(resid, xs)
        full: dict[str, int] = {}
    else:
        sums = product_sums(
            resid, ["_s", "_g"], xs if cov == "HC3" else [], weight,
            [F.sum(F.col("_e") * F.col("_e")).alias("ssr"), F.count_if(~free).alias("full")])
        meats, ssr, full, n_clusters = {}, {}, {}, {}
        for r in sums.collect():
            meats.setdefault(r["_s"], {})[r["_g"]] = symmetric(r, k if cov == "HC3" else 0)
            ssr[r["_s"]] = ssr.get(r["_s"], 0.0) + r["ssr"]
            full[r["_s"]] = full.get(r["_s"], 0) + r["full"]
    for s, fit in solved.items():
        inv, n = fit["inverse"], rows[s]
        p = fit["rank"]
        if cov == "HC3":
            cov_m = inv @ _assemble(meats[s], fit["kept"], k) @ inv
        elif cov == "cluster":
            g = n_clusters[s]
            # One cluster or no residual freedom leaves the errors undefined, not the coefficients.
            scale = g / (g - 1) * ((n - 1) / (n - p)) if g > 1 and n > p else float("nan")
            cov_m = inv @ meats[s] @ inv * scale
        else:
            cov_m = inv * (ssr[s] / (n - p) if n > p else float("nan"))
        coef = fit["beta"].copy()
        coef[0] += centre[s]
        out[s] = Fit(
            s, [CONST, *names, *[f"{prefix}_{v}" for v in fit["kept"]]], coef, cov_m, n,
            float(1 - ssr[s] / fit["syy"]) if fit["syy"] else float("nan"), cov != "classic",
            full.get(s, 0), n_clusters.get(s), moments=fit)
    return out


def _cluster_meat(resid: DataFrame, xs: Sequence[Column]) -> tuple[dict, dict, dict]:
    """Outer products of the score sums per cluster, added up over clusters."""
    k = len(xs)
    scores = resid.groupBy("_s", "_cl").agg(
        F.sum("_e").alias("u0"), *[F.sum(F.col("_e") * x).alias(f"u{i + 1}") for i, x in enumerate(xs)],
        F.sum(F.col("_e") * F.col("_e")).alias("ssr"))
    total = scores.groupBy("_s").agg(
        F.sum("ssr").alias("ssr"), F.count(F.lit(1)).alias("g"),
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs(k + 1)])
    meats, ssr, clusters = {}, {}, {}
    for r in total.collect():
        m = np.zeros((k + 1, k + 1))
        for i, j in pairs(k + 1):
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        meats[r["_s"]], ssr[r["_s"]], clusters[r["_s"]] = m, r["ssr"], r["g"]
    return meats, ssr, clusters


def nested_rsquared(fit: Fit, terms: Sequence[str]) -> float:
    """R2 of the model with only the constant and ``terms``, from the sums of the larger fit."""
    at = [fit.terms.index(t) for t in [CONST, *terms]]
    xtx, xty = fit.moments["xtx"][np.ix_(at, at)], fit.moments["xty"][at]
    return float(xty @ np.linalg.pinv(xtx, hermitian=True) @ xty / fit.moments["syy"])


def coefficient_table(spark, fits: dict[str, Fit], terms: Sequence[str] | None = None) -> DataFrame:
    """One row per model and term: coef, se, statistic, p, stars and the fit statistics.

    ``terms`` limits the rows, for instance to the constant and the socio-economic columns.
    """
    rows = []
    for s, f in fits.items():
        whole = (f.n, float(f.rsquared), float(f.rsquared_adj), f.fvalue, f.f_pvalue, f.full_leverage_rows)
        for term, b, se, stat, p in zip(f.terms, f.coef, f.se, f.stat, f.pvalues):
            if terms is None or term in terms:
                rows.append((s, term, float(b), float(se), float(stat), float(p), *whole))
    table = spark.createDataFrame(
        rows, "stratum string, term string, coef double, se double, stat double, p double, n long, "
        "r2 double, r2_adj double, f double, f_p double, full_leverage_rows long")
    return table.withColumn("stars", significance_stars(F.col("p")))
