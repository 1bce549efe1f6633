"""Regressions of the panel; data is reduced by Spark, only K x K matrices reach the driver."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import stored, written

TERMS = ["Intercept", "Treated", "Post", "Treated:Post"]
MAX_SWEEPS = 500  # steps of the conjugate gradients; a fit that needs more warns
SWEEP_TOLERANCE = 1e-20  # of the squared residual at the start
COEFFICIENTS = "model string, term string, coef double, std_err double, z double, p_value double"
STATISTICS = "model string, statistic string, value double"


def over_stored_panel(fit):
    """The fits read the panel in several jobs; it is built once."""

    @wraps(fit)
    def run(panel: DataFrame, *args, **kwargs):
        with stored(panel) as kept:
            return fit(kept, *args, **kwargs)

    return run


def design() -> list[Column]:
    t, p = F.col("Treated").cast("double"), F.col("Post").cast("double")
    return [F.lit(1.0), t, p, t * p]


def _cross_products(df: DataFrame, xs: Sequence[Column], y: Column, weight: Column | None = None) -> tuple:
    """X'WX, X'Wy and n in one aggregate."""
    w = F.lit(1.0) if weight is None else weight
    k = len(xs)
    aggs = [F.sum(w * xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(w * xs[i] * y).alias(f"b{i}") for i in range(k)]
    row = df.agg(*aggs, F.count(F.lit(1)).alias("n")).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    return a, np.array([row[f"b{i}"] for i in range(k)]), row["n"]


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else float("nan")


def _table(df: DataFrame, model: str, terms: Sequence[str], beta, cov) -> DataFrame:
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    rows = []
    for name, b, s in zip(terms, beta, se):
        z = float(b / s) if s > 0 else float("nan")
        rows.append((model, name, float(b), float(s), z, _normal_p(z)))
    return df.sparkSession.createDataFrame(rows, COEFFICIENTS)


def _statistics(df: DataFrame, model: str, **values: float) -> DataFrame:
    return df.sparkSession.createDataFrame([(model, k, float(v)) for k, v in values.items()], STATISTICS)


def _clustered(df, xs, residual, bread, cluster: str, n: int, k: int) -> np.ndarray:
    """Sandwich with scores summed per cluster by Spark and crossed in a second aggregate."""
    sums = df.groupBy(cluster).agg(*[F.sum(x * residual).alias(f"u{i}") for i, x in enumerate(xs)])
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = sums.agg(
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("g")
    ).first()
    meat = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    g = row["g"]
    factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else 1.0
    return factor * bread @ meat @ bread


def _fitted(xs: Sequence[Column], beta) -> Column:
    out = F.lit(float(beta[0])) * xs[0]
    for b, x in zip(beta[1:], xs[1:]):
        out = out + F.lit(float(b)) * x
    return out


@over_stored_panel
def did_ols(panel: DataFrame, cluster: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """log_Count ~ Treated * Post, errors clustered by group."""
    xs, y = design(), F.col("log_Count")
    a, b, n = _cross_products(panel, xs, y)
    bread = np.linalg.inv(a)
    beta = bread @ b
    residual = y - _fitted(xs, beta)
    cov = _clustered(panel, xs, residual, bread, cluster, n, len(beta))
    fit = panel.agg(F.sum(residual * residual).alias("rss"), (F.var_pop(y) * F.count(y)).alias("tss")).first()
    r2 = 1 - fit["rss"] / fit["tss"]
    return (
        _table(panel, "ols", TERMS, beta, cov),
        _statistics(panel, "ols", n=n, r_squared=r2, adj_r_squared=1 - (1 - r2) * (n - 1) / (n - len(beta))),
    )


SWEPT = ["y", "x1", "x2"]


def _time_effects(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(t, y, x1, x2)``: the time effects of each column beside entity effects, and how many of them are free.

    The normal equations of the time effects, entity means swept out, are solved
    by conjugate gradients for the three columns at once. A step is two grouped
    sums over the (entity, time) cells and one row of scalar products at the
    driver; neither entities nor times are collected or bounded in number.
    """
    cells = written(rows.groupBy("e", "t").agg(F.count(F.lit(1)).cast("double").alias("n")), "cells")
    counts = written(cells.groupBy("t").agg(F.sum("n").alias("size")), "time-sizes")

    def swept_sums(weighted: DataFrame) -> list[Column]:
        return [F.sum(F.col("n") * (F.col(c) - F.col(f"mean_{c}"))).alias(c) for c in SWEPT]

    def off_entity_means(df: DataFrame) -> DataFrame:
        """Per time, the sums of the columns (weight n) with their entity means taken off."""
        means = df.groupBy("e").agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"mean_{c}") for c in SWEPT])
        return df.join(means, "e").groupBy("t").agg(*swept_sums(df))

    def named(prefix: str) -> list[Column]:
        return [F.col(c).alias(f"{prefix}_{c}") for c in SWEPT]

    target = off_entity_means(rows.withColumn("n", F.lit(1.0))).select("t", *named("r"))
    zero = F.lit(0.0)
    state = counts.join(target, "t").select(
        "t", "size", *[F.col(f"r_{c}") for c in SWEPT],
        *[zero.alias(f"{v}_{c}") for v in ("x", "p", "s") for c in SWEPT])
    state = written(state, "time-effects")
    beta_of, alpha_of, first = dict.fromkeys(SWEPT, 0.0), dict.fromkeys(SWEPT, 0.0), None
    before = {}
    for _ in range(MAX_SWEEPS):
        # u: residual over the diagonal; w: the equations' matrix times u
        u = state.select("t", *[(F.col(f"r_{c}") / F.col("size")).alias(c) for c in SWEPT])
        w = off_entity_means(cells.join(u, "t")).select("t", *named("w"))
        state = written(state.join(w, "t"), "time-effects")
        scalars = state.agg(
            *[F.sum(F.col(f"r_{c}") ** 2 / F.col("size")).alias(f"g_{c}") for c in SWEPT],
            *[F.sum(F.col(f"w_{c}") * F.col(f"r_{c}") / F.col("size")).alias(f"d_{c}") for c in SWEPT]).first()
        g = {c: scalars[f"g_{c}"] for c in SWEPT}
        first = first or g
        if all(g[c] <= SWEEP_TOLERANCE * first[c] for c in SWEPT):
            break
        for c in SWEPT:
            if g[c] <= SWEEP_TOLERANCE * first[c] or scalars[f"d_{c}"] <= 0:
                beta_of[c] = alpha_of[c] = 0.0
                continue
            beta_of[c] = g[c] / before[c] if before.get(c) and alpha_of[c] else 0.0
            curve = scalars[f"d_{c}"] - (beta_of[c] * g[c] / alpha_of[c] if alpha_of[c] else 0.0)
            alpha_of[c] = g[c] / curve
        before = g
        moved = ["t", "size"]
        for c in SWEPT:
            p = F.col(f"r_{c}") / F.col("size") + F.lit(beta_of[c]) * F.col(f"p_{c}")
            s = F.col(f"w_{c}") + F.lit(beta_of[c]) * F.col(f"s_{c}")
            moved += [(F.col(f"x_{c}") + F.lit(alpha_of[c]) * p).alias(f"x_{c}"), p.alias(f"p_{c}"), s.alias(f"s_{c}"),
                      (F.col(f"r_{c}") - F.lit(alpha_of[c]) * s).alias(f"r_{c}")]
        state = state.select(*moved)
    else:
        warnings.warn("the time effects stopped before they converged", stacklevel=2)
    effects = state.select("t", *[F.col(f"x_{c}").alias(f"effect_{c}") for c in SWEPT])
    return effects, counts.count() - _connected(cells)


def _connected(cells: DataFrame) -> int:
    """Groups of times that entities link: the smallest time reachable, until none gets smaller."""
    label = written(cells.select("t").distinct().withColumn("low", F.col("t")), "time-groups")
    while True:
        held = cells.join(label, "t")
        lowest = held.groupBy("e").agg(F.min("low").alias("low_e"))
        after = held.join(lowest, "e").groupBy("t").agg(F.min("low_e").alias("low"), F.min("low").alias("was"))
        after = written(after, "time-groups")
        if after.filter("low < was").isEmpty():
            return after.select("low").distinct().count()
        label = after.select("t", "low")


@over_stored_panel
def fixed_effects(
    panel: DataFrame, entity: str = "group_id", time: str = "quarter_issue_date_dt"
) -> tuple[DataFrame, DataFrame]:
    """log_Count on Treated and Treated:Post with entity and time effects, clustered by entity.

    Post is a function of the quarter, so the time effects absorb it. Both
    effects are swept out of all columns, exactly also for unbalanced panels and
    whatever the number of entities and times; what is left is a regression on
    two columns, with errors summed per entity.
    """
    rows = written(panel.select(
        F.col(entity).cast("string").alias("e"), F.col(time).cast("string").alias("t"),
        F.col("log_Count").cast("double").alias("y"), F.col("Treated").cast("double").alias("x1"),
        (F.col("Treated") * F.col("Post")).cast("double").alias("x2")).dropna(), "panel-rows")
    effects, free = _time_effects(rows)
    centred = rows.join(effects, "t").select("e", *[(F.col(c) - F.col(f"effect_{c}")).alias(c) for c in SWEPT])
    means = centred.groupBy("e").agg(*[F.avg(c).alias(f"mean_{c}") for c in SWEPT])
    swept = written(centred.join(means, "e").select("e", *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in SWEPT]), "swept")
    xs, y = [F.col("x1"), F.col("x2")], F.col("y")
    xx, xy, n = _cross_products(swept, xs, y)
    scale = rows.agg(*[F.sum(x * x).alias(f"s{i}") for i, x in enumerate(xs)]).first()
    absorbed = [xx[i, i] <= 1e-9 * (scale[i] or 0.0) for i in range(2)]
    for i in range(2):
        if absorbed[i]:
            xx[i, :] = xx[:, i] = xy[i] = 0.0
    bread = np.linalg.pinv(xx)
    beta = bread @ xy
    k = free + int(np.linalg.matrix_rank(xx))
    residual = y - _fitted(xs, beta)
    g = rows.select("e").distinct().count()
    cov = _clustered(swept, xs, residual, bread, "e", n, k + g)
    if n <= k + g and g > 1:  # the helper leaves its factor at one there
        cov = cov * g / (g - 1) * (n - 1)
    rss = swept.agg(F.sum(residual * residual)).first()[0]
    tss = rows.agg(F.var_pop("y") * F.count("y")).first()[0]
    r2, params = 1 - rss / tss, k + g
    return (
        _table(panel, "fixed_effects", ["Treated", "Treated:Post"], beta, cov),
        _statistics(panel, "fixed_effects", n=n, r_squared=r2, adj_r_squared=1 - (1 - r2) * (n - 1) / max(n - params, 1)),
    )


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0 by Stirling's series after a shift by eight."""
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def _cells(panel: DataFrame) -> dict[tuple[int, int], tuple[int, float]]:
    rows = panel.groupBy("Treated", "Post").agg(F.count(F.lit(1)).alias("n"), F.avg("Count").alias("m")).collect()
    return {(r["Treated"], r["Post"]): (r["n"], r["m"]) for r in rows}  # four cells


def cell_mean_coefficients(panel: DataFrame) -> DataFrame:
    """Coefficients of the saturated log-linear model: log ratios of cell means."""
    m = {
        (t, p): F.avg(F.when((F.col("Treated") == t) & (F.col("Post") == p), F.col("Count")))
        for t in (0, 1) for p in (0, 1)
    }
    base = F.log(m[0, 0])
    coefs = [
        ("Intercept", base),
        ("Treated", F.log(m[1, 0]) - base),
        ("Post", F.log(m[0, 1]) - base),
        ("Treated:Post", F.log(m[1, 1]) - F.log(m[1, 0]) - F.log(m[0, 1]) + base),
    ]
    one = panel.agg(*[c.alias(n) for n, c in coefs])
    rows = F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"`{n}`").alias("coef")) for n, _ in coefs])
    return one.select(F.inline(rows))


def _saturated(panel: DataFrame, model: str, information) -> tuple[np.ndarray, np.ndarray, dict]:
    cells = _cells(panel)
    if len(cells) < 4:
        raise ValueError("every combination of Treated and Post needs rows")
    xs = {c: np.array([1.0, c[0], c[1], c[0] * c[1]]) for c in cells}
    beta = np.linalg.solve(np.array(list(xs.values())), np.log([m for _, m in cells.values()]))
    info = sum(n * information(m) * np.outer(xs[c], xs[c]) for c, (n, m) in cells.items())
    return beta, np.linalg.inv(info), cells


@over_stored_panel
def poisson(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Count ~ Treated * Post with log link. Four cells, four coefficients: cell means solve it exactly."""
    beta, cov, cells = _saturated(panel, "poisson", lambda m: m)
    y = F.col("Count").cast("double")
    mu = _cell_mean(cells)
    null = panel.agg(F.avg("Count")).first()[0]
    ll = panel.agg(
        F.sum(y * F.log(mu) - mu - log_gamma(y + 1)).alias("full"),
        F.sum(y * math.log(null) - null - log_gamma(y + 1)).alias("null"), F.count(F.lit(1)).alias("n"),
    ).first()
    return (
        _table(panel, "poisson", TERMS, beta, cov),
        _statistics(panel, "poisson", n=ll["n"], log_likelihood=ll["full"], pseudo_r_squared=1 - ll["full"] / ll["null"]),
    )


def poisson_glm(panel: DataFrame):
    """The same model by Spark ML, for designs that are not saturated."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    formula = RFormula(formula="Count ~ Treated + Post + Treated:Post", featuresCol="x", labelCol="y")
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="y", tol=1e-10, maxIter=50)
    return Pipeline(stages=[formula, glm]).fit(panel).stages[-1]


def _cell_mean(cells) -> Column:
    out = F.lit(None).cast("double")
    for (t, p), (_, m) in cells.items():
        out = F.when((F.col("Treated") == t) & (F.col("Post") == p), F.lit(float(m))).otherwise(out)
    return out


def _nb_loglik(histogram: DataFrame, mu: Column, alphas: Sequence[float]) -> dict[float, float]:
    """NB2 log-likelihood at every alpha in one job over the histogram of counts."""
    r, y = 1 / F.col("alpha"), F.col("Count").cast("double")
    ll = (
        log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1)
        + r * F.log(r / (r + mu)) + y * F.log(mu / (r + mu))
    )
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    rows = histogram.select("*", grid).groupBy("alpha").agg(F.sum(F.col("n") * ll).alias("ll")).collect()
    return {r_["alpha"]: r_["ll"] for r_ in rows}


def _best_alpha(histogram: DataFrame, mu: Column) -> tuple[float, float]:
    low, high = -12.0, 6.0  # log alpha
    for _ in range(5):
        grid = [math.exp(v) for v in np.linspace(low, high, 25)]
        lls = _nb_loglik(histogram, mu, grid)
        best = max(lls, key=lls.get)
        step = (high - low) / 24
        low, high = math.log(best) - step, math.log(best) + step
    return best, lls[best]


@over_stored_panel
def negative_binomial(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NB2 with estimated dispersion: variance mu + alpha * mu^2.

    In the saturated design the means do not depend on alpha, so alpha is a
    search in one dimension over the histogram of counts per cell.
    """
    histogram = panel.groupBy("Treated", "Post", "Count").agg(F.count(F.lit(1)).alias("n")).cache()
    try:
        cells = _cells(panel)
        mu = _cell_mean(cells)
        alpha, ll = _best_alpha(histogram, mu)
        null_mean = panel.agg(F.avg("Count")).first()[0]
        _, ll_null = _best_alpha(histogram, F.lit(float(null_mean)))
        h = alpha * 1e-3
        around = _nb_loglik(histogram, mu, [alpha - h, alpha, alpha + h])
        curve = (around[alpha + h] - 2 * around[alpha] + around[alpha - h]) / h**2
    finally:
        histogram.unpersist()
    beta, cov, _ = _saturated(panel, "negative_binomial", lambda m: m / (1 + alpha * m))
    full = np.zeros((5, 5))
    full[:4, :4] = cov
    full[4, 4] = -1 / curve if curve < 0 else 0.0
    return (
        _table(panel, "negative_binomial", [*TERMS, "alpha"], [*beta, alpha], full),
        _statistics(
            panel, "negative_binomial", n=sum(n for n, _ in cells.values()), log_likelihood=ll,
            pseudo_r_squared=1 - ll / ll_null,
        ),
    )


def regression_table(*fits: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Long table (model, entry, value, stars) of coefficients and fit statistics."""
    out = None
    for coefs, stats in fits:
        stars = (
            F.when(F.col("p_value") < 0.01, "***").when(F.col("p_value") < 0.05, "**")
            .when(F.col("p_value") < 0.1, "*").otherwise("")
        )
        part = coefs.select("model", F.col("term").alias("entry"), F.col("coef").alias("value"), "std_err",
                            stars.alias("stars"))
        more = stats.select("model", F.col("statistic").alias("entry"), "value",
                            F.lit(None).cast("double").alias("std_err"), F.lit("").alias("stars"))
        part = part.unionByName(more)
        out = part if out is None else out.unionByName(part)
    return out
