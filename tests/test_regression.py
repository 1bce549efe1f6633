"""Panel models against dense numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.operators import panel as pn
from docketry.operators import regression as rg


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        for q in range(8):
            for t in (0, 1):
                if rng.random() < 0.1:
                    continue  # unbalanced
                count = int(rng.poisson(20 + 5 * t + 3 * g - 4 * t * (q > 3))) + 1
                rows.append((f"g{g}", pd.Timestamp(2012 + q // 4, 3 * (q % 4) + 1, 1).date(), t, count, int(q > 3)))
    pdf = pd.DataFrame(rows, columns=["group_id", "quarter_issue_date_dt", "Treated", "Count", "Post"])
    pdf["log_Count"] = np.log(pdf["Count"])
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def ols(x, y, groups, dof_extra=0):
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    e = y - x @ beta
    meat = sum(np.outer(s, s) for s in (x[groups == g].T @ e[groups == g] for g in np.unique(groups)))
    n, k, g = len(y), np.linalg.matrix_rank(x), len(np.unique(groups))
    cov = g / (g - 1) * (n - 1) / (n - k) * bread @ meat @ bread
    return beta, np.sqrt(np.diag(cov))


def test_did_ols(panel):
    pdf, df = panel
    x = np.column_stack([np.ones(len(pdf)), pdf.Treated, pdf.Post, pdf.Treated * pdf.Post]).astype(float)
    beta, se = ols(x, pdf.log_Count.to_numpy(), pdf.group_id.to_numpy())
    got = rg.did_ols(df)[0].toPandas()
    assert np.allclose(got.coef, beta, atol=1e-9) and np.allclose(got.std_err, se, atol=1e-9)


def test_fixed_effects_equals_dummies(panel):
    pdf, df = panel
    dummies = pd.get_dummies(pdf[["group_id", "quarter_issue_date_dt"]].astype(str)).to_numpy(float)
    x = np.column_stack([pdf.Treated, pdf.Treated * pdf.Post, dummies]).astype(float)
    beta, se = ols(x, pdf.log_Count.to_numpy(), pdf.group_id.to_numpy())
    got = rg.fixed_effects(df)[0].toPandas()
    assert np.allclose(got.coef, beta[:2], atol=1e-8)
    assert np.allclose(got.std_err, se[:2], rtol=1e-6)


def test_poisson_is_cell_means_and_glm(panel):
    pdf, df = panel
    m = pdf.groupby(["Treated", "Post"]).Count.mean()
    want = [math.log(m[0, 0]), math.log(m[1, 0] / m[0, 0]), math.log(m[0, 1] / m[0, 0]),
            math.log(m[1, 1] * m[0, 0] / m[1, 0] / m[0, 1])]
    got = rg.poisson(df)[0].toPandas()
    assert np.allclose(got.coef, want, atol=1e-9)
    glm = rg.poisson_glm(df)
    assert np.allclose([glm.intercept, *glm.coefficients.toArray()], want, atol=1e-5)
    assert np.allclose(list(glm.summary.coefficientStandardErrors), [*got.std_err[1:], got.std_err[0]], rtol=1e-3)


def test_negative_binomial_alpha(panel):
    pdf, df = panel
    got = rg.negative_binomial(df)[0].toPandas().set_index("term")
    mu = pdf.groupby(["Treated", "Post"]).Count.transform("mean").to_numpy()
    y = pdf.Count.to_numpy()

    def ll(a):
        r = 1 / a
        lg = np.vectorize(math.lgamma)
        return (lg(y + r) - lg(r) - lg(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum()

    grid = np.exp(np.linspace(-8, 1, 2000))
    best = grid[np.argmax([ll(a) for a in grid])]
    assert got.coef["alpha"] == pytest.approx(best, rel=0.01)


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 2.5, 10.0, 1234.5]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select(rg.log_gamma(F.col("x"))).collect()
    assert np.allclose([r[0] for r in out], [math.lgamma(x) for x in xs], atol=1e-9)


def test_series_start_at_one_and_interval_holds_mean(panel):
    _, df = panel
    series = pn.normalized_series(df)
    first = series.groupBy("group_id", "Treated").agg(F.min_by("normalized_Count", "quarter_issue_date_dt").alias("f"))
    assert {r["f"] for r in first.collect()} == {1.0}
    out = pn.bootstrap_series(series, replicates=200).collect()
    assert all(r["ci_low"] <= r["mean"] + 1e-9 and r["mean"] <= r["ci_high"] + 1e-9 for r in out)


def test_fixed_effects_of_five_thousand_periods(spark):
    """Unbalanced, with an entity and a period of one row; the sweep by alternating means in numpy is the yardstick."""
    rng = np.random.default_rng(8)
    n = 30_000
    e, t = rng.integers(0, 40, n), rng.integers(0, 5_000, n)
    e[0], t[0], e[1], t[1] = 40, 17, 3, 5_000
    pdf = pd.DataFrame({"group_id": e, "quarter_issue_date_dt": t, "Treated": rng.integers(0, 2, n)})
    pdf["Post"] = (pdf.quarter_issue_date_dt > 2_500).astype(int)
    pdf["log_Count"] = 0.3 * pdf.Treated - 0.2 * pdf.Treated * pdf.Post + 0.05 * e + np.sin(t) + rng.normal(0, 0.3, n)
    m = np.column_stack([pdf.log_Count, pdf.Treated, pdf.Treated * pdf.Post]).astype(float)
    counts = [np.bincount(k)[k][:, None] for k in (e, t)]
    for _ in range(200):
        for k, c in zip((e, t), counts):
            m -= np.column_stack([np.bincount(k, m[:, j])[k] for j in range(3)]) / c
    x, y = m[:, 1:], m[:, 0]
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    scores = np.column_stack([np.bincount(e, x[:, j] * (y - x @ beta)) for j in range(2)])
    g, k = len(np.unique(e)), len(np.unique(t)) - 1 + 2
    cov = g / (g - 1) * (n - 1) / (n - k - g) * bread @ (scores.T @ scores) @ bread
    got = rg.fixed_effects(spark.createDataFrame(pdf))[0].toPandas()
    assert np.allclose(got.coef, beta, atol=1e-8)
    assert np.allclose(got.std_err, np.sqrt(np.diag(cov)), rtol=1e-6)
