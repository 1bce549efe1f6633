"""Distributed routes against plain Python, with block sizes that force them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docketry.functions.claims import uniform_from_hash, uniform_from_key
from docketry.operators import counting as ct
from docketry.operators import ranking as rk
from docketry.operators import sampling as sp


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows, a third of them with one and the same value."""
    rng = random.Random(7)
    rows = [(i, 5.0 if i % 3 == 0 else rng.random() * 10) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "id long, v double").repartition(6).cache()


@pytest.mark.parametrize("n", [1, 2, 700, 1000, 1333, 1999, 2000])
def test_smallest_n_in_blocks(skewed, n):
    rows, df = skewed
    got = {r["id"] for r in rk.smallest_n(df, ["v", "id"], n, rows_per_block=50).collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:n]}


def test_smallest_n_refuses_too_many(skewed):
    with pytest.raises(ValueError):
        rk.smallest_n(skewed[1], ["v", "id"], 2001)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_blocks(spark, descending):
    rows = [(float(i * i % 997) + i / 1e4, i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "s double, n long")
    got = {r["s"]: r["cum_n"] for r in rk.running_sums(df, "s", ["n"], descending, rows_per_block=40).collect()}
    total = 0
    for s, n in sorted(rows, reverse=descending):
        total += n
        assert got[s] == total


def test_weighted_draw_without_replacement(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") < 500, 3.0).otherwise(1.0))
    draw = sp.weighted_without_replacement(df, 200, "w", uniform_from_hash(1, "id"), "id", rows_per_block=100)
    ids = [r["id"] for r in draw.collect()]
    assert len(ids) == len(set(ids)) == 200
    assert 0.62 < sum(i < 500 for i in ids) / 200 < 0.84
    with pytest.raises(ValueError):
        sp.weighted_without_replacement(df, 1001, "w", uniform_from_hash(1, "id"), "id")


def test_weighted_draw_with_replacement_and_one_heavy_row(spark):
    df = spark.range(400).withColumn("w", F.when(F.col("id") == 7, 200.0).otherwise(1.0))
    draw = sp.weighted_with_replacement(df, 6000, "w", "id", rows_per_bucket=50, draws_per_slice=100)
    counts = {r["id"]: r["count"] for r in draw.groupBy("id").count().collect()}
    assert sum(counts.values()) == 6000
    assert abs(counts[7] / 6000 - 200 / 599) < 0.03
    others = [counts.get(i, 0) for i in range(400) if i != 7]
    assert 8 < sum(others) / 399 < 12 and max(others) < 30


def test_uniform_sample_keeps_all_when_small(spark):
    df = spark.range(50)
    assert sp.uniform_sample(df, 100, uniform_from_key("id"), "id").count() == 50
    assert sp.uniform_sample(df, 20, uniform_from_key("id"), "id").count() == 20


def test_stratified_split_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = sp.stratified_split(df, "y", uniform_from_hash(3, "id"), "id", rows_per_block=64)
    sizes = {(r["y"], r["is_test"]): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    assert sizes[(1, 1)] == math.ceil(0.15 * 100) and sizes[(0, 1)] == math.ceil(0.15 * 900)


def test_first_per_key_with_many_copies(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), "id",
        (F.col("id") * 2).alias("other"),
    )
    out = {r["text"]: (r["id"], r["other"]) for r in ct.first_per_key(df, ["text"], ["id"]).collect()}
    assert len(out) == 2001 and out["same"] == (0, 0)


def test_funnel_counts(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 1, None), (None, 1, 1)], "id int, a int, b int")
    out = [(r["n_rows"], r["n_ids"]) for r in ct.funnel(df, "id", [("a", F.col("a") == 1), ("b", F.col("b") == 1)])
           .orderBy("step").collect()]
    assert out == [(3, 2), (2, 1)]


def test_key_draws_take_any_integer(spark):
    keys = [0, 1, 13_456_789_000, 3_474_701_533, 2**62, 2**63 - 1, -(2**63), -5, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r["u"] for r in df.select(uniform_from_key("k").alias("u")).collect()]
    assert got[-1] is None and all(0 < u < 1 for u in got[:-1])
    assert got[1] == (2654435761 + 0.5) / 4294967296


def test_weighted_draw_is_exact_with_many_claims(spark):
    """2,000 claims of one application share hash and weight; ties go by application and claim."""
    rows = [(13_456_789, c, 0.5) for c in range(2000)] + [(20_000_001 + i, 0, 0.25) for i in range(500)]
    df = spark.createDataFrame(rows, "app_id long, claim_int int, w double")
    drawn = sp.weighted_without_replacement(df, 700, "w", F.lit(0.5), ["app_id", "claim_int"], rows_per_block=100)
    assert sorted((r["app_id"], r["claim_int"]) for r in drawn.collect()) == [(13_456_789, c) for c in range(700)]


def test_clamped_years(spark):
    df = spark.createDataFrame([(2010,), (2014,), (2016,)], "year int")
    years = lambda low, high: sorted(r["year"] for r in ct.clamp_years(df, low, high).collect())
    assert years(2000, 2014) == [2010, 2014] and years(2012, 2030) == [2014, 2016]
    assert years(2020, 2030) == [2016] and years(1990, 2000) == [2010]
