"""Integer id sets as bitmaps."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import joins
from docketry.plans import cohort

IDS = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, 10_000_000, 2**40 + 5, -1, -5, -32768, -70000]


@pytest.mark.parametrize("most", [1 << 26, 4096])
def test_semi_by_id_equals_semi(spark, most):
    """By bitmaps, and by join where the bitmaps are too many."""
    near = sorted({i + d for i in IDS for d in (-1, 0, 1)})
    df = spark.createDataFrame([(i, f"t{i}") for i in near] + [(None, "none"), (7, "again")], "id long, text string")
    ids = spark.createDataFrame([(i,) for i in IDS + [7, None]], "id long")
    got = joins.semi_by_id(df, ids, "id", most)
    assert got.columns == ["id", "text"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joins.semi(df, ids.dropna(), "id").collect()))


def test_texts_are_not_exchanged(spark):
    claims = spark.range(5000).select(
        F.col("id").cast("string").alias("patent_id"), F.lit(0).alias("claim_sequence"), F.lit("1. A device").alias("claim_text"),
        F.lit(None).cast("string").alias("dependent"), F.lit(1).alias("claim_number"), F.lit(2012).alias("year"))
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("patent_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        out = cohort.extract_patent_claims(claims, ids)
        assert out.count() == 715
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
