"""What reaches the driver or one task does not grow with the rows where it need not."""

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.models import features as ft
from docketry.models import calibration as cb
from docketry.models.neighbours import NeighbourVote

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()),
                       T.StructField("treated", T.IntegerType())])


def test_word_vectors_are_trained_by_more_tasks_when_tokens_grow(spark, monkeypatch):
    asked = []
    plain = ft.Word2Vec
    monkeypatch.setattr(ft, "Word2Vec", lambda **kw: asked.append(kw["numPartitions"]) or plain(**kw))
    monkeypatch.setattr(ft, "TOKENS_A_TASK", 40)
    df = spark.createDataFrame([(["ab", "cd", "ef", "gh"],)] * 25, "t array<string>")
    ft.WordVectors(inputCol="t", outputCol="v", size=3, minCount=1, epochs=1).fit(df)
    ft.WordVectors(inputCol="t", outputCol="v", size=3, minCount=1, epochs=1).fit(df.limit(5))
    assert asked == [3, 1]


def test_wide_fits_share_the_driver(spark):
    rows = [(1, SparseVector(10, [1], [1.0]), 1)], [(1, SparseVector(5_000_000, [1], [1.0]), 1)]
    assert [cb.fits_at_once(spark.createDataFrame(r, SCHEMA), "features") for r in rows] == [6, 1]


def test_neighbours_fetch_vectors_of_the_held_rows_only(spark):
    """The rows with the smallest hashes, copies and all; a plain sort would send the first ones of every task."""
    vectors = [SparseVector(50, [i % 40, 40 + i % 10], [0.6, 0.8]) for i in range(300)]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors)], SCHEMA).repartition(6)
    model = NeighbourVote(keyCol="id", maxRows=50, k=3).fit(df)
    raw = ft.sparse_columns(df).select("id", F.xxhash64(F.lit(42), "_idx", "_val").alias("h"))
    want = sorted(r["id"] for r in raw.orderBy("h", "id").limit(50).collect())
    import json
    assert json.loads(model.getOrDefault(model.state))["id"] == want


def test_smooth_idf_of_empty_rows_and_unused_columns(spark):
    import math
    df = spark.createDataFrame([(1, SparseVector(4, [0, 2], [1.0, 3.0]), 0), (2, SparseVector(4, [0], [2.0]), 0),
                                (3, SparseVector(4, [], []), 0)], SCHEMA)
    got = ft.SmoothIdf(inputCol="features", outputCol="x").fit(df).getScalingVec().toArray()
    assert [round(x, 12) for x in got] == [round(1 + math.log(4 / (1 + n)), 12) for n in (2, 0, 1, 0)]
