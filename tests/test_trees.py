"""Sparse trees against Spark's own learner, and sizes that follow the non-zero entries."""

import json
import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.models import trees
from docketry.models.boosting import BoostedStumps, SparseBoosting
from docketry.models.trees import SparseForest, SparseTree

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()),
                       T.StructField("treated", T.IntegerType())])


def table(spark, n=150, width=25, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = sorted(rng.sample(range(width), rng.randint(0, 8)))
        values = [rng.choice([0.1, 0.2, 0.25, rng.random() + 0.01]) for _ in at]
        y = int(sum(v for a, v in zip(at, values) if a % 3 == 0) + rng.random() * 0.4 > 0.6)
        rows.append((i, SparseVector(width, at, values), y))
    return spark.createDataFrame(rows, SCHEMA).cache()


def scored(model, df):
    p = vector_to_array("probability")[1]
    return {r["id"]: (round(r["p"], 9), r["prediction"]) for r in model.transform(df).select("id", p.alias("p"), "prediction").collect()}


@pytest.mark.parametrize("depth", [3, 30])
def test_tree_is_that_of_sparks_learner(spark, depth):
    df = table(spark)
    want = DecisionTreeClassifier(labelCol="treated", maxDepth=depth, seed=42).fit(df)
    assert scored(SparseTree(depth=depth).fit(df), df) == scored(want, df)


def test_first_stump_is_that_of_sparks_learner(spark):
    df = table(spark, seed=7)
    want = DecisionTreeClassifier(labelCol="treated", maxDepth=1, seed=42).fit(df)
    got, expected = scored(BoostedStumps(rounds=1).fit(df), df), scored(want, df)
    for i in got:  # one stump's vote: odds of half the log odds, doubled
        assert got[i][0] == pytest.approx(expected[i][0], abs=1e-6) and got[i][1] == expected[i][1]


def test_columns_that_no_row_fills_cost_nothing(spark):
    """A row of an array over all columns would be 400 MB here."""
    rows = [(i, SparseVector(100_000_000, [i % 7, 99_999_990 + i % 2], [0.5, 0.5]), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    for estimator in (SparseTree(depth=3), BoostedStumps(rounds=2)):
        out = estimator.fit(df).transform(df)
        assert out.filter(F.col("prediction") != F.col("treated")).count() == 0


def test_filled_columns_below_zero_stay_with_sparks_learner(spark):
    rows = [(i, SparseVector(2, [0, 1], [-1.0 - i, 1.0]), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert scored(SparseTree(depth=4).fit(df), df) == scored(DecisionTreeClassifier(labelCol="treated", maxDepth=4, seed=42).fit(df), df)


def test_a_missing_label_is_an_error(spark):
    df = spark.createDataFrame([(1, SparseVector(2, [0], [1.0]), 1), (2, SparseVector(2, [1], [1.0]), None)], SCHEMA)
    for estimator in (SparseTree(depth=2), BoostedStumps(rounds=2)):
        with pytest.raises(Exception, match="labels must not be null"):
            estimator.fit(df)


def test_boosting_is_that_of_sparks_learner(spark):
    df = table(spark, n=120, seed=11)
    want = scored(GBTClassifier(labelCol="treated", maxIter=6, maxDepth=3, stepSize=0.1, seed=42).fit(df), df)
    got = scored(SparseBoosting(rounds=6).fit(df), df)
    for i in want:
        assert got[i][0] == pytest.approx(want[i][0], abs=1e-6) and got[i][1] == want[i][1]


def test_forest_tells_classes_apart_as_sparks_learner(spark):
    df, other = table(spark, n=400, seed=5), table(spark, n=300, seed=6)
    want = RandomForestClassifier(labelCol="treated", numTrees=40, featureSubsetStrategy="sqrt", maxDepth=30, seed=42).fit(df)
    labels = {r["id"]: r["treated"] for r in other.collect()}

    def right(model):
        return sum(p == labels[i] for i, (_, p) in scored(model, other).items()) / len(labels)

    forest = SparseForest(trees=40).fit(df)
    assert right(forest) > right(want) - 0.06
    assert len({tuple(t["feature"]) for t in json.loads(forest.getOrDefault(forest.state))}) > 30


def test_forest_and_boosting_over_columns_that_no_row_fills(spark):
    rows = [(i, SparseVector(100_000_000, [i % 7, 99_999_990 + i % 2], [0.5, 0.5]), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = SparseBoosting(rounds=2).fit(df).transform(df)
    assert out.filter(F.col("prediction") != F.col("treated")).count() == 0
    assert SparseForest(trees=3).fit(df).transform(df).count() == 40


def test_level_over_many_blocks_is_that_of_one(spark):
    df = table(spark, n=200, seed=12)
    rows, _ = trees.binned(df, "features", "treated")
    whole, cut = trees.packed(rows.coalesce(1)), trees.packed(rows.repartition(5))
    assert whole.count() >= 1 and cut.count() > 1
    found = [trees.grow(b, 4)[0] for b in (whole, cut)]
    assert found[0].feature == found[1].feature and found[0].cut == found[1].cut and found[0].total == found[1].total


@pytest.mark.parametrize("kind", ["boosting", "stumps", "tree"])
def test_a_level_is_one_pass_and_exchanges_no_sums(spark, monkeypatch, kind):
    """Trees over blocks of columns; rounds do not place rows by all trees so far, as they did."""
    passes, plain = [], trees.Columns._best
    monkeypatch.setattr(trees.Columns, "_best", lambda self, *a: passes.append(1) or plain(self, *a))
    monkeypatch.setattr(trees, "COLUMN_BLOCK", 40)
    for name in ("place", "grow_level", "roots"):
        monkeypatch.setattr(trees, name, None)
    df = table(spark, n=120, seed=11).repartition(3)
    est = {"boosting": SparseBoosting(rounds=5), "stumps": BoostedStumps(rounds=4), "tree": SparseTree(depth=6)}[kind]
    model = est.fit(df)
    rounds = json.loads(model.getOrDefault(model.state))
    assert 1 <= len(passes) <= {"boosting": 15, "stumps": 4, "tree": 6}[kind] and rounds
    assert model.transform(df).filter(F.col("prediction") == F.col("treated")).count() > 80


def test_trees_by_columns_are_those_by_rows(spark):
    df = table(spark, n=300, seed=13)
    held = trees.Columns(df, "features", "treated")
    tree, node = held.grow(5, "gini", 1 - held.label, held.label)
    rows, _ = trees.binned(df, "features", "treated")
    other, = trees.grow(trees.packed(rows), 5)
    tree.prune()
    assert tree.feature == other.feature and tree.cut == other.cut and tree.total == other.total
    held.unpersist()
    assert all(tree.total[n][0] == (node == n).sum() for n in set(node.tolist()))


def test_nodes_are_sent_in_few_bytes(spark):
    """Routes of a training pass had 32 bytes a node, nodes of the model 48."""
    df = table(spark, n=300, seed=13)
    state, = json.loads((model := SparseTree(depth=8).fit(df)).getOrDefault(model.state))
    n = len(state["feature"])
    assert n > 40 and sum(x.nbytes for x in trees._sent(state, 2)) <= 25 * n
    tree = trees.Tree((4.0, 2.0, 2.0), "gini")
    tree.extend([(0, 40_000_000, 31, 2.0, 1.0, 1.0)], False)
    arrays, _ = tree.routes()
    assert sum(x.nbytes for x in arrays) == 9 * len(tree.total) and [int(x[0]) for x in arrays] == [40_000_000, 31, 1]
