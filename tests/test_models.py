"""Features and classifiers on a small two-topic corpus."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.models import classifiers as mc
from docketry.models import huber
from docketry.models import neighbours as nb
from docketry.models.calibration import PlattModel
from docketry.models.features import tfidf_stages
from docketry.models.fitting import fit_in_order
from docketry.models.huber import loss_slope
from docketry.models.kernel import LandmarkIndex, NystroemMap, kernel_values
from docketry.models.search import TFIDF_GRID, draw_settings, random_search
from docketry.operators import explain as ex

ARGS = {"tokenizer": "words", "max_n": 1, "min_df": 2.0, "max_df": 0.9}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    common = [f"word{i}" for i in range(30)]
    topic = {0: [f"gear{i}" for i in range(12)], 1: [f"price{i}" for i in range(12)]}
    rows = []
    for i in range(160):
        y = i % 2
        words = rng.choices(common, k=12) + rng.choices(topic[y], k=4) + rng.choices(topic[1 - y], k=1)
        rng.shuffle(words)
        rows.append((i, " ".join(words), y))
    df = spark.createDataFrame(rows, "app_id long, claim_text string, treated int").cache()
    return rows, df, df.filter("app_id < 120"), df.filter("app_id >= 120")


def dense(df):
    out = df.orderBy("app_id").select(vector_to_array("features")).collect()
    return np.array([r[0] for r in out])


def test_tfidf_equals_formula(corpus):
    rows, df, _, _ = corpus
    model = fit_in_order(tfidf_stages(**ARGS), df)
    got, vocabulary = dense(model.transform(df)), model.stages[1].vocabulary
    docs = [t.split() for _, t, _ in rows]
    n = len(docs)
    freq = {w: sum(w in d for d in docs) for w in vocabulary}
    assert all(2 <= f <= 0.9 * n for f in freq.values())
    want = np.array([[d.count(w) * (math.log((1 + n) / (1 + freq[w])) + 1) for w in vocabulary] for d in docs])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("name, args", [
    ("logistic_regression", {}), ("naive_bayes", {}), ("svc_linear", {}), ("svc_poly2", {"n_landmarks": 100}),
    ("svc_rbf", {"n_landmarks": 100}), ("decision_tree", {"depth": 6}), ("random_forest", {"trees": 20, "depth": 6}),
    ("sgd_hinge", {}), ("sgd_modified_huber", {"steps": 20}), ("adaboost", {"rounds": 6}),
    ("gradient_boosting", {"rounds": 6}),
])
def test_classifier_learns_and_survives_saving(corpus, tmp_path, name, args):
    _, _, train, test = corpus
    model = mc.fit_classifier(name, train, feature_args=ARGS, **args)
    out = mc.predict(model, test)
    accuracy = out.agg(F.avg((F.col("predicted_label") == F.col("treated")).cast("double"))).first()[0]
    assert accuracy > (0.6 if "tree" in name or "boost" in name or name == "random_forest" else 0.85)
    if "1" in out.columns:
        assert out.filter((F.abs(F.col("0") + F.col("1") - 1) > 1e-9) | (F.col("1") < 0)).count() == 0
    if name in ("svc_poly2", "adaboost", "naive_bayes", "sgd_modified_huber"):
        model.write().overwrite().save(str(tmp_path / name))
        again = mc.predict(PipelineModel.load(str(tmp_path / name)), test)
        key = "app_id"
        assert [r.predicted_label for r in again.orderBy(key).collect()] == [
            r.predicted_label for r in out.orderBy(key).collect()
        ]


def test_scores_do_not_depend_on_partitioning(corpus):
    _, _, train, test = corpus
    model = mc.fit_classifier("svc_poly2", train, feature_args=ARGS, n_landmarks=60)
    one = {r.app_id: (r["1"], r.predicted_label) for r in mc.predict(model, test.coalesce(1)).collect()}
    many = {r.app_id: (r["1"], r.predicted_label) for r in mc.predict(model, test.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(abs(one[k][0] - many[k][0]) < 1e-12 for k in one)


@pytest.mark.parametrize("kernel", ["poly", "rbf"])
def test_kernel_map_is_exact_with_all_rows_as_landmarks(corpus, kernel):
    _, df, _, _ = corpus
    data = fit_in_order(tfidf_stages(**ARGS), df).transform(df)
    x = dense(data)
    model = NystroemMap(kernel=kernel, landmarks=200).fit(data)
    gamma = 1 / (x.shape[1] * x.var())
    assert model.getOrDefault(model.gamma) == pytest.approx(gamma, rel=1e-9)
    phi = np.array([r[0] for r in model.transform(data).orderBy("app_id")
                    .select(vector_to_array("kernel_features")).collect()])
    sq = (x * x).sum(axis=1)
    assert np.allclose(phi @ phi.T, kernel_values(x @ x.T, sq, sq, kernel, gamma, 2, 0.0), atol=1e-6)


def test_landmark_index_dots():
    rng = np.random.default_rng(0)
    a, b = (rng.random((5, 9)) * (rng.random((5, 9)) < 0.4) for _ in range(2))
    split = lambda m: ([np.flatnonzero(r) for r in m], [r[np.flatnonzero(r)] for r in m])
    assert np.allclose(LandmarkIndex(*split(b)).dots(*split(a)), a @ b.T)


def test_frequent_columns_are_multiplied_as_a_matrix():
    rng = np.random.default_rng(1)
    a, b = (rng.random((k, 30)) * (rng.random((k, 30)) < np.linspace(0, 1, 30)) for k in (40, 25))
    split = lambda m: ([np.flatnonzero(r) for r in m], [r[np.flatnonzero(r)] for r in m])
    index = LandmarkIndex(*split(b), often=True)
    assert 0 < len(index.table) < 30 and np.allclose(index.dots(*split(a)), a @ b.T)
    far = [i - 7 for i in split(b)[0]], split(b)[1]  # columns below zero are found by search
    assert np.allclose(LandmarkIndex(*far, often=True).dots([i - 7 for i in split(a)[0]], split(a)[1]), a @ b.T)


def test_label_follows_margin_not_probability(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([-0.2, 0.2]), 1.0)], ["rawPrediction", "prediction"])
    row = PlattModel(slope=1.0, intercept=-1.0).transform(df).select(
        "prediction", vector_to_array("probability")[1].alias("p")).first()
    assert row["prediction"] == 1.0 and row["p"] < 0.5


def test_nearest_equals_brute_force(corpus):
    rows, df, train, test = corpus
    vectors = fit_in_order(tfidf_stages(**ARGS), train)
    near = nb.nearest(vectors.transform(train), vectors.transform(test), "app_id", "treated", k=5)
    got = {}
    for r in near.orderBy("app_id", "rank").collect():
        got.setdefault(r["app_id"], []).append(r["neighbour"])
    sims = np.round(dense(vectors.transform(test)) @ dense(vectors.transform(train)).T, 6)
    for i, row in enumerate(sims):
        assert got[120 + i] == sorted(range(120), key=lambda j: (-row[j], j))[:5]


def test_modified_huber_slope():
    m = np.array([-3.0, -1.0, 0.0, 0.5, 1.0, 2.0])
    assert loss_slope(m).tolist() == [-4.0, -4.0, -2.0, -1.0, 0.0, 0.0]


def test_random_search(corpus):
    _, _, train, _ = corpus
    settings = draw_settings(TFIDF_GRID, 50)
    assert len({tuple(s.items()) for s in settings}) == 50
    grid = {"max_n": [1], "max_df": [0.9], "min_df": [2], "tokenizer": ["custom"], "use_idf": [True, False],
            "C": [1.0], "kernel": ["linear"], "degree": [2], "coef0": [0.0]}
    out = random_search(train, n_iter=5, folds=2, grid=grid).collect()
    assert [r.rank_test_score for r in out] == [1, 2] and out[0].mean_test_score >= out[1].mean_test_score > 0.7


def test_explanation_finds_topic_words(corpus):
    _, df, train, _ = corpus
    model = mc.fit_classifier("logistic_regression", train, feature_args=ARGS)
    raw = ex.explain(df, model, "app_id", size=6, masks=300, words=5).cache()
    rows = raw.collect()
    assert len({r.app_id for r in rows}) == 6 and all(r.error is None for r in rows)
    signed = [r.weight > 0 for r in rows if r.word.startswith("price")]
    against = [r.weight < 0 for r in rows if r.word.startswith("gear")]
    assert sum(signed) + sum(against) >= 0.9 * (len(signed) + len(against)) and len(signed) + len(against) > 15
    again = ex.explain(df.repartition(3), model, "app_id", size=6, masks=300, words=5).collect()
    key = lambda r: (r.app_id, r.word, round(r.weight, 9))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    agg = ex.aggregate_words(raw)
    assert ex.top_words(agg, True).filter("mean <= 0").count() == 0


def test_word_without_letters_is_no_failure(spark, corpus):
    _, _, train, _ = corpus
    model = mc.fit_classifier("logistic_regression", train, feature_args=ARGS)
    odd = spark.createDataFrame([(1, "price1 gear2"), (2, "..."), (3, None)], "app_id long, claim_text string")
    out = ex.explain(odd, model, "app_id", size=10, masks=40).collect()
    assert {r.app_id for r in out} == {1}


def test_modified_huber_sums_meet_in_ranges_of_columns(spark):
    """Steps as in plain numpy; what a step sends to the driver are a few rows, not one for each column."""
    rng = np.random.default_rng(5)
    wide, held = huber.COLUMNS + 40, []
    for i in range(60):
        at = sorted({int(x) for x in rng.choice([*range(20), *range(wide - 20, wide)], 6)})
        held.append((SparseVector(wide, at, rng.random(len(at)).tolist()), i % 2))
    df = spark.createDataFrame(
        held, T.StructType([T.StructField("features", VectorUDT()), T.StructField("treated", T.IntegerType())]))
    x, y = np.array([v.toArray() for v, _ in held]), np.array([2.0 * t - 1 for _, t in held])
    w, b, velocity, velocity_b, alpha = np.zeros(wide), 0.0, np.zeros(wide), 0.0, 1e-4
    for _ in range(5):
        ahead, ahead_b = w + 0.9 * velocity, b + 0.9 * velocity_b
        pull = huber.loss_slope(y * (x @ ahead + ahead_b)) * y
        step = 1.0 / (4.0 + alpha)
        velocity = 0.9 * velocity - step * (x.T @ pull / len(y) + alpha * ahead)
        velocity_b = 0.9 * velocity_b - step * pull.sum() / len(y)
        w, b = w + velocity, b + velocity_b
    model = huber.ModifiedHuber(maxIter=5).fit(df)
    got = np.array(model.getOrDefault(model.weights))
    assert np.allclose(got, w[:len(got)], atol=1e-12) and not w[len(got):].any()
    assert model.getOrDefault(model.bias) == pytest.approx(b, abs=1e-12)
    point = spark.sparkContext.broadcast((np.zeros(wide), 0.0))
    rows = huber.packed(df, "features", "treated")
    parts = [r["part"] for r in rows.mapInArrow(huber._pulls(point), huber.PULLS).groupBy("part").applyInArrow(
        huber._added, huber.PULLS).collect()]
    assert sorted(parts) == [-1, 0, 1]


def test_modified_huber_sums_without_a_number_give_way():
    rows = [(np.array([3, 4, 6]), np.array([np.nan, 1.0, np.nan])), (np.array([3, 6]), np.array([2.0, np.nan]))]
    table = pa.table({"part": pa.array([0, 0], pa.int32()), "at": [a.astype(np.int64).tobytes() for a, _ in rows],
                      "g": [g.tobytes() for _, g in rows]})
    out = huber._added(table)
    assert np.frombuffer(out["at"][0].as_py(), np.int64).tolist() == [3, 4, 5, 6]
    assert np.array_equal(np.frombuffer(out["g"][0].as_py()), [2.0, 1.0, 0.0, np.nan], equal_nan=True)
