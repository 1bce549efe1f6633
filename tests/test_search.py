"""The batched margin solver and the random search built on it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.functions.claims import uniform_from_hash
from docketry.models import margins
from docketry.models import search
from docketry.models.features import tfidf_stages
from docketry.models.fitting import fit_in_order
from docketry.models.calibration import CalibratedLinearSvc
from docketry.models.kernel import NystroemMap, kernel_values
from docketry.models.kernel_svc import KernelSvc


def objective(p, x, y, point, width):
    k = kernel_values(x @ x.T, (x**2).sum(1), p.norms, p.kernel, p.gamma, p.degree, p.coef0)
    z = y * (k @ point[:-1] + point[-1])
    loss = np.where(z < 1 - width, 1 - z, np.where(z <= 1 + width, (1 + width - z) ** 2 / (4 * width), 0.0))
    return 0.5 * point[:-1] @ p.gram @ point[:-1] + p.C * loss.sum()


def test_solver_reaches_the_minimum(spark):
    """All rows are landmarks: no random move from the result lowers the objective; labels are learnt."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = np.where(x[:, 0] * x[:, 1] + 0.1 * rng.normal(size=90) > 0, 1.0, -1.0)
    x, norms = x.astype(np.float32).astype(float), None
    norms, dots = (x**2).sum(1), x @ x.T
    rows = [(float(t > 0), i % 3, np.append(d, s).astype(np.float32).tobytes()) for i, (t, d, s) in enumerate(zip(y, dots, norms))]
    df = spark.createDataFrame(rows, "label double, fold int, dots binary").repartition(4).cache()
    kinds = [("rbf", 0.5, 1, 0.0, 1.0), ("poly", 0.3, 2, 0.1, 10.0), ("poly", 1.0, 1, 0.0, 0.1), ("rbf", 0.5, 1, 0.0, 1000.0)]
    problems = [margins.MarginProblem(-1, k, g, d, c0, c, kernel_values(dots, norms, norms, k, g, d, c0), norms, 90)
                for k, g, d, c0, c in kinds]
    margins.fit_margins(df, problems, 1, 90)
    for p in problems:
        assert p.done
        low = objective(p, x, y, p.base, margins.WIDTHS[-1])
        assert low == pytest.approx(p.value, rel=1e-3)
        for _ in range(200):
            move = rng.normal(size=91) * 10.0 ** rng.uniform(-6, -1)
            # rows told apart without loss at a large C: steps get short there, and the fit ends within some percent
            slack = 0.1 if p.C == 1000.0 else 1e-3
            assert objective(p, x, y, p.base + move, margins.WIDTHS[-1]) >= low * (1 - slack)
    k = kernel_values(dots, norms, norms, *kinds[3][:4])
    assert ((k @ problems[3].base[:-1] + problems[3].base[-1] > 0) == (y > 0)).mean() > 0.95


@pytest.fixture(scope="module")
def train(spark):
    draw = random.Random(5)
    common = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    topic = {0: ["gear", "wheel", "axle", "shaft"], 1: ["price", "order", "credit", "market"]}
    rows = []
    for i in range(150):
        words = draw.choices(common, k=10) + draw.choices(topic[i % 2], k=2) + draw.choices(topic[1 - i % 2], k=1)
        draw.shuffle(words)
        rows.append((i, " ".join(words), i % 2))
    return spark.createDataFrame(rows, "app_id long, claim_text string, treated int").cache()


GRID = {"max_n": [1, 2], "max_df": [0.9], "min_df": [0, 4], "tokenizer": ["custom"], "use_idf": [True, False],
        "C": [1.0, 10.0], "kernel": ["linear", "poly", "rbf"], "degree": [2], "coef0": [0.1]}


def test_search_equals_single_fits(train):
    """With every text a landmark, accuracies are those of features and classifiers fitted one by one."""
    got = {r["draw"]: r for r in search.random_search(train, n_iter=2, folds=2, grid=GRID, landmarks=200).collect()}
    folded = train.withColumn("fold", F.floor(uniform_from_hash(42, "app_id", F.col("claim_text")) * 2).cast("int")).cache()
    for i, s in enumerate(search.draw_settings(GRID, 2)):
        rates = []
        for fold in range(2):
            inside = folded.filter(F.col("fold") != fold)
            text = {k: s[k] for k in search.TEXT_KEYS["tfidf"]} | {"min_df": max(1, s["min_df"])}
            vectors = fit_in_order(tfidf_stages(**text), inside)
            kind = {"kernel": "poly", "degree": 1, "coef0": 0.0, "gamma": 1.0} if s["kernel"] == "linear" else {
                "kernel": s["kernel"], "degree": s["degree"], "coef0": s["coef0"]}
            stages = [NystroemMap(landmarks=200, **kind), CalibratedLinearSvc(featuresCol="kernel_features", C=s["C"], folds=0)]
            data = vectors.transform(folded).select("features", "treated", "fold")
            model = fit_in_order(stages, data.filter(F.col("fold") != fold))
            hit = (F.col("prediction") == F.col("treated")).cast("double")
            rates.append(model.transform(data.filter(F.col("fold") == fold)).agg(F.avg(hit)).first()[0])
        assert got[i]["mean_test_score"] == pytest.approx(sum(rates) / 2, abs=0.025), s


def test_term_rows_equal_pipeline_features(train):
    """A fold's masked and weighted terms are the vectors of the pipeline fitted without the fold."""
    folded = train.select("claim_text", F.col("treated").cast("double").alias("label"), (F.col("app_id") % 3).cast("int").alias("fold"))
    rows = search.TermRows(folded, "custom", 2, 3, 20, 1)
    setting = {"max_n": 2, "max_df": 0.5, "min_df": 3, "use_idf": True}
    inside = folded.filter("fold <> 1")
    vectors = fit_in_order(tfidf_stages(tokenizer="custom", max_n=2, max_df=0.5, min_df=3), inside)
    assert rows.widths([setting])[2, 0.5, 3, 1] == len(vectors.stages[1].vocabulary)
    assert rows.sizes[1] == inside.count()
    held = rows.rows.orderBy("id").collect()
    flat = search.flat_terms({c: [r[c] for r in held] for c in ("term", "n", "tf", "outside")}, 3)
    row, _, weight = search.weighted_terms(flat, rows.sizes, setting)[1]
    got = sorted(tuple(sorted(np.round(weight[row == i], 9))) for i in range(len(held)))
    want = sorted(tuple(sorted(np.round(r[0].values, 9))) for r in vectors.transform(folded).select("features").collect())
    assert got == want


def test_packed_products_are_those_of_the_terms(train):
    """Products with the landmarks come from bytes, and are those of the weighted terms; also for rows without terms."""
    empty = train.limit(1).select(F.lit(999).cast("long").alias("app_id"), F.lit(None).cast("string").alias("claim_text"), "treated")
    folded = train.union(empty).select("claim_text", F.col("treated").cast("double").alias("label"),
                                       (F.col("app_id") % 3).cast("int").alias("fold"))
    rows = search.TermRows(folded, "custom", 2, 3, 20, 1)
    assert dict(rows.packed.dtypes)["outside"] == "binary" and rows.packed.count() == 151
    held = rows.rows.orderBy("id").collect()
    flat = search.flat_terms({c: [r[c] for r in held] for c in ("term", "n", "tf", "outside")}, 3)
    for setting in ({"max_n": 2, "max_df": 0.5, "min_df": 3, "use_idf": True}, {"max_n": 1, "max_df": 0.9, "min_df": 0, "use_idf": False}):
        dots, grams, norms = rows.dots(setting)
        got = np.array([np.append(np.frombuffer(r["dots"], np.float32), r["total"]) for r in dots.collect()])
        want = np.zeros((151, 3, rows.m + 1), np.float32)
        total = np.zeros((151, 3))
        for f, (row, term, weight) in enumerate(search.weighted_terms(flat, rows.sizes, setting)):
            marked = search.weighted_terms(search.flat_terms(rows.landmarks[f], 3), rows.sizes, setting)[f]
            x, z = ({(r, t): w for r, t, w in zip(*part)} for part in ((row, term, weight), marked))
            for (r, t), w in x.items():
                want[r, f, :-1] += [w * z.get((j, t), 0.0) for j in range(rows.m)]
                want[r, f, -1], total[r, f] = 1, total[r, f] + w
            assert np.allclose(np.diag(grams[f]), norms[f])
        want = np.concatenate([want.reshape(151, -1), total], axis=1)
        assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0), atol=1e-5)


def test_fits_in_memory_are_the_batched_ones():
    """Losses first and curvature from a corner that moves lead where a full sum at every step leads."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).astype(np.float32).astype(float)
    y = np.where(x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=300) > 0, 1.0, -1.0)
    norms, dots = (x[:40]**2).sum(1), np.append(x @ x[:40].T, (x**2).sum(1)[:, None], axis=1)
    inside = 220
    for kind in [("rbf", 0.5, 1, 0.0, 1.0), ("poly", 0.3, 2, 0.1, 10.0), ("poly", 1.0, 1, 0.0, 0.1)]:
        gram = kernel_values(dots[:40, :40], norms, norms, *kind[:4])
        one, other = (margins.MarginProblem(0, *kind, gram, norms, inside) for _ in range(2))
        k = margins._kernel_with_one(dots, norms, *kind[:4])
        margins.solve(one, k, y, inside, k[:inside].T @ k[:inside])
        while not other.done:
            other.advance(margins._row_sums(k, y, np.arange(300) >= inside, margins.WIDTHS[other.narrowed], other.base,
                                            other.direction, other.step))
        assert one.held_out == other.held_out and one.held_out[1] == 80
        assert one.value == pytest.approx(other.value, rel=1e-9) and np.allclose(one.base, other.base, atol=1e-6)


def test_classifiers_of_one_kernel_share_its_values(monkeypatch):
    """A batch's kernel values are computed once for the classifier of all rows and those of the folds; sums are each one's own."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    norms, dots = (x[:20].astype(float)**2).sum(1), np.append(x @ x[:20].T, (x**2).sum(1)[:, None], axis=1).astype(np.float32)
    y, folds = np.where(x[:, 0] > 0, 1.0, -1.0), np.arange(60) % 3
    gram = kernel_values(x[:20].astype(float) @ x[:20].T, norms, norms, "rbf", 0.5, 1, 0.0)
    problems = [margins.MarginProblem(f, "rbf", 0.5, 1, 0.0, 1.0, gram, norms, 40) for f in (-1, 0, 1, 2)]
    for p in problems:
        p.base, p.direction = rng.normal(size=(2, 21))
    batch = pa.RecordBatch.from_pydict({"label": y * 0.5 + 0.5, "fold": pa.array(folds, pa.int32()),
                                        "dots": pa.array([d.tobytes() for d in dots], pa.binary())})
    calls, plain = [], margins._kernel_with_one
    monkeypatch.setattr(margins, "_kernel_with_one", lambda *a: calls.append(1) or plain(*a))
    out = next(margins._sums(list(enumerate(p.spec() for p in problems)), 1, 20)([batch])).to_pydict()
    assert len(calls) == 1 and out["problem"] == [0, 1, 2, 3]
    k = plain(dots, norms, "rbf", 0.5, 1, 0.0)
    for p, stats in zip(problems, out["stats"]):
        assert np.allclose(stats, margins._row_sums(k, y, folds == p.fold, margins.WIDTHS[0], p.base, p.direction, p.step))
        own = k[folds != p.fold]
        assert np.allclose(stats[2 + len(margins.STEPS):][:21], margins._slopes(
            y[folds != p.fold] * (own @ (p.base + p.direction)), y[folds != p.fold], margins.WIDTHS[0])[0] @ own)


def test_more_rows_than_a_group_are_all_fitted(train, monkeypatch):
    """Rows that stay in their tasks lead to the accuracies of those that meet in one group."""
    one = {r["draw"]: r["mean_test_score"] for r in search.random_search(train, n_iter=3, folds=2, grid=GRID, landmarks=16).collect()}
    monkeypatch.setattr(margins, "GROUP_ROWS", 20)
    monkeypatch.setattr(search, "KEPT", 1 << 30)
    other = {r["draw"]: r["mean_test_score"] for r in search.random_search(train, n_iter=3, folds=2, grid=GRID, landmarks=16).collect()}
    assert other == pytest.approx(one, abs=0.014) and len(one) == 3


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    """There were 20,000 rows at most before."""
    rows = spark.range(20_100).selectExpr("id app_id", "concat('gear', id % 7, ' price', id % 3, ' ', id) claim_text", "cast(id % 7 > 3 as int) treated")
    seen, plain = [], search.held_out_hits
    monkeypatch.setattr(search, "held_out_hits", lambda *a: seen.append(plain(*a)) or seen[-1])
    grid = {k: v[:1] for k, v in GRID.items()} | {"kernel": ["linear"]}
    assert search.random_search(rows, n_iter=1, folds=2, grid=grid, landmarks=8).count() == 1
    assert sum(held for _, held in seen[0].values()) == 20_100


def test_vector_search(train):
    grid = {"size": [8], "min_count": [1], "epochs": [3], "C": [1.0, 10.0], "kernel": ["rbf", "linear"], "degree": [2], "coef0": [0.0]}
    out = search.random_search(train, "doc_vectors", n_iter=3, folds=2, grid=grid, landmarks=40).collect()
    assert [r["rank_test_score"] for r in out] == [1, 2, 3] and all(0.3 < r["mean_test_score"] <= 1 for r in out)


def test_kernel_svc_equals_margin_on_mapped_features(train):
    """One batch for the classifier and its folds gives the labels and, nearly, the probabilities of separate fits."""
    data = fit_in_order(tfidf_stages(tokenizer="words", max_n=1, min_df=2, max_df=0.9), train).transform(train).cache()
    got = KernelSvc(kernel="rbf", landmarks=200).fit(data).transform(data)
    stages = [NystroemMap(kernel="rbf", landmarks=200), CalibratedLinearSvc(featuresCol="kernel_features")]
    want = fit_in_order(stages, data).transform(data)
    got, want = ({r["app_id"]: (r["prediction"], r["probability"][1]) for r in x.collect()} for x in (got, want))
    assert np.mean([got[k][0] == want[k][0] for k in got]) > 0.97
    assert np.mean([abs(got[k][1] - want[k][1]) for k in got]) < 0.05


def test_leverage_leaves_out_less_than_hash(train):
    """The kernel error in the model is the one of the dense kernel, and lower than that of hash landmarks."""
    data = fit_in_order(tfidf_stages(tokenizer="words", max_n=1, min_df=2, max_df=0.9), train).transform(train).cache()
    x = np.array([r["features"].toArray() for r in data.collect()])
    errors = {}
    for choice in ("hash", "leverage"):
        model = NystroemMap(kernel="rbf", landmarks=20, choice=choice).fit(data)
        errors[choice] = model.getOrDefault(model.kernelError)
        phi = np.array([r["kernel_features"].toArray() for r in model.transform(data).collect()])
        assert errors[choice] == pytest.approx(1 - (phi**2).sum() / len(x), abs=1e-6)
    assert 0 < errors["leverage"] < errors["hash"]
