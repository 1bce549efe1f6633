"""Classifiers by name and the comparison of all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.boosting import BoostedStumps, SparseBoosting
from docketry.models.calibration import DEPTH, CalibratedLinearSvc
from docketry.models.features import PriorShift, doc_vector_stages, tfidf_stages
from docketry.models.fitting import fit_in_order
from docketry.models.huber import ModifiedHuber
from docketry.models.kernel_svc import KernelSvc
from docketry.models.neighbours import NeighbourVote
from docketry.models.threads import side_by_side
from docketry.models.trees import SparseForest, SparseTree
from docketry.operators import evaluation as ev

LABEL = "treated"
COMPARISON_COLUMNS = [
    ("Model Name", "string"), ("Precision Score", "double"), ("Recall Score", "double"), ("F1 Score", "double"),
    ("Accuracy Score", "double"), ("MCC", "double"),
]


class MultinomialBayes(Estimator):
    """Naive Bayes with smoothed term shares and plain class shares."""

    def __init__(self, label: str = LABEL, smoothing: float = 1.0):
        super().__init__()
        self.label, self.smoothing = label, smoothing

    def copy(self, extra=None):
        return MultinomialBayes(self.label, self.smoothing)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        import math

        model = NaiveBayes(featuresCol="features", labelCol=self.label, smoothing=self.smoothing,
                           modelType="multinomial").fit(dataset)
        sizes = {int(r[0]): r[1] for r in dataset.groupBy(self.label).count().collect()}
        total = sum(sizes.values())
        shifts = [math.log(sizes[c] / total) - float(model.pi[c]) for c in (0, 1)]
        return PipelineModel([model, PriorShift(shifts=shifts)])


def kernel_svc(kernel: str, n_landmarks: int = 256, **kwargs) -> list:
    return [KernelSvc(featuresCol="features", labelCol=LABEL, kernel=kernel, landmarks=n_landmarks, **kwargs)]


# Name -> (number of training rows) -> stages. With n rows, C maps to regParam 1 / (C n).
REGISTRY: dict[str, Callable[..., list]] = {
    "logistic_regression": lambda n, C=1.0: [LogisticRegression(
        featuresCol="features", labelCol=LABEL, regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
        tol=1e-4, aggregationDepth=DEPTH)],
    "naive_bayes": lambda n: [MultinomialBayes()],
    "svc_rbf": lambda n, **kw: kernel_svc("rbf", **kw),
    "svc_poly2": lambda n, **kw: kernel_svc("poly", degree=2, **kw),
    "svc_linear": lambda n, C=1.0: [CalibratedLinearSvc(featuresCol="features", labelCol=LABEL, C=C)],
    "decision_tree": lambda n, depth=30: [SparseTree(featuresCol="features", labelCol=LABEL, depth=depth)],
    "random_forest": lambda n, trees=100, depth=30: [SparseForest(
        featuresCol="features", labelCol=LABEL, trees=trees, depth=depth)],
    "k_neighbors": lambda n, k=5: [NeighbourVote(featuresCol="features", labelCol=LABEL, k=k)],
    "sgd_hinge": lambda n: [LinearSVC(
        featuresCol="features", labelCol=LABEL, regParam=1e-4, standardization=False, aggregationDepth=DEPTH)],
    "sgd_modified_huber": lambda n, steps=100: [ModifiedHuber(featuresCol="features", labelCol=LABEL, maxIter=steps)],
    "adaboost": lambda n, rounds=50: [BoostedStumps(featuresCol="features", labelCol=LABEL, rounds=rounds)],
    "gradient_boosting": lambda n, rounds=100: [SparseBoosting(
        featuresCol="features", labelCol=LABEL, rounds=rounds)],
}


def stages_for(name_or_estimator: str | Estimator, n: int, **kwargs) -> list:
    if isinstance(name_or_estimator, Estimator):
        return [name_or_estimator]
    if name_or_estimator not in REGISTRY:
        raise ValueError(f"unknown classifier {name_or_estimator!r}; one of {sorted(REGISTRY)}")
    return REGISTRY[name_or_estimator](n, **kwargs)


def fit_classifier(
    name: str | Estimator, train: DataFrame, features: str = "tfidf", feature_args: dict | None = None, **kwargs
) -> PipelineModel:
    """Fit text features and a classifier on (claim_text, treated)."""
    make = {"tfidf": tfidf_stages, "doc_vectors": doc_vector_stages}[features]
    n = train.count()
    return fit_in_order([*make(**(feature_args or {})), *stages_for(name, n, **kwargs)], train)


def predict(model, df: DataFrame) -> DataFrame:
    """Append ``margin``, ``0``, ``1`` (where the model gives them) and ``predicted_label``.

    Label and probability are independent outputs: the label is the model's own
    decision and never derived from the probability.
    """
    scored = model.transform(df)
    out = scored
    if "rawPrediction" in scored.columns:
        out = out.withColumn("margin", vector_to_array("rawPrediction")[1])
    if "probability" in scored.columns:
        out = out.withColumns({"0": vector_to_array("probability")[0], "1": vector_to_array("probability")[1]})
    out = out.withColumn("predicted_label", F.col("prediction").cast("int"))
    added = [c for c in ("margin", "0", "1", "predicted_label") if c in out.columns]
    return out.select(*df.columns, *[f"`{c}`" for c in added])


def compare_models(
    train: DataFrame, test: DataFrame, names: list[str] | None = None, feature_args: dict | None = None,
    model_args: dict[str, dict] | None = None,
) -> DataFrame:
    """One row of scores per classifier. Features are fitted and computed once for all of them."""
    names = names or list(REGISTRY)
    vectors = fit_in_order(tfidf_stages(**(feature_args or {})), train)
    fit_on = vectors.transform(train).select("features", LABEL).persist()
    held = vectors.transform(test).select("features", LABEL).persist()
    n = fit_on.count()

    def one_row(name: str) -> tuple:
        stages = stages_for(name, n, **(model_args or {}).get(name, {}))
        for stage in stages:
            if isinstance(stage, (CalibratedLinearSvc, KernelSvc)):
                stage.set(stage.folds, 0)  # the scores use labels, which need no calibration
        model = fit_in_order(stages, fit_on)
        counts = ev.confusion_counts(model.transform(held), LABEL, "prediction")
        return (name, *ev.scores(counts).first())  # five scores

    try:
        rows = side_by_side(train.sparkSession, one_row, names, threads=4)
    finally:
        fit_on.unpersist()
        held.unpersist()
    columns = ", ".join(f"`{c}` {kind}" for c, kind in COMPARISON_COLUMNS)
    return ev.rank_models(train.sparkSession.createDataFrame(rows, columns))
