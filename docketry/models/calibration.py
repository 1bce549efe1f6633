"""Margins and their probabilities (Platt scaling on out-of-fold margins)."""

from __future__ import annotations

import warnings

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.threads import side_by_side


COLUMNS_AT_ONCE = 600_000  # of all fits that run beside each other: a solver keeps some twenty arrays over the columns
DEPTH = 6  # of the sums over tasks, so that a few arrays over the columns reach the driver and not one for each of many tasks


def fits_at_once(df: DataFrame, features: str) -> int:
    """How many linear fits may share the driver's memory, six at most."""
    head = df.select(features).first()
    return max(1, min(6, COLUMNS_AT_ONCE // max(head[0].size, 1))) if head and head[0] is not None else 6


def fold_of(df: DataFrame, folds: int, seed: int):
    """Fold number from row content, so it does not depend on partitioning."""
    vec = F.unwrap_udt(F.col(df))
    return F.pmod(F.xxhash64(F.lit(seed), vec["indices"], vec["values"]), F.lit(folds)).cast("int")


class _SvcParams(HasFeaturesCol, HasLabelCol):
    C = Param(Params._dummy(), "C", "inverse regularisation; regParam = 1 / (C n)", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "bound on iterations; a fit that reaches it warns", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds for calibration, 0 = none", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


class CalibratedLinearSvc(Estimator, _SvcParams, DefaultParamsReadable, DefaultParamsWritable):
    """Linear margin classifier; label from the margin's sign, probability from calibration."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", C=1.0, maxIter=200, folds=5, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", C=1.0, maxIter=200, folds=5, seed=42)
        self._set(**self._input_kwargs)

    def _svc(self, n: int) -> LinearSVC:
        return LinearSVC(
            featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), standardization=False,
            regParam=1.0 / (self.getOrDefault(self.C) * max(n, 1)), maxIter=self.getOrDefault(self.maxIter), tol=1e-4,
            aggregationDepth=DEPTH,
        )

    def _fit(self, dataset: DataFrame) -> PlattModel:
        label, folds, seed = self.getLabelCol(), self.getOrDefault(self.folds), self.getOrDefault(self.seed)
        data = dataset.select(
            self.getFeaturesCol(), F.col(label).cast("double").alias(label),
            fold_of(self.getFeaturesCol(), max(folds, 1), seed).alias("_fold"),
        ).persist()
        try:
            sizes = {(r["_fold"], r[label]): r["n"] for r in
                     data.groupBy("_fold", label).agg(F.count(F.lit(1)).alias("n")).collect()}
            n = sum(sizes.values())
            inside = {k: sum(c for (f, _), c in sizes.items() if f != k) for k in range(folds if folds > 1 else 0)}
            usable = [
                k for k, c in inside.items() if c < n and len({y for (f, y) in sizes if f != k}) == 2
            ]

            def fit(k):
                """Fold k left out; None fits on all rows."""
                if k is None:
                    return self._svc(n).fit(data)
                return self._svc(inside[k]).fit(data.filter(F.col("_fold") != k))

            svc, *left_out = side_by_side(
                dataset.sparkSession, fit, [None, *usable], fits_at_once(data, self.getFeaturesCol()))
            if svc.summary().totalIterations >= self.getOrDefault(self.maxIter):
                warnings.warn("the margin solver stopped at maxIter before it converged", stacklevel=2)
            slope, intercept = 1.0, 0.0
            if usable:
                parts = [
                    m.transform(data.filter(F.col("_fold") == k)).select(
                        F.array(vector_to_array("rawPrediction")[1]).alias("m"), F.col(label)
                    )
                    for k, m in zip(usable, left_out)
                ]
                margins = parts[0]
                for part in parts[1:]:
                    margins = margins.union(part)
                platt = LogisticRegression(featuresCol="mv", labelCol=label, regParam=0.0, standardization=False)
                fitted = platt.fit(margins.select(array_to_vector("m").alias("mv"), label))
                slope, intercept = float(fitted.coefficients[0]), float(fitted.intercept)
        finally:
            data.unpersist()
        calibrate = PlattModel(slope=slope, intercept=intercept)
        return PipelineModel([svc, calibrate])


class PlattModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` to a ``rawPrediction`` column; the label stays with the margin."""

    slope = Param(Params._dummy(), "slope", "slope", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, slope=1.0, intercept=0.0):
        super().__init__()
        self._setDefault(slope=1.0, intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = vector_to_array("rawPrediction")[1]
        z = F.lit(self.getOrDefault(self.slope)) * margin + F.lit(self.getOrDefault(self.intercept))
        return (
            dataset.withColumn("_p", 1 / (1 + F.exp(-z)))
            .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
            .drop("_p")
        )
