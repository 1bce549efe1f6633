"""Kernel margin classifier over landmark rows, its calibration folds fitted along with it."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.calibration import PlattModel, fold_of
from docketry.models.features import sparse_columns
from docketry.models.kernel import LandmarkIndex, NystroemMap, kernel_values
from docketry.models.margins import MarginProblem, fit_margins

ROWS_AT_ONCE = 2_000


class _KernelSvcParams(HasFeaturesCol, HasLabelCol):
    kernel = Param(Params._dummy(), "kernel", "poly or rbf", TypeConverters.toString)
    degree = Param(Params._dummy(), "degree", "degree of the polynomial", TypeConverters.toInt)
    coef0 = Param(Params._dummy(), "coef0", "constant of the polynomial", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width, 0 = scale", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "inverse regularisation", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "number of landmark rows", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds for calibration, 0 = none", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


class KernelSvc(Estimator, _KernelSvcParams, DefaultParamsReadable, DefaultParamsWritable):
    """Label from the margin's sign, probability from out-of-fold margins (Platt).

    The classifier of all rows and those of the calibration folds are one batch
    of ``margins.fit_margins``: they share the rows' landmark products.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", kernel="poly", degree=2, coef0=0.0, gamma=0.0,
                 C=1.0, landmarks=256, folds=5, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", kernel="poly", degree=2, coef0=0.0, gamma=0.0,
                         C=1.0, landmarks=256, folds=5, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        p = {name: self.getOrDefault(getattr(self, name))
             for name in ("kernel", "degree", "coef0", "gamma", "C", "landmarks", "folds", "seed")}
        features, label = self.getFeaturesCol(), self.getLabelCol()
        chosen = NystroemMap(inputCol=features, kernel=p["kernel"], degree=p["degree"], coef0=p["coef0"], gamma=p["gamma"],
                             landmarks=p["landmarks"], seed=p["seed"]).fit(dataset)
        state = json.loads(chosen.getOrDefault(chosen.state))
        idx = [np.array(i, dtype=np.int64) for i in state["idx"]]
        val = [np.array(v) for v in state["val"]]
        index, norms, m = LandmarkIndex(idx, val, often=True), np.array([v @ v for v in val]), len(idx)
        kernel = (p["kernel"], state["gamma"], p["degree"], p["coef0"])
        gram = kernel_values(index.dots(idx, val), norms, norms, *kernel)
        sent = dataset.sparkSession.sparkContext.broadcast(index)  # ``landmarks`` rows

        @F.pandas_udf("binary")
        def products(ix: pd.Series, vx: pd.Series) -> pd.Series:
            out = []
            for start in range(0, len(ix), ROWS_AT_ONCE):
                i = [np.asarray(a) for a in ix.iloc[start:start + ROWS_AT_ONCE]]
                v = [np.asarray(a, dtype=float) for a in vx.iloc[start:start + ROWS_AT_ONCE]]
                squares = np.array([[a @ a] for a in v])
                rows = np.concatenate([sent.value.dots(i, v), squares], axis=1).astype(np.float32)
                out += [r.tobytes() for r in rows]
            return pd.Series(out, dtype=object)

        slim = dataset.select(F.col(features), F.col(label).cast("double").alias("label"),
                              fold_of(features, max(p["folds"], 1), p["seed"]).alias("fold"))
        rows = sparse_columns(slim, features).select("label", "fold", products("_idx", "_val").alias("dots"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sizes = {(r["fold"], r["label"]): r["n"] for r in
                     rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds x labels
            n = sum(sizes.values())
            inside = {f: n - sum(c for (k, _), c in sizes.items() if k == f) for f in range(p["folds"] if p["folds"] > 1 else 0)}
            usable = [f for f, c in inside.items() if c < n and len({y for (k, y) in sizes if k != f}) == 2]
            problems = [MarginProblem(f, *kernel, p["C"], gram, norms, inside.get(f, n)) for f in [-1, *usable]]
            fit_margins(rows, problems, 1, m)
            slope, intercept = 1.0, 0.0
            if usable:
                points = {x.fold: x.base for x in problems[1:]}

                @F.pandas_udf("double")
                def held_out(fold: pd.Series, dots: pd.Series) -> pd.Series:
                    d = np.frombuffer(b"".join(dots), np.float32).reshape(len(dots), m + 1).astype(float)
                    k = kernel_values(d[:, :-1], d[:, -1], norms, *kernel)
                    out = np.full(len(fold), np.nan)
                    for f, point in points.items():
                        own = (fold == f).to_numpy()
                        out[own] = k[own] @ point[:-1] + point[-1]
                    return pd.Series(out)

                margins = rows.select("label", held_out("fold", "dots").alias("m")).filter(~F.isnan("m"))
                platt = LogisticRegression(featuresCol="mv", labelCol="label", regParam=0.0, standardization=False).fit(
                    margins.select(array_to_vector(F.array("m")).alias("mv"), "label"))
                slope, intercept = float(platt.coefficients[0]), float(platt.intercept)
        finally:
            rows.unpersist()
        state |= {"point": problems[0].base.tolist()}
        del state["root"]
        margin = KernelMarginModel(featuresCol=features, kernel=p["kernel"], degree=p["degree"], coef0=p["coef0"],
                                   gamma=state["gamma"], state=json.dumps(state), kernelError=chosen.getOrDefault(chosen.kernelError))
        return PipelineModel([margin, PlattModel(slope=slope, intercept=intercept)])


class KernelMarginModel(Model, _KernelSvcParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` and ``prediction``; a task is sent the landmark rows and one weight for each."""

    state = Param(Params._dummy(), "state", "landmark rows and weights", TypeConverters.toString)
    kernelError = Param(Params._dummy(), "kernelError", "share of the training rows' kernel left out", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=None, kernel=None, degree=None, coef0=None, gamma=None, state=None, kernelError=None):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        idx = [np.array(i, dtype=np.int64) for i in state["idx"]]
        val = [np.array(v) for v in state["val"]]
        norms, point = np.array([v @ v for v in val]), np.array(state["point"])
        kernel = tuple(self.getOrDefault(x) for x in (self.kernel, self.gamma, self.degree, self.coef0))
        sent = dataset.sparkSession.sparkContext.broadcast(LandmarkIndex(idx, val, often=True))

        @F.pandas_udf("double")
        def margin(ix: pd.Series, vx: pd.Series) -> pd.Series:
            out = []
            for start in range(0, len(ix), ROWS_AT_ONCE):
                i = [np.asarray(a) for a in ix.iloc[start:start + ROWS_AT_ONCE]]
                v = [np.asarray(a, dtype=float) for a in vx.iloc[start:start + ROWS_AT_ONCE]]
                k = kernel_values(sent.value.dots(i, v), np.array([a @ a for a in v]), norms, *kernel)
                out.append(k @ point[:-1] + point[-1])
            return pd.Series(np.concatenate(out) if out else np.zeros(0))

        held = sparse_columns(dataset, self.getFeaturesCol()).withColumn("_margin", margin("_idx", "_val"))
        return held.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin")))).withColumn(
            "prediction", (F.col("_margin") > 0).cast("double")).drop("_idx", "_val", "_margin")
