"""Linear classifier with modified Huber loss (Zhang, 2004), full-batch gradient steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.features import sparse_columns

BLOCK_ROWS = 4096
COLUMNS = 1 << 16  # summed in one group
PULLS = "part int, at binary, g binary"


def loss_slope(margin: np.ndarray) -> np.ndarray:
    """Derivative of max(0, 1 - m)^2 for m >= -1, else -4m."""
    return np.where(margin >= 1, 0.0, np.where(margin >= -1, -2 * (1 - margin), -4.0))


def packed(dataset: DataFrame, features: str, label: str) -> DataFrame:
    """Rows as blocks of plain arrays, laid out once for all steps."""
    rows = sparse_columns(dataset, features).select("_idx", "_val", (2 * F.col(label) - 1).cast("double").alias("_y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(low, BLOCK_ROWS)
                idx = b.column("_idx").flatten().to_numpy().astype(np.int32)
                arrays = (b.column("_y").to_numpy(zero_copy_only=False), b.column("_idx").value_lengths().to_numpy().astype(np.int64),
                          idx, b.column("_val").flatten().to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.num_rows], pa.int64()), pa.array([int(idx.max()) if len(idx) else None], pa.int64()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=["n", "top", "y", "lengths", "idx", "val"])

    return rows.mapInArrow(pack, "n long, top long, y binary, lengths binary, idx binary, val binary")


def _pulls(point):
    """A task's gradient at ``point``, in ranges of columns; part -1 is the constant's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = point.value
        grad, grad_b = np.zeros(len(weights)), 0.0
        for b in batches:
            for arrays in zip(*(b.column(c).to_pylist() for c in ("y", "lengths", "idx", "val"))):
                y, lengths, col, val = (np.frombuffer(x, t) for x, t in zip(arrays, (float, np.int64, np.int32, float)))
                owner = np.repeat(np.arange(len(y)), lengths)
                score = np.bincount(owner, val * weights[col], minlength=len(y)) + bias
                pull = loss_slope(y * score) * y
                grad += np.bincount(col, val * pull[owner], minlength=len(weights))
                grad_b += pull.sum()
        at = np.flatnonzero(grad)
        cuts = np.searchsorted(at, np.arange(COLUMNS, len(weights), COLUMNS))
        found = [(int(part[0]) // COLUMNS, part, grad[part]) for part in np.split(at, cuts) if len(part)]
        found.append((-1, np.zeros(1, np.int64), np.array([grad_b])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int32()), *[pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (1, 2)]],
            names=["part", "at", "g"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sums of one range over all tasks; a task's sum that is no number, from a missing label, counts only where no other is."""
    at, g = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("at", np.int64), ("g", float)))
    low, known = int(at.min()), ~np.isnan(g)
    total = np.bincount(at - low, np.where(known, g, 0.0))
    total[(np.bincount(at - low) > 0) & (np.bincount(at - low, known) == 0)] = np.nan
    return pa.table([table.column("part").slice(0, 1), pa.array([np.arange(low, low + len(total)).tobytes()], pa.binary()),
                     pa.array([total.tobytes()], pa.binary())], names=["part", "at", "g"])


class ModifiedHuber(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    alpha = Param(Params._dummy(), "alpha", "L2 penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "gradient steps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", alpha=1e-4, maxIter=100):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", alpha=1e-4, maxIter=100)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ModifiedHuberModel:
        rows = packed(dataset, self.getFeaturesCol(), self.getLabelCol()).persist(StorageLevel.MEMORY_AND_DISK)
        alpha = self.getOrDefault(self.alpha)
        sc = dataset.sparkSession.sparkContext
        try:
            head = rows.agg(F.sum("n").alias("n"), F.max("top").alias("top")).first()
            n, width = head["n"] or 0, (head["top"] if head["top"] is not None else -1) + 1
            w, b, velocity, velocity_b = np.zeros(width), 0.0, np.zeros(width), 0.0
            # Rows have unit length (plus the constant), curvature of the loss is 2.
            step, momentum = 1.0 / (2 * 2.0 + alpha), 0.9
            for _ in range(self.getOrDefault(self.maxIter)):
                ahead, ahead_b = w + momentum * velocity, b + momentum * velocity_b
                point = sc.broadcast((ahead, ahead_b))

                sums = rows.mapInArrow(_pulls(point), PULLS).groupBy("part").applyInArrow(_added, PULLS)
                grad, grad_b = np.zeros(width), 0.0
                for r in sums.collect():  # one number per vocabulary entry, COLUMNS of them in a row
                    at, g = np.frombuffer(r["at"], np.int64), np.frombuffer(r["g"])
                    if r["part"] < 0:
                        grad_b = float(np.nansum(g))
                    else:
                        grad[at] = g
                velocity = momentum * velocity - step * (grad / n + alpha * ahead)
                velocity_b = momentum * velocity_b - step * grad_b / n
                w, b = w + velocity, b + velocity_b
                point.unpersist()
        finally:
            rows.unpersist()
        return ModifiedHuberModel(featuresCol=self.getFeaturesCol(), weights=w.tolist(), bias=float(b))


class ModifiedHuberModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", weights=None, bias=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", bias=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.feature import ElementwiseProduct
        from pyspark.ml.linalg import DenseVector

        scaled = ElementwiseProduct(
            scalingVec=DenseVector(self.getOrDefault(self.weights)), inputCol=self.getFeaturesCol(), outputCol="_wx"
        ).transform(dataset)
        margin = F.aggregate(
            F.unwrap_udt("_wx")["values"], F.lit(self.getOrDefault(self.bias)), lambda a, x: a + x
        )
        p = (F.least(F.greatest(F.col("_margin"), F.lit(-1.0)), F.lit(1.0)) + 1) / 2
        return (
            scaled.withColumn("_margin", margin)
            .withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (F.col("_margin") > 0).cast("double"))
            .drop("_wx", "_margin")
        )
