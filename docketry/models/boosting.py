"""AdaBoost over depth-one trees (SAMME.R for two classes; Zhu et al., 2009) and gradient boosting."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.models.trees import Columns, SparseTreesModel, Tree, any_negative, cuts_of
from docketry.session import materialize

CLIP = 2.2e-16


def half_log_odds(probability: str) -> Column:
    """0.5 * ln(p1 / p0) with clipped probabilities."""
    p = vector_to_array(probability)
    p1 = F.greatest(p[1], F.lit(CLIP))
    p0 = F.greatest(p[0], F.lit(CLIP))
    return 0.5 * F.log(p1 / p0)


class BoostedStumps(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    rounds = Param(Params._dummy(), "rounds", "number of stumps", TypeConverters.toInt)
    checkpointEvery = Param(Params._dummy(), "checkpointEvery", "rounds between lineage cuts", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", rounds=50, checkpointEvery=10):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", rounds=50, checkpointEvery=10)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        if any_negative(dataset, self.getFeaturesCol()):
            return self._fit_filled(dataset)
        columns, trees = Columns(dataset, self.getFeaturesCol(), self.getLabelCol()), []

        def vote(tree: Tree, node: int) -> float:
            w0, w1 = tree.total[node][1:]
            return 0.5 * math.log(max(w1 / (w0 + w1), CLIP) / max(w0 / (w0 + w1), CLIP))

        try:
            label, margin = columns.label, np.zeros(len(columns.label))
            for _ in range(self.getOrDefault(self.rounds)):
                w = np.exp(-(2 * label - 1) * margin)
                tree, node = columns.grow(1, "gini", w * (1 - label), w * label)
                tree.prune()
                if tree.feature[0] < 0:
                    break
                trees.append(tree)
                margin += np.array([vote(tree, node) for node in range(len(tree.total))])[node]
        finally:
            columns.unpersist()
        known = cuts_of(columns.cuts, trees)
        held = [t.state(known, lambda node, t=t: [vote(t, node)]) for t in trees]
        return SparseTreesModel(featuresCol=self.getFeaturesCol(), kind="vote", state=json.dumps(held))

    def _fit_filled(self, dataset: DataFrame) -> PipelineModel:
        """Stumps of Spark's learner, for few columns that are all filled."""
        features, label = self.getFeaturesCol(), self.getLabelCol()
        sign = 2 * F.col(label) - 1
        # The margin alone carries the state: weight = exp(-y * margin).
        state = materialize(
            dataset.select(features, F.col(label).cast("double").alias(label)).withColumn("_m", F.lit(0.0))
        )
        stumps = []
        for i in range(self.getOrDefault(self.rounds)):
            weighted = state.withColumn("_w", F.exp(-sign * F.col("_m")))
            stump = DecisionTreeClassifier(
                featuresCol=features, labelCol=label, weightCol="_w", maxDepth=1, predictionCol=f"_s{i}",
                rawPredictionCol=f"_r{i}", probabilityCol=f"_b{i}", minWeightFractionPerNode=0.0,
            ).fit(weighted)
            if stump.numNodes == 1:
                break
            stumps.append(stump)
            state = stump.transform(state).withColumn("_m", F.col("_m") + half_log_odds(f"_b{i}")).select(
                features, label, "_m"
            )
            if (i + 1) % self.getOrDefault(self.checkpointEvery) == 0:
                state = materialize(state)
        return PipelineModel([*stumps, StumpVote(rounds=len(stumps))])


class SparseBoosting(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosting of regression trees by logistic loss (Friedman, 2001), with the steps of Spark's learner."""

    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "weight of every tree but the first", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", rounds=100, depth=3, rate=0.1):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", rounds=100, depth=3, rate=0.1)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        rounds, depth, rate = (self.getOrDefault(x) for x in (self.rounds, self.depth, self.rate))
        if any_negative(dataset, self.getFeaturesCol()):
            return GBTClassifier(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), maxIter=rounds,
                                 maxDepth=depth, stepSize=rate, seed=42).fit(dataset)
        columns, trees = Columns(dataset, self.getFeaturesCol(), self.getLabelCol()), []

        def vote(tree: Tree, node: int) -> float:
            return (rate if tree is not trees[0] else 1.0) * tree.total[node][1] / max(tree.total[node][0], 1.0)

        try:
            y, margin = 2 * columns.label - 1, np.zeros(len(columns.label))
            for _ in range(rounds):
                target = 4 * y / (1 + np.exp(np.minimum(2 * y * margin, 700.0))) if trees else y
                tree, node = columns.grow(depth, "variance", target, target * target)
                trees.append(tree)
                margin += np.array([vote(tree, node) for node in range(len(tree.total))])[node]
        finally:
            columns.unpersist()
        known = cuts_of(columns.cuts, trees)
        held = [t.state(known, lambda node, t=t: [vote(t, node)]) for t in trees]
        return SparseTreesModel(featuresCol=self.getFeaturesCol(), kind="boosted", state=json.dumps(held))


class StumpVote(Model, DefaultParamsReadable, DefaultParamsWritable):
    rounds = Param(Params._dummy(), "rounds", "number of stumps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, rounds=0):
        super().__init__()
        self._setDefault(rounds=0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.rounds)
        margin = F.lit(0.0)
        for i in range(n):
            margin = margin + half_log_odds(f"_b{i}")
        p = 1 / (1 + F.exp(-2 * F.col("_margin") / F.lit(float(max(n, 1)))))
        return (
            dataset.withColumn("_margin", margin)
            .withColumn("_p", p)
            .withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
            .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
            .withColumn("prediction", (F.col("_margin") > 0).cast("double"))
            .drop("_margin", "_p", *[f"_{c}{i}" for i in range(n) for c in "srb"])
        )
