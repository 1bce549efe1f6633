"""Pipeline fitting that keeps costly intermediate columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Normalizer
from pyspark.sql import DataFrame

from docketry.models.features import TermGrams
from docketry.models.kernel import NystroemMap


def fit_in_order(stages: Sequence, df: DataFrame) -> PipelineModel:
    """Fit like a pipeline, storing tokens, vectors and kernel features once.

    A plain pipeline would tokenize and stem again for every estimator that
    follows. The stored copies may spill to disk and are dropped at the end.
    """
    data, fitted, held = df, [], []
    try:
        for i, stage in enumerate(stages):
            model = stage if isinstance(stage, Transformer) else stage.fit(data)
            fitted.append(model)
            if i + 1 < len(stages):
                data = model.transform(data)
                if isinstance(stage, (TermGrams, Normalizer, NystroemMap)):
                    data = data.persist(StorageLevel.MEMORY_AND_DISK)
                    held.append(data)
    finally:
        for frame in held:
            frame.unpersist()
    return PipelineModel(fitted)
