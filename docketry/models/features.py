"""Text to unit TF-IDF vectors as savable pipeline stages."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer, Word2Vec
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import tokens as tk
from docketry.functions.porter import stem_tokens, stop_words_with_stems

ALL_TERMS = (1 << 31) - 1  # the counting stage asks for a size; every term within the document bounds is kept
TOKENS_A_TASK = 600_000  # that train word vectors one after the other
TOKENIZERS = ("default", "default_unstemmed", "custom", "custom_parity", "words")


def token_column(name: str, text):
    """Tokenizers by name.

    ``default``: clean, stop, stem. ``custom``: words over two characters,
    stemmed, stop words dropped (``custom_parity`` keeps them). ``words``:
    every word of two or more characters.
    """
    if name == "default":
        return stem_tokens(tk.clean_tokens(text))
    if name == "default_unstemmed":
        return tk.clean_tokens(text)
    if name in ("custom", "custom_parity"):
        stops = stop_words_with_stems(tk.english_stop_words())
        return tk.without_stop_words(stem_tokens(tk.plain_tokens(text)), stops, parity=name == "custom_parity")
    if name == "words":
        return tk.word_tokens(text)
    raise ValueError(f"unknown tokenizer {name!r}; one of {TOKENIZERS}")


class TermGrams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text column to an array of n-grams."""

    tokenizer = Param(Params._dummy(), "tokenizer", "name of the tokenizer", TypeConverters.toString)
    maxN = Param(Params._dummy(), "maxN", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, tokenizer="default", maxN=2):
        super().__init__()
        self._setDefault(tokenizer="default", maxN=2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, n = self.getOutputCol(), self.getOrDefault(self.maxN)
        text = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        tokens = token_column(self.getOrDefault(self.tokenizer), text)
        if n == 1:
            return dataset.withColumn(out, tokens)
        held = dataset.withColumn(out, tokens)  # tokens first, so each row is stemmed once
        return held.withColumn(out, tk.ngrams(F.col(out), 1, n))


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Scales counts by ln((1 + n) / (1 + df)) + 1; the fitted stage is a plain elementwise product."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        # One number a column reaches the driver, not one array over all columns from every task.
        vec = F.unwrap_udt(F.col(self.getInputCol()))
        filled = F.filter(F.arrays_zip(vec["indices"].alias("i"), vec["values"].alias("v")), lambda e: e["v"] > 0)
        head = dataset.agg(F.count(F.lit(1)).alias("n"), F.max(vec["size"]).alias("width")).first()
        per = dataset.select(F.explode(filled["i"]).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df"))
        found = per.toPandas()
        df = np.zeros(head["width"] or 0)
        df[found["i"].to_numpy(int)] = found["df"].to_numpy(float)
        idf = np.log((head["n"] + 1.0) / (df + 1.0))
        return ElementwiseProduct(
            scalingVec=DenseVector(1.0 + idf), inputCol=self.getInputCol(), outputCol=self.getOutputCol()
        )


class WordVectors(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Word vectors trained by as many tasks as the tokens ask for; Spark's own default is one task, whatever their number."""

    size = Param(Params._dummy(), "size", "length of a vector", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "fewest occurrences of a word", TypeConverters.toInt)
    epochs = Param(Params._dummy(), "epochs", "passes over the texts", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=300, minCount=10, epochs=5, seed=42):
        super().__init__()
        self._setDefault(size=300, minCount=10, epochs=5, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> Model:
        tokens = dataset.agg(F.sum(F.size(self.getInputCol()).cast("long"))).first()[0] or 0
        return Word2Vec(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), vectorSize=self.getOrDefault(self.size),
            minCount=self.getOrDefault(self.minCount), maxIter=self.getOrDefault(self.epochs),
            seed=self.getOrDefault(self.seed), numPartitions=max(1, -(-tokens // TOKENS_A_TASK)),
        ).fit(dataset)


class PriorShift(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces the smoothed class priors of a naive Bayes stage by plain class shares."""

    shifts = Param(Params._dummy(), "shifts", "added to the raw scores", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, shifts=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        s0, s1 = self.getOrDefault(self.shifts)
        raw = vector_to_array("rawPrediction")
        r0, r1 = raw[0] + F.lit(s0), raw[1] + F.lit(s1)
        return (
            dataset.withColumn("_raw", F.array(r0, r1))
            .withColumn("_p1", 1 / (1 + F.exp(F.col("_raw")[0] - F.col("_raw")[1])))
            .withColumn("rawPrediction", array_to_vector("_raw"))
            .withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1"))))
            .withColumn("prediction", (F.col("_raw")[1] > F.col("_raw")[0]).cast("double"))
            .drop("_raw", "_p1")
        )


def tfidf_stages(
    text: str = "claim_text",
    output: str = "features",
    tokenizer: str = "default",
    max_n: int = 2,
    min_df: float = 10.0,
    max_df: float = 0.5,
    use_idf: bool = True,
) -> list:
    """Stages text -> n-grams -> counts -> smooth TF-IDF -> unit length."""
    stages = [
        TermGrams(inputCol=text, outputCol="_terms", tokenizer=tokenizer, maxN=max_n),
        CountVectorizer(
            inputCol="_terms", outputCol="_counts", minDF=float(min_df), maxDF=float(max_df), vocabSize=ALL_TERMS
        ),
    ]
    if use_idf:
        stages.append(SmoothIdf(inputCol="_counts", outputCol="_tfidf"))
    stages.append(Normalizer(p=2.0, inputCol="_tfidf" if use_idf else "_counts", outputCol=output))
    return stages


def doc_vector_stages(
    text: str = "claim_text", output: str = "features", size: int = 300, min_count: int = 10, epochs: int = 5,
    seed: int = 42,
) -> list:
    """Averaged word vectors of unit length.

    Fills the role of trained paragraph vectors; it is a different model.
    """
    return [
        TermGrams(inputCol=text, outputCol="_terms", tokenizer="default", maxN=1),
        WordVectors(inputCol="_terms", outputCol="_docvec", size=size, minCount=min_count, epochs=epochs, seed=seed),
        Normalizer(p=2.0, inputCol="_docvec", outputCol=output),
    ]


def sparse_columns(df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``_idx`` and ``_val``: positions and values of the non-zero entries."""
    raw = df.withColumn("_vec", F.unwrap_udt(F.col(features)))
    dense = F.col("_vec.type") == 1
    values = F.col("_vec.values")
    return raw.withColumns({
        "_idx": F.when(dense, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.col("_vec.indices")),
        "_val": values,
    }).drop("_vec")


__all__ = [
    "PriorShift", "SmoothIdf", "TermGrams", "Vectors", "doc_vector_stages", "sparse_columns",
    "tfidf_stages", "token_column",
]
