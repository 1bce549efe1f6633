"""Term statistics in long form: one row per (document, term) or (label, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.porter import stem_word
from docketry.functions.tokens import word_tokens
from docketry.session import materialize, written


def explode_terms(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(tokens).alias("term"))


def term_counts(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """Occurrences per (keys, term); counted map-side before the shuffle."""
    return explode_terms(df, tokens, *keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """Number of documents per term. Terms are made unique inside the row, so nothing is deduplicated by shuffle."""
    return (
        explode_terms(df, F.array_distinct(tokens))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def bounded_vocabulary(frequencies: DataFrame, n_docs: int, min_df: int = 10, max_df: float = 0.5) -> DataFrame:
    """Terms of at least ``min_df`` documents and at most the share ``max_df``."""
    return frequencies.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))


def stem_counts(counts: DataFrame, value: str = "tf", *keys: str) -> DataFrame:
    """Counts of stems; only distinct terms are stemmed, since ``counts`` is aggregated already."""
    return (
        counts.withColumn("term", stem_word(F.col("term")))
        .groupBy(*keys, "term")
        .agg(F.sum(value).alias(value))
    )


def tfidf(
    df: DataFrame, tokens: Column, key: str, min_df: int = 10, max_df: float = 0.5, use_idf: bool = True
) -> DataFrame:
    """Smooth TF-IDF with unit rows: tf * (ln((1 + n) / (1 + df)) + 1), L2 per document.

    The length of a row is a window over the terms of one document, which is
    bounded by its text. ``key`` identifies a document.
    """
    n_docs = df.count()
    counts = written(term_counts(df, tokens, key), "term-counts")  # texts are cut once; all that follows reads counts
    frequencies = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = bounded_vocabulary(frequencies, n_docs, min_df, max_df)
    if use_idf:
        idf = F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1
    else:
        idf = F.lit(1.0)
    raw = counts.join(vocabulary.select("term", idf.alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", (F.col("w") / norm).alias("weight"))


def differential_terms(df: DataFrame, label: str, text: str, stop_words: list[str]) -> DataFrame:
    """Term contrast of two corpora.

    Counts per corpus are scaled to unit length; the difference is split into a
    treated and a control side, each scaled to unit length again.
    """
    counts = term_counts(df.select(label, text), word_tokens(text), label).filter(~F.col("term").isin(stop_words))
    # Written once: the lengths below read the counts again, not the texts.
    both = materialize(counts.groupBy("term").agg(
        F.sum(F.when(F.col(label) == 1, F.col("tf")).otherwise(0)).alias("treated_count"),
        F.sum(F.when(F.col(label) == 0, F.col("tf")).otherwise(0)).alias("control_count"),
    ))

    def square_sum(c: Column) -> Column:
        return F.sqrt(F.sum(c * c))

    t, c = F.col("treated_count").cast("double"), F.col("control_count").cast("double")
    lengths = both.agg(square_sum(t).alias("lt"), square_sum(c).alias("lc"))
    scaled = both.withColumn(
        "difference", t / lengths.select("lt").scalar() - c / lengths.select("lc").scalar()
    )
    up, down = F.greatest(F.col("difference"), F.lit(0.0)), F.greatest(-F.col("difference"), F.lit(0.0))
    sides = scaled.agg(square_sum(up).alias("lu"), square_sum(down).alias("ld"))
    return scaled.select(
        "term", "treated_count", "control_count", "difference",
        (up / sides.select("lu").scalar()).alias("treated_weight"),
        (down / sides.select("ld").scalar()).alias("control_weight"),
    )
