"""Reproducible samples: every draw is a function of a key, not of row order."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.ranking import ROWS_TO_RANK, at_most, rank_threshold, smallest_n


def weighted_without_replacement(
    df: DataFrame, n: int, weight: str, u: Column, tie: str | Sequence[str], rows_per_block: int = ROWS_TO_RANK
) -> DataFrame:
    """Draw n rows with chance proportional to weight (Efraimidis and Spirakis, 2006).

    Row key -ln(u)/w; the n smallest are kept. ``tie`` names numeric columns
    that together identify a row.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    keyed = df.filter(F.col(weight) > 0).withColumn("_key", -F.log(u) / F.col(weight))
    return smallest_n(keyed, ["_key", *ties], n, rows_per_block=rows_per_block).drop("_key")


def uniform_sample(df: DataFrame, n: int, u: Column, tie: str, rows_per_block: int = ROWS_TO_RANK) -> DataFrame:
    """n rows by smallest u, or all rows when there are no more than n."""
    keyed = df.withColumn("_key", u)
    total = keyed.count()
    if total <= n:
        return df
    return smallest_n(keyed, ["_key", tie], n, total, rows_per_block).drop("_key")


def stratified_split(
    df: DataFrame,
    label: str,
    u: Column,
    tie: str,
    fraction: float = 0.15,
    labels: Sequence[int] = (0, 1),
    rows_per_block: int = ROWS_TO_RANK,
) -> DataFrame:
    """Add ``is_test``: per label, the ceil(fraction * n) rows of smallest u.

    One threshold per label; the split itself is a filter, no label is sorted
    in one task.
    """
    keyed = df.withColumn("_key", u)
    sizes = {r[label]: r["n"] for r in keyed.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    test = F.lit(False)
    for value in labels:
        size = sizes.get(value, 0)
        if not size:
            continue
        # 1e-9 guards against 0.15 * 20 = 3.0000000000000004
        n = math.ceil(fraction * size - 1e-9)
        bound = rank_threshold(keyed.filter(F.col(label) == value), ["_key", tie], n, size, rows_per_block)
        if bound is not None:
            test = test | ((F.col(label) == value) & at_most(keyed, ["_key", tie], bound))
    return keyed.withColumn("is_test", test.cast("int")).drop("_key")


def weighted_with_replacement(
    df: DataFrame,
    n: int,
    weight: str,
    key: str,
    seed: int = 42,
    rows_per_bucket: int = 100_000,
    draws_per_slice: int = 100_000,
) -> DataFrame:
    """Draw n rows with replacement, chance proportional to weight.

    Rows lie on a line, each as long as its weight; draws are points on it. The
    line is cut into hash buckets of rows, a heavy bucket further into slices of
    equal length, so neither a heavy row nor a heavy bucket ends up in one task.
    Inside a slice, points find their row by one ordered window. Draws of a row
    are counted and expanded last. ``key`` must be unique.
    """
    rows = df.filter(F.col(weight) > 0)
    size = rows.count()
    if size == 0:
        raise ValueError("nothing to draw from")
    spark = df.sparkSession
    buckets = min(1 << 16, max(1, math.ceil(size / rows_per_bucket)))
    placed = rows.select(
        F.col(key).alias("_id"),
        F.col(weight).cast("double").alias("_w"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    totals = placed.groupBy("_bucket").agg(F.sum("_w").alias("w")).orderBy("_bucket").collect()  # 65,536 at most
    ids = np.array([r["_bucket"] for r in totals])
    ends = np.cumsum([r["w"] for r in totals])
    starts, whole = np.concatenate([[0.0], ends[:-1]]), float(ends[-1])
    widths = ends - starts
    slices = np.maximum(1, np.ceil(n * widths / whole / draws_per_slice)).astype(int)

    @F.pandas_udf("struct<bucket int, slice int, pos double>")
    def locate(t: pd.Series) -> pd.DataFrame:
        at = np.minimum(np.searchsorted(ends, t.to_numpy(), side="right"), len(ends) - 1)
        pos = np.minimum(t.to_numpy() - starts[at], np.nextafter(widths[at], 0))
        return pd.DataFrame({
            "bucket": ids[at].astype("int32"),
            "slice": np.minimum((pos / widths[at] * slices[at]).astype("int32"), slices[at] - 1).astype("int32"),
            "pos": pos,
        })

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("id")), 11).cast("double") + 0.5) / float(2**53)
    points = spark.range(n).select(locate(u * F.lit(whole)).alias("p")).select(
        F.col("p.bucket").alias("_bucket"), F.col("p.slice").alias("_slice"), F.col("p.pos").alias("_pos"),
        F.lit(None).cast(df.schema[key].dataType).alias("_id"), F.lit(1).alias("_kind"),
    )
    w = Window.partitionBy("_bucket").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    cuts = spark.createDataFrame(
        [(int(b), float(x), int(s)) for b, x, s in zip(ids, widths, slices)], "_bucket int, _width double, _slices int"
    )
    lines = (
        placed.withColumn("_end", F.sum("_w").over(w))
        .withColumn("_begin", F.col("_end") - F.col("_w"))
        .join(F.broadcast(cuts), "_bucket")  # 65,536 rows at most
        .withColumn("_lo", F.least(F.floor(F.col("_begin") / F.col("_width") * F.col("_slices")), F.col("_slices") - 1))
        .withColumn("_hi", F.least(F.floor(F.col("_end") / F.col("_width") * F.col("_slices")), F.col("_slices") - 1))
        .withColumn("_slice", F.explode(F.sequence(F.greatest(F.col("_lo"), F.lit(0)), F.col("_hi"))))
        .select("_bucket", F.col("_slice").cast("int").alias("_slice"), F.col("_begin").alias("_pos"), "_id", F.lit(0).alias("_kind"))
    )
    inside = Window.partitionBy("_bucket", "_slice").orderBy("_pos", "_kind", "_id")
    hits = (
        lines.unionByName(points)
        .withColumn("_row", F.last("_id", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_kind") == 1)
        .groupBy(F.col("_row").alias(key))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    return (
        df.join(hits, key)
        .withColumn("draw_no", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .drop("_times")
    )
