"""Exact order statistics and running sums without one big sorted task.

Rows are cut into value blocks, by distributed quantiles or by range; only block
totals, a list of bounded length, come to the driver. A search for the n-th row
ends with a top-k once so few candidates are left that a heap holds them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docketry.session import stored, written

ROWS_PER_BLOCK = 1_000_000
ROWS_TO_RANK = 100_000  # candidates left for the closing top-k, whose heap ends at the driver
MAX_BLOCKS = 4096


def _edges(df: DataFrame, column: str, blocks: int) -> list[float]:
    """Strictly increasing inner cut points of a numeric column."""
    probs = [i / blocks for i in range(1, blocks)]
    return sorted(set(df.approxQuantile(column, probs, 1.0 / (4 * blocks))))


def with_block(df: DataFrame, column: str, blocks: int, name: str = "_block") -> DataFrame:
    """Tag rows with the index of the value block they fall into (binary search in the JVM)."""
    cuts = _edges(df, column, blocks) if blocks > 1 else []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *cuts, math.inf]
    tagged = Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)
    return tagged.withColumn(name, F.col(name).cast("int"))


def at_most(df: DataFrame, keys: Sequence[str], row: Row) -> Column:
    """Key tuple of a row of ``df`` is not above ``row``."""
    bound = [F.lit(row[k]).cast(df.schema[k].dataType).alias(k) for k in keys]
    return F.struct(*[F.col(k) for k in keys]) <= F.struct(*bound)


def rank_threshold(
    df: DataFrame, keys: Sequence[str], n: int, total: int | None = None, rows_per_block: int = ROWS_TO_RANK
) -> Row | None:
    """The n-th smallest key tuple (1-based) of ``df``; keys are numeric, first key leads.

    Narrows a value range per pass: block counts tell which block holds the
    n-th row, ties on one key are resolved by the next key.
    """
    if n <= 0:
        return None
    rows = df.select(*keys)
    total = rows.count() if total is None else total
    if n > total:
        raise ValueError(f"cannot take {n} of {total} rows")
    skip, level = n - 1, 0
    while total > rows_per_block and level < len(keys):
        key = keys[level]
        blocks = min(MAX_BLOCKS, max(2, math.ceil(2 * total / rows_per_block)))
        tagged = with_block(rows.withColumn("_key", F.col(key).cast("double")), "_key", blocks)
        counts = (
            tagged.groupBy("_block")
            .agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi"))
            .orderBy("_block")
            .collect()  # at most MAX_BLOCKS rows
        )
        for block in counts:
            if skip < block["c"]:
                break
            skip -= block["c"]
        lo, hi = block["lo"], block["hi"]
        if block["c"] == total and lo != hi:
            # One cut holds everything: split at its smallest value.
            ties = rows.filter(F.col(key) == F.lit(lo)).count()
            if skip < ties:
                hi, total = lo, ties
            else:
                skip, total = skip - ties, total - ties
                rows = rows.filter(F.col(key) > F.lit(lo))
                continue
        else:
            total = block["c"]
        rows = rows.filter(F.col(key).between(F.lit(lo), F.lit(hi)))
        if lo == hi:
            level += 1
    return rows.orderBy(*keys).offset(skip).limit(1).first()


def smallest_n(
    df: DataFrame, keys: Sequence[str], n: int, total: int | None = None, rows_per_block: int = ROWS_TO_RANK
) -> DataFrame:
    """The n rows with the smallest key tuples. Keys must identify a row; no sort, no shuffle of ``df``."""
    bound = rank_threshold(df, keys, n, total, rows_per_block)
    return df.filter(F.lit(False)) if bound is None else df.filter(at_most(df, keys, bound))


def running_sums(
    df: DataFrame,
    order: str,
    columns: Sequence[str],
    descending: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``cum_<c>``: inclusive running sums along a column of distinct numbers.

    Rows are dealt by ranges of ``order`` and written with their range's number;
    each range runs its own sums, and the totals of the ranges before it are
    joined. The path is the same at every size: no task sees more than a range,
    and one total per range, at most MAX_BLOCKS, comes to the driver.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with stored(df) as kept:
        blocks = min(MAX_BLOCKS, max(least, math.ceil(kept.count() / rows_per_block)))
        dealt = written(kept.repartitionByRange(blocks, direction).withColumn("_block", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_block").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("_block").collect()
    carried, seen = [], [0] * len(columns)
    for row in totals:
        carried.append((row["_block"], *seen))
        seen = [s + row[c] for s, c in zip(seen, columns)]
    kinds = [f"_off_{c} {dealt.select(F.sum(c)).schema[0].dataType.simpleString()}" for c in columns]
    offsets = df.sparkSession.createDataFrame(carried, ", ".join(["_block int", *kinds]))
    w = Window.partitionBy("_block").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(c).over(w).alias(f"_loc_{c}") for c in columns])
    joined = local.join(F.broadcast(offsets), "_block")  # MAX_BLOCKS rows at most
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in columns],
    )


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Top-n report rows (heap per task, then one merge of n rows each)."""
    return df.orderBy(*order).limit(n)
