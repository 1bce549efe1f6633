"""Join helpers.

Equi-joins carry no size hints: Spark broadcasts a side whose measured size is
under its threshold and splits skewed shuffle partitions otherwise. Sets of
integer ids are also kept as bitmaps, which a broadcast holds far more of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import written

BITMAP_BYTES = 4096  # of one bucket of 32,768 ids
MOST_BITMAP_BYTES = 64 << 20  # of all buckets that are sent to every task


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def id_bitmaps(ids: DataFrame, on: str) -> DataFrame:
    """``(bucket, bits)``: the distinct ids of a LONG column, one bit each, one row for 32,768 neighbouring numbers."""
    known = ids.filter(F.col(on).isNotNull())
    return known.groupBy(F.bitmap_bucket_number(on).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(on)).alias("bits"))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit at a position counted from 0."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def semi_by_id(df: DataFrame, ids: DataFrame, on: str, most_bytes: int = MOST_BITMAP_BYTES) -> DataFrame:
    """Rows of ``df`` whose LONG ``on`` is among ``ids``, wide rows left where they are read.

    The ids are written as bitmaps; if those come to no more than ``most_bytes``
    they are sent to the tasks, and rows are kept or dropped before anything is
    exchanged. Ids too scattered for that go through a plain semi join.
    """
    bitmaps = written(id_bitmaps(ids, on), "id-bitmaps")
    if bitmaps.count() * BITMAP_BYTES > most_bytes:
        return semi(df, ids, on)
    bitmaps = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    met = df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(df[on]) == F.col("_bucket"))  # size checked above
    return met.filter(has_bit(F.col("_bits"), F.bitmap_bit_position(on))).select(*[F.col(f"`{c}`") for c in df.columns])


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is known and absent from ``keys``."""
    return df.filter(F.col(on).isNotNull()).join(keys, on, "left_anti")


def null_safe_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join in which missing keys match each other, as they do in dataframe libraries."""
    other = right.withColumnRenamed(on, f"_{on}")
    return left.join(other, F.col(on).eqNullSafe(F.col(f"_{on}")), how).drop(f"_{on}")

