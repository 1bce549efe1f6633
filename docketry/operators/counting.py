"""Counts, shares, funnels and distinct keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def value_shares(df: DataFrame, *columns: str) -> DataFrame:
    """Counts with their share of all rows; the total is a scalar subquery over the counts."""
    return relative_frequencies(value_counts(df, *columns), "count", "share")


def relative_frequencies(cells: DataFrame, count: str = "count", name: str = "relative_freq") -> DataFrame:
    return cells.withColumn(name, F.col(count) / cells.select(F.sum(count)).scalar())


def top_classes(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties go to the smaller value, nulls are no class."""
    counts = value_counts(df.filter(F.col(column).isNotNull()), column)
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(n)


def cumulative_share(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Running share of the n most frequent values, largest first."""
    shares = value_shares(df.filter(F.col(column).isNotNull()), column)
    top = shares.orderBy(F.desc("count"), F.asc(column)).limit(n)
    w = Window.orderBy(F.desc("count"), F.asc(column)).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("cum_share", F.sum("share").over(w))  # n rows only


def distinct_count(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, exact by default."""
    agg = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[agg(F.col(c)).alias(f"distinct_{c}") for c in columns])


def funnel(df: DataFrame, id_column: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows and distinct ids that survive each step, in one pass.

    The per-id counts are summed map-side first, so one id with many rows
    costs no more than the others.
    """
    # Each condition is evaluated once; the running AND works on the results.
    tested = df.select(
        F.col(id_column).alias("_id"), *[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, (_, c) in enumerate(steps)]
    )
    alive, passed = F.lit(True), []
    for i in range(len(steps)):
        alive = alive & F.col(f"c{i}")
        passed.append(alive.cast("long").alias(f"s{i}"))
    flags = tested.select("_id", *passed)
    per_id = flags.groupBy("_id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(steps))])
    known = F.col("_id").isNotNull()
    totals = per_id.agg(
        *[F.sum(f"s{i}").alias(f"r{i}") for i in range(len(steps))],
        *[F.sum((known & (F.col(f"s{i}") > 0)).cast("long")).alias(f"d{i}") for i in range(len(steps))],
    )
    lines = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("step_name"),
            F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("n_rows"), F.coalesce(F.col(f"d{i}"), F.lit(0)).alias("n_ids"),
        )
        for i, (name, _) in enumerate(steps)
    ])
    return totals.select(F.inline(lines))


def repeated(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Values drawn more than once, most frequent first."""
    counts = value_counts(df, column).filter(F.col("count") > 1)
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(n)


def year_bounds(df: DataFrame, column: str = "year") -> DataFrame:
    return df.agg(F.min(column).alias("min_year"), F.max(column).alias("max_year"))


def clamp_years(df: DataFrame, low: int, high: int, column: str = "year") -> DataFrame:
    """Rows within the asked range, each bound clamped to the range of the data.

    A bound beyond the data moves to its end, so a range entirely outside keeps
    the nearest year.
    """
    first, last = year_bounds(df, column).first()
    if first is None:
        return df
    return df.filter(F.col(column).between(min(max(low, first), last), max(min(high, last), first)))


def distinct_keys(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """One-column key list for semi and anti joins."""
    return df.select(F.col(column).alias(name or column)).filter(F.col(name or column).isNotNull()).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, chosen by a combinable aggregate.

    Copies collapse map-side before the shuffle, so a group that holds a third
    of all rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    kept = df.groupBy(*keys).agg(F.min(packed).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
