"""Helpers shared by the corpus operators: row views, landed tables, word sizes, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import scratch_path, ship_package

# What counts as a word in the size contracts.
WORD = r"[^\x20\x09-\x0D]+"


def begin(df: DataFrame) -> SparkSession:
    """The frame's session, with this package sent to its executors."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def view(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names, so that extra or clashing columns of the input never matter."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write once under ``spark.checkpoint.dir`` and go on from the files; they outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column | str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the short way, where both are the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the frame's bytes; files give it without a job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Tasks for the frame at so many bytes each, and never under the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, math.ceil(input_bytes(df) / bytes_each)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node of an edge list; component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    step is a grouped minimum, combined before the shuffle, and a join that
    adaptive execution may split, so a hub of any degree needs no single task.
    Edges are written after each round; a round halves what is left to merge.
    Nodes without an edge do not appear.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = landed(e, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above a node move to the node's minimum
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: neighbours below a node, and the node, move to the minimum
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = landed(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    members = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return members.union(roots.join(members, "node", "left_anti"))
