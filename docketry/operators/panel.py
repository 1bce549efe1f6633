"""Treated / control panel by group and quarter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.claims import DECISION_DATE, post_flag, uniform_from_hash

# Cumulative Poisson(1) probabilities up to 8; the tail beyond is 1.1e-6.
POISSON_ONE = [
    0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173,
    0.999405815182, 0.999916758851, 0.999989750804, 0.999998874797,
]


def panel_counts(treatment: DataFrame, decision: dt.date = DECISION_DATE) -> DataFrame:
    """Patents per (group, quarter, Treated) with Post and log count."""
    counts = treatment.groupBy("group_id", "quarter_issue_date_dt", "Treated").agg(F.count("patent_id").alias("Count"))
    return counts.withColumns({
        "Post": post_flag("quarter_issue_date_dt", decision),
        "log_Count": F.log("Count"),
    })


def normalized_series(panel: DataFrame) -> DataFrame:
    """Each series divided by its first value. A series has one row per quarter."""
    w = Window.partitionBy("group_id", "Treated").orderBy("quarter_issue_date_dt")
    return panel.withColumn("normalized_Count", F.col("Count") / F.first("Count").over(w))


def mean_series(series: DataFrame) -> DataFrame:
    return series.groupBy("quarter_issue_date_dt", "Treated").agg(
        F.avg("normalized_Count").alias("mean"), F.count(F.lit(1)).alias("groups")
    )


def bootstrap_series(series: DataFrame, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean series with a bootstrap interval over groups.

    Each replicate gives every group an independent Poisson(1) multiplicity, the
    form of the bootstrap that needs no resampled copy of the data: replicates
    are sums and combine map-side.
    """
    u = uniform_from_hash(seed, "group_id", "quarter_issue_date_dt", "Treated", "b")
    times = sum(((u > F.lit(p)).cast("int") for p in POISSON_ONE[1:]), (u > F.lit(POISSON_ONE[0])).cast("int"))
    draws = (
        series.select("group_id", "quarter_issue_date_dt", "Treated", "normalized_Count")
        .withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("m", times)
        .filter(F.col("m") > 0)
    )
    means = draws.groupBy("quarter_issue_date_dt", "Treated", "b").agg(
        (F.sum(F.col("m") * F.col("normalized_Count")) / F.sum("m")).alias("mean_b")
    )
    tail = (1 - level) / 2
    bounds = means.groupBy("quarter_issue_date_dt", "Treated").agg(
        F.percentile("mean_b", F.lit(tail)).alias("ci_low"), F.percentile("mean_b", F.lit(1 - tail)).alias("ci_high")
    )
    return mean_series(series).join(bounds, ["quarter_issue_date_dt", "Treated"])
