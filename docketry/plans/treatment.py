"""Patent-level treatment, the quarterly panel and its models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import claims as cl
from docketry.operators import panel as pn
from docketry.operators import regression as rg
from docketry.session import stored


def patent_dates(patents: DataFrame) -> DataFrame:
    issued = cl.to_date("patent_date")
    return (
        patents.select(
            cl.to_int_id("patent_id").alias("patent_id"), issued.alias("issue_date_dt"),
            F.year(issued).alias("issue_year"), F.quarter(issued).alias("issue_quarter"),
            cl.quarter_end(issued).alias("quarter_issue_date_dt"), "withdrawn",
        )
        .filter(F.col("patent_id").isNotNull() & (F.col("withdrawn") == 0))
        .drop("withdrawn")
        .distinct()
    )


def first_groups(cpc: DataFrame) -> DataFrame:
    """First inventional classification of a patent."""
    return (
        cpc.filter((F.col("cpc_type") == "inventional") & (F.col("cpc_sequence") == 0))
        .select(
            cl.to_int_id("patent_id").alias("patent_id"), F.col("cpc_subclass").alias("group_id"),
            F.col("cpc_group").alias("subgroup_id"),
        )
        .distinct()
    )


def first_claim_labels(scored: DataFrame) -> DataFrame:
    """Label of the first claim; a patent with two different labels keeps both rows."""
    return (
        scored.filter(F.col("claim_sequence") == 0)
        .select(cl.to_int_id("patent_id").alias("patent_id"), F.col("predicted_label").alias("Treated"))
        .distinct()
    )


def patent_treatment(patents: DataFrame, cpc: DataFrame, scored: DataFrame) -> DataFrame:
    return patent_dates(patents).join(first_groups(cpc), "patent_id").join(first_claim_labels(scored), "patent_id")


def did_panel(treatment: DataFrame, decision: dt.date = cl.DECISION_DATE) -> DataFrame:
    return pn.normalized_series(pn.panel_counts(treatment, decision))


def did_models(panel: DataFrame) -> DataFrame:
    """All four models as one long table."""
    with stored(panel) as kept:
        fits = [rg.did_ols(kept), rg.fixed_effects(kept), rg.poisson(kept), rg.negative_binomial(kept)]
    return rg.regression_table(*fits)
