"""From raw tables to treated claims, control claims and the balanced training table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import claims as cl
from docketry.operators import counting as ct
from docketry.operators.joins import anti, semi, semi_by_id
from docketry.operators.sampling import weighted_with_replacement, weighted_without_replacement
from docketry.session import materialize, written


def independent_claims(claims: DataFrame, origin: str) -> DataFrame:
    """Independent claims without their number and without references to other claims."""
    stripped = cl.strip_claim_number("claim_text", origin)
    return (
        claims.filter(cl.is_independent("dependent", origin))
        .withColumn("claim_text", stripped)
        .filter(~cl.refers_to_claim("claim_text"))
    )


def extract_application_claims(claims: DataFrame, applications: DataFrame) -> DataFrame:
    """Independent pre-grant claims of the given applications.

    ``applications``: document_number, app_id, filing_date_dt, filing_year and
    optional class columns; a document with several classes gives several rows.
    """
    known = independent_claims(claims, "pregrant").filter(F.col("document_number").isNotNull())
    return known.join(applications, "document_number").select(
        "app_id",
        F.col("document_number").alias("pgpub_number"),
        F.col("filing_date_dt").alias("filing_date_PregrantApp_dt"),
        F.col("filing_year").alias("filing_year_PregrantApp"),
        F.col("claim_sequence"),
        cl.to_int_id("claim_sequence").alias("claim_int"),
        "claim_text",
    )


def extract_patent_claims(claims: DataFrame, patent_ids: DataFrame) -> DataFrame:
    """Independent claims of the issued patents listed in ``patent_ids`` (one LONG column)."""
    keyed = independent_claims(claims, "issued").withColumn("patent_id", cl.to_int_id("patent_id"))
    return semi_by_id(keyed.filter(F.col("patent_id").isNotNull()), patent_ids, "patent_id")


def any_ground(grounds: tuple[str, ...] = ("alice_in", "bilski_in", "mayo_in", "myriad_in")) -> Column:
    """Rejection under any of the given decisions."""
    cond = F.lit(False)
    for ground in grounds:
        cond = cond | F.coalesce(F.col(ground) == 1, F.lit(False))
    return cond


@dataclass
class ControlCohorts:
    no_action: DataFrame  # granted applications without any office action
    no_101: DataFrame  # patents issued after the decision without a subject-matter action
    main_classes: DataFrame


def with_application_keys(applications: DataFrame) -> DataFrame:
    return applications.withColumns({
        "app_id": cl.to_int_id("application_number"),
        "patent_num": cl.to_int_id("patent_number"),
        "filing_date_dt": cl.to_date("filing_date"),
        "patent_issue_date_dt": cl.to_date("patent_issue_date"),
        "appl_status_date_dt": cl.to_date("appl_status_date"),
        "uspc_class_str": cl.norm_class("uspc_class"),
        "status": cl.to_int_id("appl_status_code"),
    })


def control_cohorts(
    applications: DataFrame,
    office_actions: DataFrame,
    rejections: DataFrame,
    n_classes: int = 100,
    decision: dt.date = cl.DECISION_DATE,
) -> ControlCohorts:
    """Both control cohorts for a set of rejections.

    Controls share filing years and main classes with rejected applications.
    Rejections are counted per application before the join and the anti joins
    compare with distinct action keys, so a third of all records on one
    application costs one key.
    """
    apps = with_application_keys(applications)
    per_app = ct.value_counts(rejections.select(cl.to_int_id("app_id").alias("app_id")), "app_id")
    # one row per year and class: years and classes both come from it, and its size in bytes is known
    rejected = written(
        apps.join(per_app, "app_id").groupBy(F.year("filing_date_dt").alias("filing_year"), "uspc_class_str")
        .agg(F.sum("count").alias("count")), "rejected-cells",
    )
    years = ct.distinct_keys(rejected, "filing_year")
    main = (
        rejected.filter(F.col("uspc_class_str").isNotNull())
        .groupBy("uspc_class_str").agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), F.asc("uspc_class_str")).limit(n_classes).select("uspc_class_str")
    )

    actions = office_actions.select(cl.to_int_id("app_id").alias("app_id"), "rejection_101")
    with_action = ct.distinct_keys(actions, "app_id")
    with_101 = ct.distinct_keys(actions.filter(F.col("rejection_101") == 1), "app_id")

    granted = apps.filter(F.col("status") == cl.PATENTED_STATUS_CODE).withColumn("filing_year", F.year("filing_date_dt"))
    cohort = semi(semi(granted, years, "filing_year"), main, "uspc_class_str")
    issued_later = cohort.filter(
        (F.col("patent_issue_date_dt") > F.lit(decision)) & F.col("patent_num").isNotNull()
    )
    return ControlCohorts(anti(cohort, with_action, "app_id"), anti(issued_later, with_101, "app_id"), main)


def pure_rejections(office_actions: DataFrame, rejections: DataFrame) -> DataFrame:
    """Office actions joined with their rejection records, subject matter as the only ground."""
    keys = {"ifw_number": cl.norm_class("ifw_number"), "app_id": cl.to_int_id("app_id")}
    actions = office_actions.filter(cl.pure_ground()).withColumns(keys)
    grounds = rejections.filter(F.col("alice_in") == 1).withColumns(keys)
    return actions.join(grounds, ["ifw_number", "app_id"])


def rejected_claims(pure: DataFrame, claims: DataFrame, claim_offset: int = 0) -> DataFrame:
    """Claim texts that the rejection names. ``claim_offset`` shifts the claim index before the test."""
    return pure.join(claims, "app_id").filter(
        cl.in_claim_list(F.col("claim_int") + F.lit(claim_offset), "claim_numbers")
    )


def treated_steps() -> list[tuple[str, Column]]:
    """Cleaning steps on rejected claims joined with their application."""
    return [
        ("right_publication", cl.right_publication("pgpub_number", "earliest_pgpub_number")),
        ("final_status", F.col("status").isin(cl.TREATED_STATUS_CODES)),
        ("logical_dates", cl.logical_dates("mail_dt", "filing_date", "appl_status_date", "earliest_pgpub_date")),
        ("not_cancelled", ~cl.is_cancelled("claim_text")),
    ]


def rejected_claims_with_application(
    office_actions: DataFrame, rejections: DataFrame, claims: DataFrame, applications: DataFrame, claim_offset: int = 0
) -> DataFrame:
    """``claims``: app_id, pgpub_number, claim_int, claim_text."""
    texts = claims.select("app_id", "pgpub_number", "claim_int", "claim_text")
    actions = pure_rejections(office_actions, rejections).select("app_id", "mail_dt", "claim_numbers")
    apps = with_application_keys(applications).drop("uspc_subclass")
    return rejected_claims(actions, texts, claim_offset).join(apps, "app_id")


def treated_claims(
    office_actions: DataFrame, rejections: DataFrame, claims: DataFrame, applications: DataFrame, claim_offset: int = 0
) -> DataFrame:
    """Treated claims after all cleaning steps; the filters reach the scans below the joins."""
    rows = rejected_claims_with_application(office_actions, rejections, claims, applications, claim_offset)
    for _, cond in treated_steps():
        rows = rows.filter(cond)
    return rows


def issued_controls(applications: DataFrame, claims: DataFrame) -> DataFrame:
    """Control claims from issued patents: patent_id, claim_int, claim_text."""
    keyed = claims.select(cl.to_int_id("patent_id").alias("patent_num"), "claim_int", "claim_text")
    return with_application_keys(applications).join(keyed, "patent_num")


def pregrant_controls(applications: DataFrame, claims: DataFrame) -> DataFrame:
    """Control claims from publications: app_id, pgpub_number, claim_int, claim_text."""
    keyed = claims.select(cl.to_int_id("app_id").alias("app_id"), "pgpub_number", "claim_int", "claim_text")
    return (
        with_application_keys(applications).join(keyed, "app_id")
        .filter(~cl.is_cancelled("claim_text"))
        .filter(cl.right_publication("pgpub_number", "earliest_pgpub_number"))
    )


@dataclass
class TrainingConfig:
    """Variants: control source, class list, sampling, decision date, cohort."""

    n_classes: int = 4
    classes: list[str] | None = None
    replacement: bool = False
    per_cell: bool = False
    decision: dt.date = cl.DECISION_DATE
    seed: int = 42
    u: Callable[[], Column] | None = None
    tie: list[str] | None = None  # numeric columns that order rows of equal key


@dataclass
class TrainingTable:
    training_data: DataFrame
    main_classes: DataFrame
    cells: DataFrame
    drawn_controls: DataFrame


DEDUP_KEYS = ["claim_text", "app_id", "earliest_pgpub_number"]
CORE = [*DEDUP_KEYS, "claim_int", "uspc_class_str", "filing_date_dt", "patent_issue_date_dt"]


def unique_claims(rows: DataFrame) -> DataFrame:
    """One row per (text, application, publication): the lowest claim index."""
    return ct.first_per_key(rows.select(*CORE), DEDUP_KEYS, ["claim_int"])


def class_list(treated: DataFrame, config: TrainingConfig) -> DataFrame:
    if config.classes is None:
        return ct.top_classes(treated, "uspc_class_str", config.n_classes).select("uspc_class_str")
    if isinstance(config.classes, str):
        raise TypeError("classes must be a list of class codes")
    rows = [(c,) for c in sorted(set(config.classes))]
    return treated.sparkSession.createDataFrame(rows, "uspc_class_str string")


def balanced_training(treated: DataFrame, controls: DataFrame, config: TrainingConfig | None = None) -> TrainingTable:
    """Treated claims of the main classes and as many controls, drawn to match class and filing year.

    A control carries the relative frequency of its cell as weight. With
    ``per_cell`` the weight is divided by the number of controls in the cell.
    """
    config = config or TrainingConfig()
    year = F.year("filing_date_dt").alias("filing_year")
    treated = materialize(unique_claims(treated))
    main = class_list(treated, config)
    chosen = semi(treated, main, "uspc_class_str").select("*", year)
    cells = written(ct.relative_frequencies(ct.value_counts(chosen, "uspc_class_str", "filing_year")), "cells")
    timed = semi(
        unique_claims(controls.filter(F.col("patent_issue_date_dt") > F.lit(config.decision))), main, "uspc_class_str"
    ).select("*", year)
    pool = timed.join(cells.drop("count"), ["uspc_class_str", "filing_year"])
    if config.per_cell:
        sizes = ct.value_counts(pool, "uspc_class_str", "filing_year")
        pool = pool.join(sizes, ["uspc_class_str", "filing_year"]).withColumn(
            "relative_freq", F.col("relative_freq") / F.col("count")
        ).drop("count")
    u = config.u() if config.u else cl.uniform_from_hash(config.seed, *DEDUP_KEYS)
    pool = pool.withColumns({"_row": F.xxhash64(F.lit(config.seed), *DEDUP_KEYS), "_u": u})
    # the draw sees keys and weights only; the winners' texts are joined afterwards
    slim = materialize(pool.select("_row", "app_id", "claim_int", "relative_freq", "_u"))
    n = chosen.count()
    if config.replacement:
        keys = weighted_with_replacement(slim, n, "relative_freq", "_row", config.seed).drop("draw_no")
    else:
        ties = [*(config.tie or []), "_row", "app_id", "claim_int"]
        keys = weighted_without_replacement(slim, n, "relative_freq", F.col("_u"), list(dict.fromkeys(ties)))
    keys = keys.select(F.col("_row").alias("_drawn"), F.col("app_id").alias("_app"))
    same = (F.col("_row") == F.col("_drawn")) & F.col("app_id").eqNullSafe(F.col("_app"))
    drawn = pool.join(keys, same).drop("_row", "_u", "_drawn", "_app")
    drawn = drawn.withColumn("unique_claim_id", cl.unique_claim_id("app_id", "claim_int"))
    both = ct.union_rows(
        chosen.select("app_id", "claim_text", F.lit(1).alias("treated")),
        drawn.select("app_id", "claim_text", F.lit(0).alias("treated")),
    )
    final = both.withColumn("claim_text", cl.strip_claim_number("claim_text", "issued", trim=False))
    return TrainingTable(final, main, cells, drawn)
