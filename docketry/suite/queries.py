"""One query per operator over the given tables; every query reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import claims as cl
from docketry.functions import tokens as tk
from docketry.models import classifiers as mc
from docketry.models import neighbours as nb
from docketry.models.features import tfidf_stages
from docketry.models.fitting import fit_in_order
from docketry.models.search import random_search
from docketry.operators import counting as ct
from docketry.operators import evaluation as ev
from docketry.operators import explain as ex
from docketry.operators import panel as pn
from docketry.operators import ranking as rk
from docketry.operators import regression as rg
from docketry.operators import sampling as sp
from docketry.operators import terms as tm
from docketry.operators.joins import anti, null_safe_join, semi
from docketry.plans import affected as af
from docketry.plans import cohort as co
from docketry.plans import scoring as sc
from docketry.plans import treatment as tr
from docketry.session import scratch_path
from docketry.sources import readers, schemas, writers
from docketry.suite.views import DECISION, Views

Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def integer(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    out = c.cast("int")
    return out.alias(name) if name else out


def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Views(spark, sf_dir))

    run.__name__ = fn.__name__
    return run


# --- identifiers, dates, classes ------------------------------------------------


@query
def numeric_ids(v: Views) -> DataFrame:
    return v.applications().select(
        "application_number", cl.to_int_id("application_number").alias("app_id"),
        cl.to_int_id("patent_number").alias("patent_num"), cl.to_int_id("appl_status_code").alias("status"),
    )


@query
def date_coercion(v: Views) -> DataFrame:
    return v.applications().select(
        "application_number", cl.to_date("appl_status_date").alias("status_date"),
        cl.to_date("patent_issue_date").alias("issue_date"),
    )


@query
def norm_class_counts(v: Views) -> DataFrame:
    return ct.value_counts(v.applications().select(cl.norm_class("uspc_class").alias("uspc_class_str")), "uspc_class_str")


@query
def publication_numbers(v: Views) -> DataFrame:
    return v.applications().select(
        "application_number", cl.clean_publication_number("earliest_pgpub_number").alias("publication_number")
    )


@query
def document_keys(v: Views) -> DataFrame:
    return ct.value_counts(v.office_actions().select(cl.norm_class("ifw_number").alias("ifw_number")), "ifw_number")


@query
def year_quarter_counts(v: Views) -> DataFrame:
    date = cl.to_date("patent_date")
    return ct.value_counts(v.patents().select(F.year(date).alias("issue_year"), F.quarter(date).alias("issue_quarter")),
                           "issue_year", "issue_quarter")


@query
def quarter_end_buckets(v: Views) -> DataFrame:
    return ct.value_counts(
        v.patents().select(cl.quarter_end(cl.to_date("patent_date")).alias("quarter_issue_date_dt")),
        "quarter_issue_date_dt",
    ).withColumn("post", cl.post_flag("quarter_issue_date_dt", DECISION))


# --- claim texts ------------------------------------------------------------------


@query
def claim_number_strip(v: Views) -> DataFrame:
    return v.pregrant_claims().select(
        "document_number", "claim_sequence",
        cl.strip_claim_number("claim_text", "issued").alias("issued_form"),
        cl.strip_claim_number("claim_text", "pregrant").alias("pregrant_form"),
        cl.strip_claim_number("claim_text", "issued", trim=False).alias("final_form"),
    )


@query
def dependent_reference(v: Views) -> DataFrame:
    return v.claims().groupBy("source").agg(
        F.sum(cl.refers_to_claim("claim_text").cast("long")).alias("with_reference"),
        F.count(F.lit(1)).alias("n_claims"),
    )


@query
def cancelled_claims(v: Views) -> DataFrame:
    return v.claims().filter(cl.is_cancelled("claim_text")).select("patent_id", "claim_sequence", "claim_text")


@query
def independent_claims(v: Views) -> DataFrame:
    return co.independent_claims(v.claims(), "issued").select("patent_id", "claim_sequence", "claim_text")


@query
def pregrant_independent_claims(v: Views) -> DataFrame:
    return co.independent_claims(v.pregrant_claims(), "pregrant").select("document_number", "claim_sequence", "claim_text")


def app_claims(v: Views) -> DataFrame:
    return co.extract_application_claims(v.pregrant_claims(), readers.publications(v.publications_raw()))


@query
def application_claim_extract(v: Views) -> DataFrame:
    return app_claims(v)


def granted_ids(v: Views) -> DataFrame:
    apps = co.with_application_keys(v.applications()).filter(F.col("status") == cl.PATENTED_STATUS_CODE)
    return ct.distinct_keys(apps, "patent_num", "patent_id")


@query
def patent_claim_extract(v: Views) -> DataFrame:
    return co.extract_patent_claims(v.claims(), granted_ids(v)).select("patent_id", "claim_sequence", "claim_text")


@query
def unique_claim_ids(v: Views) -> DataFrame:
    return v.claims().select(cl.unique_claim_id("patent_id", "claim_sequence").alias("unique_claim_id"))


# --- rejections, treated claims -----------------------------------------------------


@query
def rejection_grounds(v: Views) -> DataFrame:
    r = v.rejections()
    return r.agg(
        F.sum(co.any_ground(("alice_in",)).cast("long")).alias("one_ground"),
        F.sum(co.any_ground().cast("long")).alias("any_ground"), F.count(F.lit(1)).alias("n_rows"),
    )


@query
def pure_subject_matter_rejections(v: Views) -> DataFrame:
    return co.pure_rejections(v.office_actions(), v.rejections()).select(
        "app_id", "ifw_number", "mail_dt", "claim_numbers"
    )


@query
def rejected_applications(v: Views) -> DataFrame:
    """Rejections matched to their applications, per filing year and class."""
    apps = co.with_application_keys(v.applications())
    rows = apps.join(v.rejections().select(cl.to_int_id("app_id").alias("app_id")), "app_id")
    return ct.value_counts(rows.withColumn("filing_year", F.year("filing_date_dt")), "filing_year", "uspc_class_str")


@query
def affected_claim_membership(v: Views) -> DataFrame:
    pure = co.pure_rejections(v.office_actions(), v.rejections())
    texts = app_claims(v).select("app_id", "pgpub_number", "claim_int", "claim_text")
    return co.rejected_claims(pure, texts).select("app_id", "claim_int", "claim_numbers", "claim_text")


def named_rows(v: Views) -> DataFrame:
    return co.rejected_claims_with_application(v.office_actions(), v.rejections(), app_claims(v), v.applications())


@query
def publication_match(v: Views) -> DataFrame:
    return named_rows(v).filter(cl.right_publication("pgpub_number", "earliest_pgpub_number")).select(
        "app_id", "claim_int", "pgpub_number", "earliest_pgpub_number"
    )


@query
def date_logic(v: Views) -> DataFrame:
    return named_rows(v).filter(
        cl.logical_dates("mail_dt", "filing_date", "appl_status_date", "earliest_pgpub_date")
    ).select("app_id", "claim_int", "mail_dt", "filing_date", "appl_status_date", "earliest_pgpub_date")


def treated(v: Views) -> DataFrame:
    return co.treated_claims(v.office_actions(), v.rejections(), app_claims(v), v.applications())


@query
def treated_claims(v: Views) -> DataFrame:
    return treated(v).select("app_id", "claim_int", "claim_text", "uspc_class_str", "filing_date_dt")


@query
def attrition_funnel(v: Views) -> DataFrame:
    steps = [("named_claims", F.lit(True)), *co.treated_steps()]
    return ct.funnel(named_rows(v), "app_id", steps).select(integer("step", "step"), "step_name", "n_rows", "n_ids")


@query
def action_funnel(v: Views) -> DataFrame:
    pure = [(f, cl.flag_is_not_one(f)) for f in (
        "rejection_fp_mismatch", "rejection_102", "rejection_103", "rejection_112", "rejection_dp")]
    return ct.funnel(v.office_actions(), "app_id", [("all", F.lit(True)), *pure]).select(
        integer("step", "step"), "step_name", "n_rows", "n_ids"
    )


# --- controls and the training table -------------------------------------------------


def cohorts(v: Views, n_classes: int = 10) -> co.ControlCohorts:
    return co.control_cohorts(v.applications(), v.office_actions(), v.rejections(), n_classes, DECISION)


@query
def control_cohort_anti(v: Views) -> DataFrame:
    return cohorts(v).no_action.select("app_id", "uspc_class_str", "filing_date_dt", "status")


def cohort_of_grounds(v: Views, grounds: tuple[str, ...], n_classes: int) -> DataFrame:
    rejections = v.rejections().filter(co.any_ground(grounds))
    out = co.control_cohorts(v.applications(), v.office_actions(), rejections, n_classes, DECISION)
    return out.no_action.select("app_id", "uspc_class_str", "filing_date_dt", "status")


@query
def control_cohort_four_grounds(v: Views) -> DataFrame:
    """Variant: rejections on any of four grounds, 100 classes."""
    return cohort_of_grounds(v, ("alice_in", "bilski_in", "mayo_in", "myriad_in"), 100)


@query
def control_cohort_one_ground(v: Views) -> DataFrame:
    """Variant: rejections on one ground, 50 classes."""
    return cohort_of_grounds(v, ("alice_in",), 50)


@query
def control_cohort_101(v: Views) -> DataFrame:
    return cohorts(v).no_101.select("app_id", "patent_num", "uspc_class_str", "patent_issue_date_dt")


@query
def control_documents(v: Views) -> DataFrame:
    """Publications of the control applications."""
    keys = ct.distinct_keys(cohorts(v).no_action, "app_id")
    return semi(readers.publications(v.publications_raw()), keys, "app_id").distinct()


@query
def control_claims_issued(v: Views) -> DataFrame:
    claims = co.independent_claims(v.claims(), "issued").withColumn("claim_int", cl.to_int_id("claim_sequence"))
    return co.issued_controls(v.applications(), claims).select("app_id", "patent_num", "claim_int", "claim_text")


@query
def control_claims_pregrant(v: Views) -> DataFrame:
    return co.pregrant_controls(v.applications(), app_claims(v)).select("app_id", "pgpub_number", "claim_int", "claim_text")


@query
def top_classes(v: Views) -> DataFrame:
    return ct.top_classes(co.with_application_keys(v.applications()), "uspc_class_str", 4)


@query
def class_cumulative_share(v: Views) -> DataFrame:
    out = ct.cumulative_share(co.with_application_keys(v.applications()), "uspc_class_str", 10)
    return out.select("uspc_class_str", "count", r6("share", "share"), r6("cum_share", "cum_share"))


@query
def class_shares(v: Views) -> DataFrame:
    out = ct.value_shares(co.with_application_keys(v.applications()), "uspc_class_str")
    return out.select("uspc_class_str", "count", r6("share", "share"))


@query
def cell_frequencies(v: Views) -> DataFrame:
    t = v.training().filter(F.col("treated") == 1)
    cells = ct.relative_frequencies(ct.value_counts(t, "uspc_class_str", "filing_year"))
    controls = v.training().filter(F.col("treated") == 0)
    sized = ct.value_counts(controls, "uspc_class_str", "filing_year").withColumnRenamed("count", "controls")
    return sized.join(cells, ["uspc_class_str", "filing_year"]).select(
        "uspc_class_str", "filing_year", "count", "controls", r6("relative_freq", "relative_freq")
    )


def weighted_controls(v: Views) -> DataFrame:
    t = v.training().filter(F.col("treated") == 1)
    cells = ct.relative_frequencies(ct.value_counts(t, "uspc_class_str", "filing_year")).drop("count")
    return v.training().filter(F.col("treated") == 0).join(cells, ["uspc_class_str", "filing_year"])


@query
def weighted_sample(v: Views) -> DataFrame:
    n = v.training().filter(F.col("treated") == 1).count()
    drawn = sp.weighted_without_replacement(
        weighted_controls(v), n, "relative_freq", cl.uniform_from_key("app_id"), "app_id"
    )
    return drawn.select("app_id", "uspc_class_str", "filing_year")


@query
def sample_with_replacement(v: Views) -> DataFrame:
    n = v.training().filter(F.col("treated") == 1).count()
    drawn = sp.weighted_with_replacement(weighted_controls(v), n, "relative_freq", "app_id")
    return drawn.select("app_id", "draw_no", "uspc_class_str", "filing_year")


@query
def uniform_sample(v: Views) -> DataFrame:
    return sp.uniform_sample(v.table("documents"), 100, cl.uniform_from_key("doc_id"), "doc_id").select("doc_id", "lang")


@query
def stratified_split(v: Views) -> DataFrame:
    return sp.stratified_split(v.training(), "treated", cl.uniform_from_key("app_id"), "app_id").select(
        "app_id", "treated", "is_test"
    )


@query
def dedup_first(v: Views) -> DataFrame:
    docs = v.table("documents").select("text", "lang", "doc_id", "source")
    return ct.first_per_key(docs, ["text", "lang"], ["doc_id"]).select("doc_id", "lang", "source", "text")


@query
def repeated_claims(v: Views) -> DataFrame:
    ids = v.scored_claims().select(cl.unique_claim_id("patent_id", "claim_sequence").alias("unique_claim_id"))
    return ct.repeated(ids, "unique_claim_id", 10)


@query
def distinct_counts(v: Views) -> DataFrame:
    return ct.distinct_count(v.office_actions(), "app_id", "ifw_number")


@query
def year_bounds(v: Views) -> DataFrame:
    return ct.year_bounds(v.claims(), "year")


@query
def clamped_years(v: Views) -> DataFrame:
    claims = v.claims()
    return ct.value_counts(ct.clamp_years(claims, 2012, 2020), "year")


def training_inputs(v: Views) -> tuple[DataFrame, DataFrame]:
    claims = co.independent_claims(v.claims(), "issued").withColumn("claim_int", cl.to_int_id("claim_sequence"))
    return treated(v), co.issued_controls(v.applications(), claims)


def training_config() -> co.TrainingConfig:
    key = F.pmod("app_id", F.lit(1 << 31)) * 1000 + F.col("claim_int")
    return co.TrainingConfig(
        n_classes=20, decision=DECISION, u=lambda: cl.uniform_from_key(key), tie=["app_id", "claim_int"]
    )


@query
def balanced_training(v: Views) -> DataFrame:
    return co.balanced_training(*training_inputs(v), training_config()).training_data


@query
def balanced_training_of_classes(v: Views) -> DataFrame:
    """Variant: a stated list of classes in place of the most frequent ones."""
    config = training_config()
    config.classes = ["3", "7", "12"]
    return co.balanced_training(*training_inputs(v), config).training_data


@query
def balanced_training_pregrant(v: Views) -> DataFrame:
    """Variant: controls from publications, weights evened out per cell."""
    t, _ = training_inputs(v)
    config = training_config()
    config.per_cell = True
    return co.balanced_training(t, co.pregrant_controls(v.applications(), app_claims(v)), config).training_data


@query
def union_of_extracts(v: Views) -> DataFrame:
    """Extract parts of both origins as one table, counted by the partition rule."""
    issued = co.independent_claims(v.claims(), "issued").select(
        F.lit("control").alias("role"), F.lit("issued").alias("origin"), "claim_text", F.col("patent_id").alias("key"))
    pregrant = app_claims(v).select(
        F.lit("control").alias("role"), F.lit("pregrant").alias("origin"), "claim_text", F.col("app_id").alias("number"))
    return ct.value_counts(ct.union_rows(issued, pregrant), "role", "origin")


# --- affected patents and applications ------------------------------------------------


def main_classes(v: Views, n: int = 4) -> DataFrame:
    return ct.top_classes(co.with_application_keys(v.applications()), "uspc_class_str", n)


def affected(v: Views) -> af.AffectedPatents:
    return af.affected_patents(v.uspc(), v.applications(), v.cpc(), main_classes(v), 5)


@query
def union_of_ids(v: Views) -> DataFrame:
    return affected(v).uspc_patents


@query
def cpc_concordance(v: Views) -> DataFrame:
    return affected(v).cpc_classes


@query
def affected_patents(v: Views) -> DataFrame:
    return affected(v).cpc_patents


@query
def affected_patents_one_class(v: Views) -> DataFrame:
    """Variant: a list of one class, three groups."""
    classes = v.spark.createDataFrame([("3",)], "uspc_class_str string")
    return af.affected_patents(v.uspc(), v.applications(), v.cpc(), classes, 3).cpc_patents


@query
def group_shares(v: Views) -> DataFrame:
    out = af.group_shares(v.cpc(), affected(v).uspc_patents)
    return out.select("group_id", "count", r6("share", "share"), r6("cum_share", "cum_share"))


@query
def distinct_rows(v: Views) -> DataFrame:
    return af.inventional_groups(v.cpc())


def pregrant_tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        readers.publications(v.publications_raw()),
        v.uspc_pregrant().withColumnRenamed("pgpub_id", "document_number"),
        v.cpc_pregrant().withColumnRenamed("pgpub_id", "document_number"),
    )


@query
def application_targets_left_join(v: Views) -> DataFrame:
    joined = af.classified_applications(*pregrant_tables(v))
    return joined.groupBy("document_number").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("uspc_class").alias("with_class"), F.count("group_id").alias("with_group")
    )


@query
def application_targets_by_class(v: Views) -> DataFrame:
    return af.application_targets(*pregrant_tables(v), main_classes(v), affected(v).cpc_classes)[0]


@query
def application_targets_by_group(v: Views) -> DataFrame:
    return af.application_targets(*pregrant_tables(v), main_classes(v), affected(v).cpc_classes)[1]


@query
def raw_subset_cascade(v: Views) -> DataFrame:
    import datetime as dt

    apps = v.applications()
    raw = af.RawTables(
        v.publications_raw(), v.patents(), v.cpc_pregrant(), v.cpc(), v.uspc(), v.uspc_pregrant(),
        apps, apps, v.office_actions(), v.rejections(),
    )
    sub = af.subset_raw(raw, dt.date(1996, 1, 1), dt.date(1998, 1, 1))
    out = None
    for name, df in vars(sub).items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


# --- panel and regressions ---------------------------------------------------------------


def treatment(v: Views) -> DataFrame:
    return tr.patent_treatment(v.patents(), v.cpc(), v.scored_claims())


@query
def first_claim_treatment(v: Views) -> DataFrame:
    return treatment(v)


@query
def did_panel(v: Views) -> DataFrame:
    p = tr.did_panel(treatment(v), DECISION)
    return p.select("group_id", "quarter_issue_date_dt", "Treated", "Count", "Post", r6("log_Count", "log_Count"),
                    r6("normalized_Count", "normalized_Count"))


def panel(v: Views) -> DataFrame:
    return tr.did_panel(treatment(v), DECISION)


@query
def mean_series(v: Views) -> DataFrame:
    return pn.mean_series(panel(v)).select("quarter_issue_date_dt", "Treated", r6("mean", "mean"), "groups")


@query
def bootstrap_series(v: Views) -> DataFrame:
    return pn.bootstrap_series(panel(v), replicates=1000)


@query
def did_coefficients(v: Views) -> DataFrame:
    coefs, _ = rg.did_ols(panel(v))
    return coefs.select("term", r6("coef", "coef"))


@query
def did_clustered_errors(v: Views) -> DataFrame:
    coefs, _ = rg.did_ols(panel(v))
    return coefs.select("term", r6("std_err", "std_err"))


@query
def fixed_effects(v: Views) -> DataFrame:
    return rg.fixed_effects(panel(v))[0]


@query
def fixed_effects_coefficients(v: Views) -> DataFrame:
    return rg.fixed_effects(panel(v))[0].select("term", r6("coef", "coef"))


@query
def negative_binomial_coefficients(v: Views) -> DataFrame:
    return rg.negative_binomial(panel(v))[0].filter("term <> 'alpha'").select("term", r6("coef", "coef"))


@query
def poisson_cell_means(v: Views) -> DataFrame:
    return rg.cell_mean_coefficients(panel(v)).select("term", r6("coef", "coef"))


@query
def poisson_regression(v: Views) -> DataFrame:
    return rg.poisson(panel(v))[0].select("term", r6("coef", "coef"), r6("std_err", "std_err"))


@query
def negative_binomial(v: Views) -> DataFrame:
    return rg.negative_binomial(panel(v))[0]


@query
def regression_table(v: Views) -> DataFrame:
    return tr.did_models(panel(v))


# --- terms ---------------------------------------------------------------------------------


@query
def term_frequency(v: Views) -> DataFrame:
    return tm.term_counts(v.training(), tk.word_tokens("claim_text"), "treated")


@query
def clean_token_counts(v: Views) -> DataFrame:
    return tm.term_counts(v.training(), tk.clean_tokens("claim_text"), "treated")


@query
def stemmed_term_counts(v: Views) -> DataFrame:
    counts = tm.term_counts(v.training(), tk.clean_tokens("claim_text"), "treated")
    return tm.stem_counts(counts, "tf", "treated")


@query
def stop_word_filter(v: Views) -> DataFrame:
    """Tokens before and after the stop-word filter, per document."""
    tokens = tk.plain_tokens("claim_text")
    kept = tk.without_stop_words(tokens, tk.english_stop_words())
    parity = tk.without_stop_words(tokens, tk.english_stop_words(), parity=True)
    return v.training().select(
        "app_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_kept"),
        F.size(parity).cast("long").alias("n_parity"),
    )


@query
def document_frequency(v: Views) -> DataFrame:
    t = v.training()
    return tm.bounded_vocabulary(tm.document_frequency(t, tk.word_tokens("claim_text")), t.count())


@query
def ngram_counts(v: Views) -> DataFrame:
    """1- to 3-grams of all documents."""
    tokens = v.training().select(tk.word_tokens("claim_text").alias("tokens"))
    return tm.term_counts(tokens, tk.ngrams("tokens", 1, 3))


@query
def tfidf_weights(v: Views) -> DataFrame:
    out = tm.tfidf(v.training(), tk.word_tokens("claim_text"), "app_id")
    return out.select("app_id", "term", "tf", r6("weight", "weight"))


@query
def tf_weights_without_idf(v: Views) -> DataFrame:
    out = tm.tfidf(v.training(), tk.word_tokens("claim_text"), "app_id", use_idf=False)
    return out.select("app_id", "term", r6("weight", "weight"))


@query
def differential_terms(v: Views) -> DataFrame:
    out = tm.differential_terms(v.training(), "treated", "claim_text", tk.english_stop_words())
    return out.select("term", "treated_count", "control_count", r6("treated_weight", "treated_weight"),
                      r6("control_weight", "control_weight"))


@query
def lime_aggregate(v: Views) -> DataFrame:
    return ex.aggregate_words(v.word_weights()).select("word", r6("mean", "mean"), "count")


@query
def lime_top_words(v: Views) -> DataFrame:
    agg = ex.aggregate_words(v.word_weights()).withColumn("mean", F.round("mean", 6))
    up = ex.top_words(agg, True).select(F.lit("treated").alias("side"), "word", "count")
    return up.unionByName(ex.top_words(agg, False).select(F.lit("control").alias("side"), "word", "count"))


# --- classifiers ---------------------------------------------------------------------------------

# Features that SQL can rebuild, for the queries compared with it; all others take the default features.
WORDS = {"tokenizer": "words", "max_n": 1}


def split(v: Views) -> tuple[DataFrame, DataFrame]:
    parts = sp.stratified_split(v.training(), "treated", cl.uniform_from_key("app_id"), "app_id")
    return parts.filter(F.col("is_test") == 0), parts.filter(F.col("is_test") == 1)


def scores_of(v: Views, name: str, **feature_args) -> DataFrame:
    train, test = split(v)
    model = mc.fit_classifier(name, train, feature_args=feature_args or None)
    out = mc.predict(model, test)
    keep = [c for c in ("margin", "0", "1", "predicted_label") if c in out.columns]
    return out.select("app_id", "treated", *[f"`{c}`" for c in keep])


@query
def naive_bayes_scores(v: Views) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    t = v.training()
    model = mc.fit_classifier("naive_bayes", t, feature_args=WORDS)
    raw = vector_to_array("rawPrediction")
    return model.transform(t).select(
        "app_id", F.round(raw[0], 6).alias("score_0"), F.round(raw[1], 6).alias("score_1"),
        integer("prediction", "predicted_label"),
    )


@query
def knn_vote(v: Views) -> DataFrame:
    parts = sp.stratified_split(v.training(), "treated", cl.uniform_from_key("app_id"), "app_id")
    vectors = fit_in_order(tfidf_stages(**WORDS), parts)
    data = vectors.transform(parts)
    model = nb.NeighbourVote(labelCol="treated", keyCol="app_id").fit(data.filter("is_test = 0"))
    out = mc.predict(model, data.filter("is_test = 1").select("app_id", "features"))
    return out.select("app_id", r6("`1`", "p1"), "predicted_label")


@query
def k_neighbors_scores(v: Views) -> DataFrame:
    return scores_of(v, "k_neighbors")


@query
def reloaded_model_scores(v: Views) -> DataFrame:
    """Scores of a classifier that was saved and loaded again."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    t = v.training()
    path = scratch_path(v.spark, "model")
    mc.fit_classifier("naive_bayes", t, feature_args=WORDS).write().overwrite().save(path)
    raw = vector_to_array("rawPrediction")
    return PipelineModel.load(path).transform(t).select(
        "app_id", F.round(raw[0], 6).alias("score_0"), F.round(raw[1], 6).alias("score_1"),
        integer("prediction", "predicted_label"),
    )


@query
def margin_curve(v: Views) -> DataFrame:
    """Precision and recall along the margin of a classifier without probabilities."""
    train, test = split(v)
    scored = mc.predict(mc.fit_classifier("sgd_hinge", train), test)
    return ev.precision_recall_curve(scored.select(F.col("treated").alias("label"), ev.score_column(scored).alias("score")))


@query
def logistic_regression_scores(v: Views) -> DataFrame:
    return scores_of(v, "logistic_regression")


@query
def svc_poly2_scores(v: Views) -> DataFrame:
    return scores_of(v, "svc_poly2")


@query
def svc_rbf_scores(v: Views) -> DataFrame:
    return scores_of(v, "svc_rbf")


@query
def linear_svc_scores(v: Views) -> DataFrame:
    return scores_of(v, "svc_linear")


@query
def decision_tree_scores(v: Views) -> DataFrame:
    return scores_of(v, "decision_tree")


@query
def random_forest_scores(v: Views) -> DataFrame:
    return scores_of(v, "random_forest")


@query
def gradient_boosting_scores(v: Views) -> DataFrame:
    return scores_of(v, "gradient_boosting")


@query
def sgd_hinge_scores(v: Views) -> DataFrame:
    return scores_of(v, "sgd_hinge")


@query
def modified_huber_scores(v: Views) -> DataFrame:
    return scores_of(v, "sgd_modified_huber")


@query
def adaboost_scores(v: Views) -> DataFrame:
    return scores_of(v, "adaboost")


@query
def doc_vector_scores(v: Views) -> DataFrame:
    train, test = split(v)
    model = mc.fit_classifier("svc_linear", train, features="doc_vectors")
    return mc.predict(model, test).select("app_id", "treated", "margin", "`0`", "`1`", "predicted_label")


@query
def model_comparison(v: Views) -> DataFrame:
    train, test = split(v)
    return mc.compare_models(train, test)


@query
def tuning_search(v: Views) -> DataFrame:
    train, _ = split(v)
    return random_search(train)


def issued_model(v: Views):
    return mc.fit_classifier("svc_linear", v.training())


@query
def score_patent_claims(v: Views) -> DataFrame:
    out = sc.score_patent_claims(v.claims(), granted_ids(v), issued_model(v))
    return writers.predictions_only(out)


@query
def score_application_claims(v: Views) -> DataFrame:
    targets = af.application_targets(*pregrant_tables(v), main_classes(v), affected(v).cpc_classes)[1]
    out = sc.score_application_claims(v.pregrant_claims(), targets, issued_model(v))
    return out.select("app_id", "document_number", "group_id", "claim_sequence", "`0`", "`1`", "predicted_label")


@query
def lime_explain(v: Views) -> DataFrame:
    model = mc.fit_classifier("logistic_regression", v.training())
    return ex.explain(v.training(), model, "app_id", size=100)


def labelled_lines(v: Views) -> DataFrame:
    return v.claims().select("claim_text", (F.col("claim_sequence") % 2).cast("int").alias("predicted_label"))


@query
def predicted_word_table(v: Views) -> DataFrame:
    return sc.predicted_word_tables(labelled_lines(v))[0]


@query
def predicted_word_contrast(v: Views) -> DataFrame:
    out = sc.predicted_word_tables(labelled_lines(v))[1]
    return out.select("term", "treated_count", "control_count", r6("treated_weight", "treated_weight"),
                      r6("control_weight", "control_weight"))


# --- evaluation --------------------------------------------------------------------------------------


@query
def confusion_matrix(v: Views) -> DataFrame:
    return ev.confusion_matrix(v.predictions()).select("label", "predicted", "n", r6("share", "share"))


@query
def classification_report(v: Views) -> DataFrame:
    return ev.classification_report(v.predictions()).select("class", "metric", r6("value", "value"))


@query
def report_by_class(v: Views) -> DataFrame:
    out = ev.report_by_class(ev.classification_report(v.predictions()))
    return out.select("class", *[r6(f"`{m}`", m.replace("-", "_")) for m in ("precision", "recall", "f1-score", "support")])


@query
def model_scores(v: Views) -> DataFrame:
    out = ev.scores(ev.confusion_counts(v.predictions()))
    return out.select(*[r6(c, c) for c in out.columns])


@query
def precision_recall_curve(v: Views) -> DataFrame:
    return ev.precision_recall_curve(v.predictions()).select(
        r6("threshold", "threshold"), r6("precision", "precision"), r6("recall", "recall")
    )


@query
def average_precision(v: Views) -> DataFrame:
    return ev.average_precision(v.predictions()).select(r6("average_precision", "average_precision"))


@query
def roc_curve(v: Views) -> DataFrame:
    return ev.roc_curve(v.predictions()).select(r6("threshold", "threshold"), r6("fpr", "fpr"), r6("tpr", "tpr"))


@query
def roc_auc(v: Views) -> DataFrame:
    return ev.roc_auc(v.predictions()).select(r6("roc_auc", "roc_auc"))


@query
def score_running_totals(v: Views) -> DataFrame:
    """Running counts along the distinct prices of the line items."""
    per = v.table("lineitem").groupBy(F.col("l_extendedprice").alias("price")).agg(F.count(F.lit(1)).alias("n"))
    return rk.running_sums(per, "price", ["n"], rows_per_block=10_000).select("price", "n", "cum_n")


# --- sources and sinks -----------------------------------------------------------------------------------


@query
def claims_tsv_round_trip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "claims-tsv")
    writers.write_tsv(v.claims().select("patent_id", "claim_sequence", "claim_text", "dependent", "claim_number"), path)
    return readers.read_issued_claims(v.spark, path)


@query
def applications_csv_round_trip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "applications-csv")
    writers.write_csv(v.applications(), path)
    return readers.read_applications(v.spark, path).select(*v.applications().columns)


@query
def scored_by_year(v: Views) -> DataFrame:
    """Yearly partitions written, read back and counted by year and label."""
    path = scratch_path(v.spark, "scored")
    scored = v.scored_claims().withColumn("year", (F.lit(2010) + cl.to_int_id("patent_id") % 7).cast("int"))
    writers.write_scored(scored, path, full_text=False)
    return ct.value_counts(v.spark.read.parquet(path).select("year", "predicted_label"), "year", "predicted_label")


@query
def scored_full_text_by_year(v: Views) -> DataFrame:
    """Yearly partitions with full texts, written and read back."""
    path = scratch_path(v.spark, "scored-texts")
    labelled = v.claims().select("patent_id", "claim_sequence", "claim_text", (F.col("claim_sequence") % 2).cast("int").alias(
        "predicted_label"), "year")
    writers.write_scored(labelled, path)
    return v.spark.read.parquet(path).select("patent_id", "claim_sequence", "claim_text", "predicted_label", "year")


@query
def yearly_scored_files(v: Views) -> DataFrame:
    """Loose yearly files read as one table, the year taken from their names."""
    path = scratch_path(v.spark, "yearly")
    scored = v.scored_claims().withColumn("year", (F.lit(2010) + cl.to_int_id("patent_id") % 7).cast("int"))
    writers.write_yearly_files(scored.select("patent_id", "claim_sequence", "`1`", "predicted_label", "year"), path)
    schema = T.StructType.fromDDL("patent_id string, claim_sequence long, `1` double, predicted_label int")
    return readers.read_yearly_files(v.spark, path, schema).groupBy("year", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patent_id").alias("patents"), r6(F.sum("1"), "score_sum"))


@query
def training_round_trip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "training")
    writers.write_training(v.training().select("app_id", "claim_text", "treated"), main_classes(v), path)
    return readers.read_training(v.spark, path)[0]


@query
def report_round_trip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "report")
    writers.write_report(ev.classification_report(v.predictions()), path)
    return readers.read_report(v.spark, f"{path}/json")


@query
def orphan_claims(v: Views) -> DataFrame:
    """Claims of documents that are no granted patent."""
    keyed = v.claims().select(cl.to_int_id("patent_id").alias("patent_id"), "claim_sequence")
    return anti(keyed, granted_ids(v), "patent_id")


def csv_round_trip(v: Views, df: DataFrame, read, sep: str) -> DataFrame:
    path = scratch_path(v.spark, "raw")
    (writers.write_tsv if sep == "\t" else writers.write_csv)(df, path)
    return read(v.spark, path)


@query
def pregrant_claims_tsv_round_trip(v: Views) -> DataFrame:
    raw = v.pregrant_claims().withColumnRenamed("document_number", "pgpub_id")
    return csv_round_trip(v, raw, readers.read_pregrant_claims, "\t").drop("claim_number")


@query
def office_actions_csv_round_trip(v: Views) -> DataFrame:
    out = csv_round_trip(v, v.office_actions(), readers.read_office_actions, ",")
    return out.select(*v.office_actions().columns)


@query
def rejections_csv_round_trip(v: Views) -> DataFrame:
    return csv_round_trip(v, v.rejections(), readers.read_rejections, ",")


@query
def publications_tsv_round_trip(v: Views) -> DataFrame:
    return csv_round_trip(v, v.publications_raw(), readers.read_publications, "\t")


@query
def cpc_tsv_round_trip(v: Views) -> DataFrame:
    return csv_round_trip(v, v.cpc(), readers.read_cpc, "\t").select(*v.cpc().columns)


@query
def uspc_tsv_round_trip(v: Views) -> DataFrame:
    return csv_round_trip(v, v.uspc(), readers.read_uspc, "\t").select("patent_id", "mainclass_id")


@query
def uspc_pregrant_tsv_round_trip(v: Views) -> DataFrame:
    out = csv_round_trip(v, v.uspc_pregrant(), readers.read_uspc_pregrant, "\t")
    return out.select("document_number", "uspc_mainclass_id")


@query
def cpc_pregrant_tsv_round_trip(v: Views) -> DataFrame:
    return csv_round_trip(v, v.cpc_pregrant(), readers.read_cpc_pregrant, "\t").drop("cpc_group")


@query
def patents_tsv_round_trip(v: Views) -> DataFrame:
    return csv_round_trip(v, v.patents(), readers.read_patents, "\t").drop("patent_type")


@query
def extracts_by_partition(v: Views) -> DataFrame:
    """Extracts of both origins written by partition; one role and origin read back."""
    path = scratch_path(v.spark, "extracts")
    issued = co.independent_claims(v.claims(), "issued").select(
        "claim_text", "year", F.lit("main").alias("cohort"), F.lit("control").alias("role"), F.lit("issued").alias("origin"))
    pregrant = app_claims(v).select(
        "claim_text", F.col("filing_year_PregrantApp").alias("year"), F.lit("main").alias("cohort"),
        F.lit("treated").alias("role"), F.lit("pregrant").alias("origin"))
    writers.write_extracts(ct.union_rows(issued, pregrant), path)
    return readers.read_extracts(v.spark, path, "main", "control", "issued").select("claim_text", "year")


@query
def analysis_tables(v: Views) -> DataFrame:
    """Panel written as the sample table and read back with the columns in use."""
    path = scratch_path(v.spark, "panel")
    panel(v).write.mode("overwrite").parquet(path)
    return v.spark.read.parquet(path).select("group_id", "quarter_issue_date_dt", "Treated", "Count", "Post")


@query
def custom_tokenizer_counts(v: Views) -> DataFrame:
    """Stemmed words over two characters, stop words and their stems dropped."""
    from docketry.models.features import token_column

    return tm.term_counts(v.training(), token_column("custom", F.col("claim_text")), "treated")


@query
def unknown_numbers_null_safe(v: Views) -> DataFrame:
    """Applications without utility number matched to each other by null-safe join, counted per side."""
    apps = co.with_application_keys(v.applications())
    left = ct.value_counts(apps, "patent_num")
    right = ct.value_counts(apps.filter(F.col("status") == cl.PATENTED_STATUS_CODE), "patent_num").withColumnRenamed(
        "count", "granted")
    return null_safe_join(left, right, "patent_num").select("patent_num", "count", "granted")
