"""Relational queries next to their SQL on the smallest tables."""

import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

import pandas as pd  # noqa: E402
from check_oracle import plain  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

ORACLE = entry.oracle_sql()
# A cross-section; tools/check_oracle.py runs all of them on larger tables.
SMALL = [
    "numeric_ids", "norm_class_counts", "quarter_end_buckets", "claim_number_strip", "cancelled_claims",
    "independent_claims", "pregrant_independent_claims", "pure_subject_matter_rejections", "treated_claims",
    "attrition_funnel", "control_cohort_anti", "control_cohort_101", "class_cumulative_share", "cell_frequencies",
    "weighted_sample", "stratified_split", "dedup_first", "affected_patents", "application_targets_by_class",
    "raw_subset_cascade", "did_panel", "did_clustered_errors", "poisson_regression", "clean_token_counts",
    "ngram_counts", "tfidf_weights", "differential_terms", "naive_bayes_scores", "knn_vote", "lime_top_words",
    "classification_report", "average_precision", "roc_curve", "claims_tsv_round_trip", "report_round_trip",
    "unknown_numbers_null_safe",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, con, name):
    out = entry.queries()[name](spark, DATA)
    got = pd.DataFrame([tuple(r) for r in out.collect()], columns=out.columns)
    cur = con.execute(ORACLE[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
