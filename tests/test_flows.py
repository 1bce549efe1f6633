"""Flows, sources and sinks on hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry.plans import affected as af
from docketry.plans import cohort as co
from docketry.plans import treatment as tr
from docketry.sources import readers, schemas, writers
from docketry.streaming.scoring import score_new_files


def test_document_with_two_classes_fans_out(spark):
    claims = spark.createDataFrame(
        [("d1", 0, None, "1. A x"), ("d1", 1, None, "2. A y"), ("d1", 2, None, "3. A z"), ("d1", 3, "claim 1", "4. no")],
        "document_number string, claim_sequence int, dependent string, claim_text string")
    apps = spark.createDataFrame([("d1", 7, None, 2010, "705"), ("d1", 7, None, 2010, "463")],
                                 "document_number string, app_id long, filing_date_dt date, filing_year int, c string")
    out = co.extract_application_claims(claims, apps)
    assert out.count() == 6 and {r.claim_text for r in out.collect()} == {"A x", "A y", "A z"}


def applications(spark, rows):
    names = [f.name for f in schemas.APPLICATIONS.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.APPLICATIONS)


def test_control_cohorts(spark):
    base = dict(filing_date="2012-01-05", uspc_class="705", appl_status_code="150", patent_issue_date="2015-01-06")
    apps = applications(spark, [
        {**base, "application_number": "1", "patent_number": "11", "appl_status_code": "161"},  # rejected one
        {**base, "application_number": "2", "patent_number": "12"},  # no action
        {**base, "application_number": "3", "patent_number": "13"},  # other action
        {**base, "application_number": "4", "patent_number": "D14"},  # no utility patent
        {**base, "application_number": "5", "patent_number": "15", "filing_date": "2001-01-01"},  # other year
        {**base, "application_number": None, "patent_number": "16"},  # no key
        {**base, "application_number": "7", "patent_number": "17", "uspc_class": "0D14"},  # other class
        {**base, "application_number": "8", "patent_number": "18"},  # has a subject-matter action
    ])
    actions = spark.createDataFrame([("1", 1), ("3", 0), ("8", 1), (None, 1)], "app_id string, rejection_101 int")
    rejections = spark.createDataFrame([("1",), (None,)], "app_id string")
    out = co.control_cohorts(apps, actions, rejections, 2)
    assert sorted(r.app_id for r in out.no_action.collect()) == [2, 4]
    assert sorted(r.app_id for r in out.no_101.collect()) == [2, 3]
    assert [r[0] for r in out.main_classes.collect()] == ["705"]


def claim_rows(spark, n, start, text):
    rows = [(f"{text} {i}", start + i, f"US{start + i}A1", i % 3, "705" if i % 4 else "463", dt.date(2012 + i % 2, 3, 1),
             dt.date(2015, 1, 6)) for i in range(n)]
    return spark.createDataFrame(rows, "claim_text string, app_id long, earliest_pgpub_number string, claim_int long, "
                                       "uspc_class_str string, filing_date_dt date, patent_issue_date_dt date")


@pytest.mark.parametrize("replacement", [False, True])
def test_balanced_training(spark, replacement):
    treated, controls = claim_rows(spark, 20, 0, "7. treated"), claim_rows(spark, 200, 1000, "8. control")
    treated = treated.unionByName(treated)  # copies
    out = co.balanced_training(treated, controls, co.TrainingConfig(replacement=replacement))
    rows = out.training_data.collect()
    assert sum(r.treated for r in rows) == 20 and len(rows) == 40
    assert all(r.claim_text.startswith(("treated", "control")) for r in rows)
    drawn = [(r.app_id, r.claim_text) for r in rows if not r.treated]
    assert replacement or len(set(drawn)) == 20


def test_too_few_controls_is_an_error(spark):
    with pytest.raises(ValueError):
        co.balanced_training(claim_rows(spark, 20, 0, "t"), claim_rows(spark, 5, 1000, "c"))


def test_class_list_must_be_a_list(spark):
    frame = claim_rows(spark, 4, 0, "t")
    with pytest.raises(TypeError):
        co.class_list(frame, co.TrainingConfig(classes="705"))
    assert co.class_list(frame, co.TrainingConfig(classes=["705"])).first()[0] == "705"


def test_first_claim_with_two_labels_gives_two_rows(spark):
    patents = spark.createDataFrame([("1", "2014-06-30", 0), ("2", "2014-06-29", 1), ("D3", "2014-06-29", 0)],
                                    "patent_id string, patent_date string, withdrawn int")
    cpc = spark.createDataFrame([("1", 0, "inventional", "G06Q", "G06Q10/00"), ("1", 0, "additional", "H04L", "x")],
                                "patent_id string, cpc_sequence int, cpc_type string, cpc_subclass string, cpc_group string")
    scored = spark.createDataFrame([("1", 0, 1), ("1", 0, 0), ("1", 1, 0)],
                                   "patent_id string, claim_sequence int, predicted_label int")
    rows = tr.patent_treatment(patents, cpc, scored).collect()
    assert sorted(r.Treated for r in rows) == [0, 1]
    assert {(r.issue_quarter, r.quarter_issue_date_dt) for r in rows} == {(2, dt.date(2014, 9, 30))}


def test_targets_agree_with_left_joins(spark):
    pubs = spark.createDataFrame([("d1", 1, None, 2012), ("d2", 2, None, 2012), ("d3", 3, None, 2012)],
                                 "document_number string, app_id long, filing_date_dt date, filing_year int")
    uspc = spark.createDataFrame([("d1", "0705"), ("d1", "463"), ("d2", "1")], "document_number string, uspc_mainclass_id string")
    cpc = spark.createDataFrame(
        [("d1", "inventional", "2013-01-01", "G06Q"), ("d1", "inventional", "2016-01-01", "A63F"),
         ("d3", "inventional", "2013-01-01", "G06Q")],
        "document_number string, cpc_type string, cpc_version_indicator string, cpc_subclass string")
    classes = spark.createDataFrame([("705",), ("463",)], "uspc_class_str string")
    groups = spark.createDataFrame([("G06Q", 2)], "group_id string, count long")
    by_class, by_group = af.application_targets(pubs, uspc, cpc, classes, groups)
    wide = af.classified_applications(pubs, uspc, cpc)
    assert sorted(by_class.select("app_id", "uspc_class").collect()) == sorted(
        wide.filter(F.col("uspc_class").isin("705", "463")).select("app_id", "uspc_class").distinct().collect())
    assert sorted(by_group.select("app_id", "group_id").collect()) == sorted(
        wide.filter(F.col("group_id") == "G06Q").select("app_id", "group_id").distinct().collect())


def test_quoted_tsv_round_trip(spark, tmp_path):
    text = 'first line\nsecond "quoted"\tline'
    df = spark.createDataFrame([("1", 0, text, None, 1), ("2", 0, "plain", "-1", 1)], schemas.ISSUED_CLAIMS)
    writers.write_tsv(df, str(tmp_path / "claims"))
    assert sorted(readers.read_issued_claims(spark, str(tmp_path / "claims")).collect()) == sorted(df.collect())


def test_reader_takes_columns_by_name(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('"extra"\t"patent_date"\t"patent_id"\n"x"\t"2014-01-07"\t"123"\n')
    row = readers.read_patents(spark, str(tmp_path / "p.tsv")).first()
    assert (row.patent_id, row.patent_date, row.withdrawn) == ("123", "2014-01-07", None)


def test_yearly_files_take_year_of_base_name(spark, tmp_path):
    folder = tmp_path / "run_1999"
    folder.mkdir()
    for year in (2012, 2013):
        (folder / f"scored_{year}.csv").write_text(f"word,weight\nw{year},0.5\n")
    out = readers.read_yearly_files(spark, str(folder), schemas.EXPLAIN_RAW)
    assert sorted((r.word, r.weight, r.year) for r in out.collect()) == [("w2012", 0.5, 2012), ("w2013", 0.5, 2013)]


def test_extracts_are_chosen_by_partition(spark, tmp_path):
    rows = [("a", "main", "control", "issued", 2012), ("b", "main", "control", "pregrant", 2012),
            ("c", "other", "control", "issued", 2013)]
    df = spark.createDataFrame(rows, "claim_text string, cohort string, role string, origin string, year int")
    writers.write_extracts(df, str(tmp_path / "x"))
    got = readers.read_extracts(spark, str(tmp_path / "x"), "main", "control", "issued")
    assert [r.claim_text for r in got.collect()] == ["a"]


def test_new_files_are_scored_once(spark, tmp_path):
    class Constant:
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector

            p = array_to_vector(F.array(F.lit(0.25), F.lit(0.75)))
            return df.withColumns({"rawPrediction": p, "probability": p, "prediction": F.lit(1.0)})

    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    ids = spark.createDataFrame([(1,), (2,)], "patent_id long")
    for number, year in (("1", 2012), ("2", 2013), ("3", 2013)):
        df = spark.createDataFrame([(number, 0, "1. A text", None, 1)], schemas.ISSUED_CLAIMS)
        df.write.mode("append").parquet(landed)
        q = score_new_files(spark, landed, schemas.ISSUED_CLAIMS, ids, Constant(), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.patent_id, r["1"], r.predicted_label) for r in rows) == [(1, 0.75, 1), (2, 0.75, 1)]
