"""One hand row per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry.functions import claims as cl
from docketry.functions import tokens as tk
from docketry.functions.porter import stem, stop_words_with_stems


def values(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_norm_class(spark):
    rows = ["0705.0", "D14", "000", None]
    assert values(spark, rows, cl.norm_class("x")) == ["705", "D14", "", None]
    assert values(spark, rows, cl.norm_class("x", missing="nan"))[-1] == "nan"


def test_to_int_id(spark):
    rows = ["705.0", "1e3", "D123456", "nan", "12345678901234567"]
    assert values(spark, rows, cl.to_int_id("x")) == [705, 1000, None, None, 12345678901234567]


def test_bad_dates_become_null(spark):
    assert values(spark, ["2014-06-19", "n/a", None], cl.to_date("x")) == [dt.date(2014, 6, 19), None, None]


def test_publication_number(spark):
    assert set(values(spark, ["US20130123456A1", "20130123456"], cl.clean_publication_number("x"))) == {"20130123456"}


def test_claim_number_forms(spark):
    rows = ["12 . A method", "1234. x", "7. B\u0009"]
    assert values(spark, rows, cl.strip_claim_number("x", "issued")) == [". A method", "1234. x", "B"]
    assert values(spark, rows, cl.strip_claim_number("x", "pregrant")) == ["A method", "1234. x", "B"]


def test_quarter_end_moves_on_quarter_ends(spark):
    rows = ["2014-06-29", "2014-06-30", "2013-12-31"]
    got = values(spark, rows, cl.quarter_end(cl.to_date("x")))
    assert got == [dt.date(2014, 6, 30), dt.date(2014, 9, 30), dt.date(2014, 3, 31)]
    assert values(spark, ["2014-06-30", "2014-03-31"], cl.post_flag(cl.to_date("x"))) == [1, 0]


def test_claim_reference_is_case_sensitive(spark):
    rows = ["as in claim 1", "as in Claim 1", "claims 2", "claim one"]
    assert values(spark, rows, cl.refers_to_claim("x")) == [True, False, True, False]


def test_cancelled(spark):
    rows = ["(canceled)", "(cancelled)", "1-20. (canceled)", "a long text that says canceled somewhere"]
    assert values(spark, rows, cl.is_cancelled("x")) == [True, False, True, False]


def test_independence_differs_by_origin(spark):
    rows = [None, "-1", "0", "-1.0"]
    assert values(spark, rows, cl.is_independent("x", "issued")) == [True, True, False, True]
    assert values(spark, rows, cl.is_independent("x", "pregrant")) == [True, False, False, False]


def test_flags_pass_unless_one(spark):
    assert values(spark, [None, 0, 1], cl.flag_is_not_one("x"), "x int") == [True, True, False]


def test_claim_list_items_are_not_trimmed(spark):
    rows = [(5, "1,5,12"), (1, "11,12"), (5, "1, 5")]
    assert values(spark, rows, cl.in_claim_list("c", "x"), "c int, x string") == [True, False, False]


def test_right_publication(spark):
    rows = [("020130123456.0", "US20130123456A1"), ("000", "US1A1"), ("7", "US8A1")]
    assert values(spark, rows, cl.right_publication("a", "b"), "a string, b string") == [True, True, False]


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"),
    ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"),
    ("generalizations", "gener"), ("hopefulness", "hope"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"),
])
def test_stem(word, expected):
    assert stem(word) == expected


def test_tokens(spark):
    text = ["<b>The</b> METHOD, of 3 claims: computing_x  ab"]
    assert values(spark, text, tk.clean_tokens("x", ["the"])) == [["method", "claims", "computing"]]
    assert values(spark, ["Ünï x ab_1"], tk.word_tokens("x")) == [["ünï", "ab_1"]]
    grams = values(spark, ["aa bb cc"], tk.ngrams(F.split("x", " "), 1, 3))[0]
    assert grams == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert values(spark, ["aa"], tk.ngrams(F.split("x", " "), 2, 3)) == [[]]


def test_stop_word_parity_keeps_all(spark):
    tokens = F.split("x", " ")
    assert values(spark, ["the method"], tk.without_stop_words(tokens, ["the"])) == [["method"]]
    assert values(spark, ["the method"], tk.without_stop_words(tokens, ["the"], parity=True)) == [["the", "method"]]
    assert {"having", "have"} <= set(stop_words_with_stems(["having"])) | {"have"}
