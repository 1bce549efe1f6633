"""Stems by column expressions against the same rules in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import porter
from docketry.functions import tokens as tk
from docketry.models.features import token_column


def random_words(n):
    draw = random.Random(4)
    heads = ["", "y", "s", "tr", "relat", "hop", "fall", "fizz", "agr", "happ", "conflat", "triplic", "electr", "rate", "oyy", "yy", "yyyy",
             "ayyb", "contr", "probat", "ää", "x1", "adopt", "wyy", "by", "gyyyb", "vi"]
    ends = [s for s, _ in porter.STEP2 + porter.STEP3] + porter.STEP4 + [
        "s", "sses", "ies", "ss", "eed", "ed", "ing", "y", "e", "ll", "le", "at", "bl", "iz", "", "ly", "yed", "ying", "ion"]
    words = {a + draw.choice(["", "e", "o", "yo", "bb", "ll", "ak", "t"]) + b + draw.choice(["", "", "s", "ed", "ing", "e"])
             for a in heads for b in ends}
    words |= {"".join(draw.choice("aeiouybcdlmnstxwz") for _ in range(draw.randint(1, 12))) for _ in range(n)}
    return sorted(words)


def test_every_rule(spark):
    words = random_words(8000)
    df = spark.createDataFrame([(words[i:i + 50],) for i in range(0, len(words), 50)], "t array<string>")
    got = [s for r in df.select("t", porter.stem_tokens("t").alias("s")).collect() for s in zip(r["t"], r["s"])]
    assert [(w, s) for w, s in got if porter.stem(w) != s] == [] and len(got) == len(words)
    shapes = df.select(F.explode("t").alias("w")).select("w", porter._shape_of(F.col("w")).alias("s")).collect()
    assert all(porter._shape(r["w"]) == r["s"] for r in shapes)


def test_words_of_the_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    try:
        docs = spark.read.parquet(path)
    except Exception:
        pytest.skip("no test tables")
    words = docs.select(F.explode(tk.word_tokens("text")).alias("w")).distinct()
    rows = words.select("w", porter.stem_word("w").alias("s")).collect()
    assert len(rows) > 3000 and all(porter.stem(r["w"]) == r["s"] for r in rows)


def test_nulls_and_no_python(spark):
    df = spark.createDataFrame([([],), (None,), (["running", None, "at"],)], "t array<string>")
    assert [r[0] for r in df.select(porter.stem_tokens("t")).collect()] == [[], None, ["run", None, "at"]]
    texts = spark.createDataFrame([("the motoring hopes",)], "x string")
    plan = texts.select(token_column("default", F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
