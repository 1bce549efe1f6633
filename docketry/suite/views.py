"""Claim-analytics views over the given star-schema tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables with costly work per row.

# Decision date on the time scale of the given tables.
DECISION = dt.date(1998, 6, 19)


def text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def flag(cond: F.Column) -> F.Column:
    return cond.cast("int")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _lines(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")
        )

    def claims(self) -> DataFrame:
        """Issued claims, one per line of a document."""
        d, pos = F.col("doc_id"), F.col("pos")
        number = text(pos + 1)
        body = F.when((d * 7 + pos) % 11 == 0, F.concat(number, F.lit(". (canceled)"))).otherwise(
            F.concat(number, F.lit(". "), F.col("line"), F.when((d + pos) % 5 == 0, " as in claim 1").otherwise(""))
        )
        dependent = F.when(pos % 4 == 1, "0").when(pos % 4 == 2, "-1")
        return self._lines().select(
            text("doc_id").alias("patent_id"), pos.alias("claim_sequence"), (pos + 1).alias("claim_number"),
            dependent.alias("dependent"), body.alias("claim_text"), "source",
            (F.lit(2010) + d % 7).cast("int").alias("year"),
        )

    def pregrant_claims(self) -> DataFrame:
        d, pos = F.col("doc_id"), F.col("pos")
        number = text(pos + 1)
        sep = F.when(d % 2 == 0, ". ").otherwise(" . ")
        body = F.when((d * 7 + pos) % 11 == 0, F.concat(number, F.lit(". (canceled)"))).otherwise(
            F.concat(number, sep, F.col("line"), F.when((d + pos) % 5 == 0, " of claims 2").otherwise(""))
        )
        return self._lines().select(
            text(F.lit(20000000000) + d).alias("document_number"), pos.alias("claim_sequence"),
            F.when(pos % 3 == 1, "claim 1").alias("dependent"), body.alias("claim_text"),
        )

    def applications(self) -> DataFrame:
        k, filed = F.col("o_orderkey"), F.to_date("o_orderdate")
        granted = F.col("o_orderstatus") == "F"
        o = self.table("orders").join(
            self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        )
        return o.select(
            text(k).alias("application_number"),
            text(filed).alias("filing_date"),
            F.concat(F.lit("0"), text("c_nationkey"), F.lit(".0")).alias("uspc_class"),
            F.when(granted, "150.0").when(F.col("o_orderstatus") == "O", "161.0").otherwise("41.0").alias("appl_status_code"),
            F.when(k % 97 == 0, "n/a").otherwise(
                text(F.date_add(filed, (F.lit(900) + k % 200).cast("int")))
            ).alias("appl_status_date"),
            F.when(k % 10 == 0, F.concat(F.lit("D"), text(k))).otherwise(text(k)).alias("patent_number"),
            F.when(granted, text(F.date_add(filed, (F.lit(300) + k % 400).cast("int")))).alias("patent_issue_date"),
            F.concat(F.lit("US"), text(F.lit(20000000000) + k), F.lit("A1")).alias("earliest_pgpub_number"),
            text(F.date_add(filed, (k % 30 - 2).cast("int"))).alias("earliest_pgpub_date"),
        )

    def office_actions(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self.table("lineitem").select(
            text("l_orderkey").alias("app_id"),
            F.concat(F.lit("00"), text("l_partkey"), F.lit(".0")).alias("ifw_number"),
            text(F.to_date("l_shipdate")).alias("mail_dt"),
            flag(F.col("l_suppkey") % 20 == 0).alias("rejection_fp_mismatch"),
            flag(F.col("l_returnflag") == "R").alias("rejection_101"),
            flag(line == 2).alias("rejection_102"),
            flag(F.col("l_linestatus") == "F").alias("rejection_103"),
            F.when(line % 2 == 0, F.lit(0)).alias("rejection_112"),
            F.when(line != 7, F.lit(0)).alias("rejection_dp"),
        )

    def rejections(self) -> DataFrame:
        line, f = F.col("l_linenumber"), F.col("l_returnflag")
        return self.table("lineitem").filter(f != "N").select(
            text("l_orderkey").alias("app_id"), text("l_partkey").alias("ifw_number"),
            flag(f == "R").alias("alice_in"), flag(line == 3).alias("bilski_in"),
            flag(line == 4).alias("mayo_in"), F.when(line > 5, F.lit(1)).alias("myriad_in"),
            F.concat(text(line), F.lit(","), text(line + 2)).alias("claim_numbers"),
        )

    def publications_raw(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            text(F.lit(20000000000) + k).alias("pgpub_id"), text(k).alias("application_id"),
            text(F.to_date("o_orderdate")).alias("filing_date"),
        )

    def _classified(self) -> DataFrame:
        return self.table("lineitem").join(
            self.table("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")
        )

    def cpc(self) -> DataFrame:
        return self._classified().select(
            text("l_orderkey").alias("patent_id"), (F.col("l_linenumber") - 1).alias("cpc_sequence"),
            F.when(F.col("l_tax") < 0.05, "inventional").otherwise("additional").alias("cpc_type"),
            F.col("p_brand").alias("cpc_subclass"), F.col("p_type").alias("cpc_group"),
        )

    def cpc_pregrant(self) -> DataFrame:
        return self._classified().select(
            text(F.lit(20000000000) + F.col("l_orderkey")).alias("pgpub_id"),
            F.when(F.col("l_tax") < 0.05, "inventional").otherwise("additional").alias("cpc_type"),
            F.when(F.col("l_linestatus") == "F", "2013-01-01").otherwise("2016-08-01").alias("cpc_version_indicator"),
            F.col("p_brand").alias("cpc_subclass"),
        )

    def _supplied(self) -> DataFrame:
        return self.table("lineitem").join(
            self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
        )

    def uspc(self) -> DataFrame:
        return self._supplied().select(
            text("l_orderkey").alias("patent_id"),
            F.concat(F.lit("0"), text("s_nationkey"), F.lit(".0")).alias("mainclass_id"),
        )

    def uspc_pregrant(self) -> DataFrame:
        return self._supplied().select(
            text(F.lit(20000000000) + F.col("l_orderkey")).alias("pgpub_id"),
            F.concat(F.lit("0"), text("s_nationkey")).alias("uspc_mainclass_id"),
        )

    def patents(self) -> DataFrame:
        return self.table("orders").select(
            text("o_orderkey").alias("patent_id"), text(F.to_date("o_orderdate")).alias("patent_date"),
            flag(F.col("o_orderkey") % 50 == 0).alias("withdrawn"),
        )

    def scored_claims(self) -> DataFrame:
        return self.table("lineitem").select(
            text("l_orderkey").alias("patent_id"), (F.col("l_linenumber") - 1).alias("claim_sequence"),
            F.round(1 - F.col("l_discount") * 5, 6).alias("0"), F.round(F.col("l_discount") * 5, 6).alias("1"),
            flag(F.col("l_discount") >= 0.05).alias("predicted_label"),
        )

    def _labelled(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id")

    def training(self) -> DataFrame:
        return self._labelled().select(
            F.col("doc_id").alias("app_id"), F.col("text").alias("claim_text"),
            (1 - F.col("quality")).alias("treated"), F.col("lang").alias("uspc_class_str"),
            (F.col("doc_id") % 5).cast("int").alias("filing_year"),
        )

    def predictions(self) -> DataFrame:
        label = 1 - F.col("quality")
        score = ((F.col("doc_id") * 37) % 101 + 40 * label) / F.lit(141.0)
        return self.table("labels").select(
            "doc_id", label.alias("label"), score.alias("score"), flag(score >= 0.5).alias("prediction")
        )

    def word_weights(self) -> DataFrame:
        """Raw word weights: every distinct word of a document with a weight from keys."""
        from docketry.functions.tokens import word_tokens

        words = self.table("documents").select(
            "doc_id", F.explode(F.array_distinct(word_tokens("text"))).alias("word")
        )
        weight = ((F.col("doc_id") * 31 + F.length("word") * 17) % 201 - 100) / F.lit(997.0)
        return words.select("doc_id", "word", weight.alias("weight"))
