"""From raw documents to packed training bins: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import mixing, packing, simhash, suffix_dedup, toxicity
from docketry.llm.common import landed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# The stages fit models and merge suffix runs, which SQL cannot say; tests/llm/test_pipeline.py checks each by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic leave; all others stay as they are."""
    return toxicity.drop_toxic(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group stays; of repeated rows one stays."""
    kept = simhash.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    first = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(COLUMNS)
    return first.dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go; every document stays, its text what is left."""
    out = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    times = mixing.mix(docs).filter("taken > 0").groupBy(F.col("doc_id").alias("mix_id")).agg(
        F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    mixed = docs.join(times, docs["doc_id"].eqNullSafe(times["mix_id"]))
    return mixed.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written under ``spark.checkpoint.dir`` before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
