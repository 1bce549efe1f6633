"""Partitioned writes: few files in small folders, several in a hot one; yearly files by name."""

import glob
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.sources import readers, writers


def scored(spark, rows, tasks):
    """Nine in ten rows in one year, dealt over many tasks."""
    ids = spark.range(rows).repartition(tasks)
    year = F.when(F.col("id") % 10 == 0, 2010 + F.col("id") % 7).otherwise(2014).cast("int")
    return ids.select(F.col("id").cast("string").alias("patent_id"), (F.col("id") % 3).alias("claim_sequence"),
                      F.sha2(F.col("id").cast("string"), 512).alias("claim_text"), (F.col("id") % 2).cast("int").alias("predicted_label"),
                      year.alias("year"))


def per_folder(path):
    return {os.path.basename(f): len(glob.glob(f"{f}/*.parquet")) for f in glob.glob(f"{path}/year=*")}


def test_files_per_folder_are_bounded(spark, tmp_path):
    df = scored(spark, 2_000, 40)
    writers.write_scored(df, str(tmp_path / "out"))
    files = per_folder(tmp_path / "out")
    assert len(files) == 7 and max(files.values()) <= 2
    back = spark.read.parquet(str(tmp_path / "out")).select(df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_hot_year_is_split(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        writers.write_scored(scored(spark, 60_000, 24), str(tmp_path / "out"))
    finally:
        spark.conf.set(name, before)
    files = per_folder(tmp_path / "out")
    # years dealt to the hot year's partition are split along with it; 24 tasks would leave 24 files in each of 7 folders
    assert files["year=2014"] > 4 and sum(files.values()) < 24 * 7 / 2


def test_yearly_files(spark, tmp_path):
    df = scored(spark, 500, 10).withColumn("claim_text", F.lit('a "quoted" text,\nof two lines'))
    writers.write_yearly_files(df, str(tmp_path / "2099"))
    names = [os.path.basename(f) for f in glob.glob(str(tmp_path / "2099" / "*.csv"))]
    assert len(names) >= 7 and all(n.startswith("claims_201") for n in names)
    schema = T.StructType.fromDDL("patent_id string, claim_sequence long, claim_text string, predicted_label int")
    back = readers.read_yearly_files(spark, str(tmp_path / "2099"), schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
