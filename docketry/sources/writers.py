"""Sinks of the flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ["claim_sequence", "0", "1", "predicted_label"]


def by_folder(df: DataFrame, *folders: str) -> DataFrame:
    """Rows dealt by target folder before a partitioned write.

    Without it every task leaves a file in every folder it has a row for.
    Adaptive execution joins small shares to files of its advisory size and
    splits a folder that holds more, so that a hot year is written by many tasks.
    """
    return df.hint("rebalance", *folders)


def land_claims(claims: DataFrame, path: str) -> None:
    """Splittable copy of the claim files, partitioned by year."""
    by_folder(claims, "year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_scored(scored: DataFrame, path: str, full_text: bool = True, id_column: str = "patent_id") -> None:
    """Scored claims by year, with texts or as the prediction-only projection."""
    out = scored if full_text else predictions_only(scored, id_column, keep_year=True)
    by_folder(out, "year").write.mode("overwrite").partitionBy("year").parquet(path)


def predictions_only(scored: DataFrame, id_column: str = "patent_id", keep_year: bool = False) -> DataFrame:
    names = [id_column, *PREDICTION_COLUMNS] + (["year"] if keep_year else [])
    return scored.select(*[f"`{n}`" for n in names])


def write_extracts(extracts: DataFrame, path: str) -> None:
    folders = ["cohort", "role", "origin", "year"]
    by_folder(extracts, *folders).write.mode("overwrite").partitionBy(*folders).parquet(path)


def write_yearly_files(scored: DataFrame, path: str, prefix: str = "claims") -> None:
    """Loose CSV files whose names carry the year, ``<prefix>_<year>_<part>.csv``, on any file system Spark writes to.

    Parts are written by year as elsewhere and then named; only names pass the
    driver, one for each file. ``path`` must not hold such files yet.
    """
    parts = f"{path}/_parts"
    by_folder(scored, "year").write.partitionBy("year").csv(parts, header=True, quote='"', escape='"')
    spark = scored.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(path_of(parts)):
        name = folder.getPath().getName()
        if not name.startswith("year="):
            continue
        found = sorted(f.getPath().toString() for f in files.listStatus(folder.getPath()))
        for k, part in enumerate(f for f in found if f.endswith(".csv")):
            target = path_of(f"{path}/{prefix}_{name[5:]}_{k}.csv")
            if not files.rename(path_of(part), target):
                raise OSError(f"cannot name {target.toString()}")


def write_training(training: DataFrame, main_classes: DataFrame, path: str) -> None:
    training.write.mode("overwrite").parquet(f"{path}/training_data")
    main_classes.write.mode("overwrite").parquet(f"{path}/main_classes")


def write_report(report: DataFrame, path: str) -> None:
    """Long report rows as JSON, and as CSV with three decimals."""
    report.write.mode("overwrite").json(f"{path}/json")
    report.withColumn("value", F.round("value", 3)).write.mode("overwrite").csv(f"{path}/csv", header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with quoted values, doubled quotes inside."""
    df.write.mode("overwrite").csv(
        path, sep="\t", header=True, quoteAll=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""', nullValue="",
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
