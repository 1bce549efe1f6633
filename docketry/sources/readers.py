"""Readers for the raw tables and for tables written by the flows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docketry.functions.claims import to_date, to_int_id
from docketry.sources import schemas

Paths = str | Sequence[str]


def _so_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with what their split holds up to them; a split's lines come one after the other to one task.

    Added: quotes, lines and odd lines up to the line, itself included, and
    whether the line is odd: the quotes before it are.
    """
    last, carried = None, [0, 0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        file, split = b.column("file"), b.column("split").to_numpy()
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (split[1:] != split[:-1])
        fresh[0] = (file[0].as_py(), split[0]) != last
        begin, segment = np.flatnonzero(fresh), np.cumsum(fresh) - 1  # segment -1 goes on from the batch before

        def running(x: np.ndarray, before: int, begin=begin, segment=segment) -> np.ndarray:
            total = np.cumsum(x)
            return total - np.append(total[begin] - x[begin], -before)[segment]

        quotes = b.column("quotes").to_numpy().astype(np.int64)
        so_far = running(quotes, carried[0])
        odd = (so_far - quotes) % 2
        added = [so_far, running(np.ones(b.num_rows, np.int64), carried[1]), running(odd, carried[2])]
        last, carried = (file[-1].as_py(), split[-1]), [int(x[-1]) for x in added]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (*added, odd))],
                                         names=[*b.schema.names, "quotes_so_far", "n", "n_odd", "odd"])


def quoted_records(spark: SparkSession, path: Paths) -> DataFrame:
    """``(file, record)``: the records of delimited files whose quoted values may hold line breaks, headers left out.

    Lines are read in splits. A line starts a record if the quotes before it in
    its file are even in number (a doubled quote inside a value changes
    nothing), which follows from the lines before it in its split and one row of
    totals for each split. The lines of a split are numbered as they are read,
    none is held or exchanged; most records are one line and stay where they
    are, the lines of the others meet by record.
    Quotes must stand around values, and doubled inside them, alone.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"),
        "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    kinds = "file string, split long, at long, value string, quotes int"
    more = "quotes_so_far long, n long, n_odd long, odd long"
    counted = lines.select("file", "split", "quotes").mapInArrow(_so_far, f"file string, split long, quotes int, {more}")
    lines = lines.mapInArrow(_so_far, f"{kinds}, {more}")
    splits = counted.groupBy("file", "split").agg(  # running numbers never fall
        (F.max("quotes_so_far") % 2).alias("turn"), F.max("n").alias("n_lines"), F.max("n_odd").alias("n_turned"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("turn").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("inside") == 0, F.col("n_lines") - F.col("n_turned")).otherwise(F.col("n_turned"))
    splits = splits.withColumn("starts", F.coalesce(F.sum(starts).over(earlier), F.lit(0))).select(
        "file", "split", "inside", "starts")
    placed = lines.join(F.broadcast(splits), ["file", "split"])
    own = F.when(F.col("inside") == 0, F.col("n") - F.col("n_odd")).otherwise(F.col("n_odd"))
    placed = placed.select("file", "split", "at", "value", "quotes", (F.col("starts") + own).alias("number"),
                           (F.col("odd") == F.col("inside")).alias("start"))
    whole = F.col("start") & (F.col("quotes") % 2 == 0)
    single = placed.filter(whole).select("file", "number", F.col("value").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    several = placed.filter(~whole).groupBy("file", "number").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"))
    records = single.union(several).filter("number > 1")  # the first of a file is its header
    return records.select("file", F.regexp_replace("record", "\r$", "").alias("record")).filter(F.trim("record") != "")


def _delimited(
    spark: SparkSession, path: Paths, schema: T.StructType, sep: str, multi_line: bool = False
) -> DataFrame:
    """Delimited text with quoted values.

    Columns are matched by header name: the file may hold more columns, in any
    order; files of one call have one header. Files are read in splits, also
    where claim texts hold line breaks (``quoted_records``).
    """
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', inferSchema=False, enforceSchema=False)
    present = list(raw.columns)
    if multi_line:
        kinds = ", ".join(f"c{i} string" for i in range(len(present)))
        parsed = F.from_csv("record", kinds, {"sep": sep, "quote": '"', "escape": '"'})
        raw = quoted_records(spark, path).select("file", parsed.alias("row")).select(
            F.col("file").alias("_file"), *[F.col("row")[f"c{i}"].alias(name) for i, name in enumerate(present)])
    kept = [F.col("_file")] if multi_line else []
    return raw.select(*kept, *[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def read_tsv(spark: SparkSession, path: Paths, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    return _delimited(spark, path, schema, "\t", multi_line).select(*schema.names)


def read_csv(spark: SparkSession, path: Paths, schema: T.StructType) -> DataFrame:
    return _delimited(spark, path, schema, ",")


def read_issued_claims(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.ISSUED_CLAIMS, multi_line=True)


def read_pregrant_claims(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.PREGRANT_CLAIMS, multi_line=True).withColumnRenamed("pgpub_id", "document_number")


def read_applications(spark: SparkSession, path: Paths) -> DataFrame:
    """Either vintage: one serves status codes, the other classes and patent numbers."""
    return read_csv(spark, path, schemas.APPLICATIONS)


def read_office_actions(spark: SparkSession, path: Paths) -> DataFrame:
    return read_csv(spark, path, schemas.OFFICE_ACTIONS)


def read_rejections(spark: SparkSession, path: Paths) -> DataFrame:
    return read_csv(spark, path, schemas.REJECTIONS)


def read_publications(spark: SparkSession, path: Paths) -> DataFrame:
    return publications(read_tsv(spark, path, schemas.PUBLICATIONS))


def publications(raw: DataFrame) -> DataFrame:
    """Publication rows with document number, application id, filing date and year."""
    date = to_date("filing_date")
    return raw.select(
        F.col("pgpub_id").alias("document_number"),
        to_int_id("application_id").alias("app_id"),
        date.alias("filing_date_dt"),
        F.year(date).alias("filing_year"),
    )


def read_cpc(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.CPC_GRANTED)


def read_uspc(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.USPC_GRANTED)


def read_uspc_pregrant(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.USPC_PREGRANT).withColumnRenamed("pgpub_id", "document_number")


def read_cpc_pregrant(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.CPC_PREGRANT).withColumnRenamed("pgpub_id", "document_number")


def read_patents(spark: SparkSession, path: Paths) -> DataFrame:
    return read_tsv(spark, path, schemas.PATENTS)


def read_extracts(spark: SparkSession, path: str, cohort: str, role: str, origin: str) -> DataFrame:
    """Claim extracts of one cohort, role (treated / control) and origin; a partition filter."""
    return spark.read.parquet(path).filter(
        (F.col("cohort") == cohort) & (F.col("role") == role) & (F.col("origin") == origin)
    )


def year_from_file_name(path: str | F.Column) -> F.Column:
    """Four-digit year in the base name; directory names are not looked at."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\d{4}", 0).try_cast("int")


def read_yearly_files(spark: SparkSession, path: Paths, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Loose yearly files as one table tagged with the year of the file name."""
    raw = _delimited(spark, path, schema, sep, multi_line=True)
    return raw.select(*[f"`{name}`" for name in schema.names], year_from_file_name("_file").alias("year"))


def read_training(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/training_data"), spark.read.parquet(f"{path}/main_classes")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Class rows of a saved report, three decimals, renamed for display."""
    rows = spark.read.schema("`class` string, `metric` string, `value` double").json(path)
    wide = (
        rows.filter(F.col("class").isin("0", "1"))
        .groupBy("class")
        .pivot("metric", ["precision", "recall", "f1-score", "support"])
        .agg(F.round(F.first("value"), 3))
    )
    return wide.select(
        F.when(F.col("class") == "0", "valid").otherwise("invalid").alias("outcome"),
        F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
        F.col("f1-score").alias("F1"), F.col("support").alias("Support"),
    )
