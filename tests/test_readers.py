"""Claim files with line breaks inside quotes, read in splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from docketry.sources import readers, schemas, writers


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "2k")
    yield
    spark.conf.set(name, before)


def claims(n, seed):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = [draw.choice(["a", "claim", 'said "device"', "x\ty", "", "\n", "end\n\n", '"', "ünï"]) for _ in range(draw.randint(0, 30))]
        text = " ".join(words).strip() if draw.random() < 0.9 else "line\n" * draw.randint(1, 400) + "end"
        out.append((str(1000 + i), str(draw.randint(0, 20)), text or "none", draw.choice(["-1", "3"]), str(i)))
    return out


HEADER = ["patent_id", "claim_sequence", "claim_text", "dependent", "claim_number"]


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, delimiter="\t", quoting=csv.QUOTE_ALL, lineterminator=end)
        w.writerow(HEADER)
        w.writerows(rows)


def test_records_across_splits(spark, tmp_path, small_splits):
    """Several files, records longer than a split, doubled quotes, blank lines: as the rows that were written."""
    wanted = []
    for k in range(3):
        rows = claims(150, k)
        wanted += [tuple(r) for r in rows]
        write(tmp_path / f"g_claims_{2011 + k}.tsv", rows, "\r\n" if k == 1 else "\n")
    df = readers.read_issued_claims(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20  # the files are in many splits
    got = df.select(*[F.col(c).cast("string") for c in HEADER]).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_same_as_one_task_reading(spark, tmp_path, small_splits):
    rows = claims(200, 9)
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in HEADER))
    writers.write_tsv(df, str(tmp_path / "out"))
    whole = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, quote='"', escape='"', multiLine=True)
    cut = readers.read_issued_claims(spark, str(tmp_path / "out"))
    as_text = lambda d: sorted(map(tuple, d.select(*[F.col(c).cast("string") for c in HEADER]).collect()))
    assert as_text(cut) == as_text(whole)


def test_year_of_loose_files(spark, tmp_path, small_splits):
    """The year comes from the file's name, not from a folder with four digits; files without rows give none."""
    folder = tmp_path / "run 1999"
    folder.mkdir()
    for year, n in ((2012, 60), (2013, 0), (2014, 25)):
        write(folder / f"scored_{year}_0.tsv", claims(n, year))
    out = readers.read_yearly_files(spark, str(folder), schemas.ISSUED_CLAIMS, sep="\t")
    assert {r["year"]: r["count"] for r in out.groupBy("year").count().collect()} == {2012: 60, 2014: 25}


def test_lines_are_numbered_as_they_are_read(spark, tmp_path):
    """Running numbers of a split go on from batch to batch; no line is held by a window or exchanged to be numbered."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    file, split = np.repeat(["a", "a", "b", "c"], [7, 5, 1, 12]), np.repeat([0, 40, 40, 0], [7, 5, 1, 12])
    quotes = rng.integers(0, 3, 25)
    rows = pa.RecordBatch.from_pydict({"file": pa.array(list(file)), "split": split, "quotes": pa.array(quotes, pa.int32())})
    cuts = [0, 3, 3, 4, 12, 13, 20, 25]
    got = pa.Table.from_batches(readers._so_far(rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))).to_pylist()
    seen = {}
    for i, r in enumerate(got):
        before, n, n_odd = seen.get((file[i], split[i]), (0, 0, 0))
        want = before + quotes[i], n + 1, n_odd + before % 2
        assert (r["quotes_so_far"], r["n"], r["n_odd"], r["odd"]) == (*want, before % 2)
        seen[file[i], split[i]] = want
    (tmp_path / "x_2014.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    records = readers.quoted_records(spark, str(tmp_path))
    assert sorted(r["record"] for r in records.collect()) == ['1,"x\ny"', "2,z"]
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("Window" in line and "quotes" in line for line in plan.splitlines())
