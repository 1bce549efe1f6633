"""SimHash near-dedup by multi-index hashing (Charikar, 2002; Norouzi et al., 2012)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import begin, components, landed, view

SHINGLE = 3  # words
RADIUS = 3  # differing bits that still link
TILE = 4096  # table fingerprints a hot bucket is compared with per slice


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist())
    h = np.array([digest(whole[s:e], 42) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts in slices
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; fp is the fingerprint's 64 bits as a signed long."""
    return view(docs, id=id_col, text=text_col).mapInArrow(_fingerprints, "id long, fp long")


def _forest(table: np.ndarray, probes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges within the radius, as few as join what is joined: no pair is needed whose ends already meet."""
    label = np.arange(len(table))
    for p in probes:
        near = np.flatnonzero(np.bitwise_count((table ^ p).view(np.uint64)) <= RADIUS)
        groups = np.unique(label[near])
        for g in groups:
            if table[g] != p:
                yield int(p), int(table[g])
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of every (key, salt) run of a sorted partition; a run may span batches."""
    held = np.empty((0, 4), np.int64)

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        out = []
        if len(rows):
            cuts = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            bounds = np.concatenate(([0], cuts, [len(rows)]))
            for k in np.flatnonzero(np.diff(bounds) > 1):
                run = rows[bounds[k]:bounds[k + 1]]
                table = run[run[:, 3] != 1, 2]
                if len(table):
                    out.extend(_forest(table, run[run[:, 3] != 0, 2]))
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    for b in batches:
        rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        held = np.concatenate([held, rows]) if len(held) else rows
        same = (held[:, 0] == held[-1, 0]) & (held[:, 1] == held[-1, 1]) if len(held) else np.empty(0, bool)
        keep = int(len(held) - np.argmin(same[::-1])) if not same.all() else 0
        if keep:
            yield edges(held[:keep])
            held = held[keep:]
    yield edges(held)


def link_edges(fps: DataFrame) -> DataFrame:
    """``(a, b)`` edges between distinct fingerprints at most three bits apart, enough to join all that are linked.

    Two halves of 32 bits: of three differing bits one half has one at most.
    Each fingerprint enters the table under both halves, and probes it with
    each half's ball of radius one; of two neighbours the one with a 0 in the
    differing bit probes, so only those bits are flipped. Matches are verified
    on all 64 bits. A bucket of many table entries is cut into slices: every
    slice holds the table, and its share of the probes.
    """
    table = fps.select("fp", F.explode(F.array(
        F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32) | 4294967296L"))).alias("key"))
    flips = fps.select("fp", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(fp, i) & 1L = 0L)")).alias("i"))
    probes = flips.select("fp", F.expr(
        "CASE WHEN i < 32 THEN (fp & 4294967295L) | shiftleft(1L, i)"
        " ELSE shiftrightunsigned(fp, 32) | 4294967296L | shiftleft(1L, i - 32) END").alias("key"))
    probes = probes.join(table.select("key"), "key", "left_semi")
    hot = table.groupBy("key").count().filter(F.col("count") > TILE).select(
        "key", F.ceil(F.col("count") / TILE).cast("int").alias("slices"))
    slices = F.coalesce(F.col("slices"), F.lit(1))
    own = F.pmod(F.hash("fp"), slices)
    table = table.join(hot, "key", "left").select(
        "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("salt"))
    # role 0: table only, 1: probe only, 2: both
    table = table.select("key", "salt", "fp", F.when(F.col("own") == F.col("salt"), 2).otherwise(0).alias("role"))
    probes = probes.join(hot, "key", "left").select("key", own.alias("salt"), "fp", F.lit(1).alias("role"))
    rows = table.union(probes).select(*[F.col(c).cast("long").alias(c) for c in ("key", "salt", "fp", "role")])
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
    return rows.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Texts are lower-cased in A-Z and cut at ASCII blanks; three-word shingles,
    repeats included, vote on each bit, and a bit needs more than half. Fewer
    words give one shingle; none (null, empty, blanks) give fingerprint zero,
    which links like any other. Equal fingerprints and those within three bits
    are linked; component_id is the smallest doc_id reachable. Repeated rows
    stay; a null id neither names a component (unless all its ids are null)
    nor is lost; an empty table gives an empty result.

    Copies meet as one fingerprint before anything is compared.
    """
    begin(docs)
    rows = landed(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = landed(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    parts = components(link_edges(fps.select("fp")))
    joined = fps.join(parts, fps["fp"] == parts["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("part"))
    lows = joined.groupBy("part").agg(F.min("low").alias("component_id"))
    named = joined.join(lows, "part").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
