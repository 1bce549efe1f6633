"""Substring dedup over sentence spans: hash every run of several consecutive sentences, join globally, cut repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import begin, view

SENTENCES = 2  # of a run at least
WORDS = 12  # of a run at least: short sentences such as one-word cries need longer runs
RUNS_AT_ONCE = 1 << 18  # runs a task looks through for repeats of its own before it writes them
NO_ID = -(1 << 63)  # stands for a null id inside
EDGE = re.compile(r"(?<=[.!?])(?=\s)|(?<=\n)")


def sentences(text: str | None) -> list[str]:
    """The text in pieces that end in ``.``, ``!`` or ``?`` before a blank, or in a line break; joined they are the text.

    A piece of blanks alone goes with the piece before it, or with the first;
    a text of blanks alone has no sentence.
    """
    out: list[str] = []
    blanks = ""
    for piece in EDGE.split(text or ""):
        if piece.strip():
            out.append(blanks + piece)
            blanks = ""
        elif out:
            out[-1] += piece
        else:
            blanks += piece
    return out


def runs(pieces: list[str]) -> list[tuple[bytes, int, int]]:
    """``(digest, first, behind last)`` of the shortest run from each sentence with SENTENCES sentences and WORDS words.

    Sentences are compared in lower case with single blanks.
    """
    norm = [" ".join(p.lower().split()) for p in pieces]
    words = [n.count(" ") + 1 if n else 0 for n in norm]
    out, end, held = [], 0, 0
    for i in range(len(pieces)):
        while end < len(pieces) and (end - i < SENTENCES or held < WORDS):
            held += words[end]
            end += 1
        if end - i < SENTENCES or held < WORDS:
            break
        out.append((xxhash.xxh3_128_digest("\n".join(norm[i:end]).encode("utf-8", "surrogatepass")), i, end))
        held -= words[i]
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(h1, h2, id, tie, span, again)``; span = first << 32 | behind last.

    Repeats inside a task's portion are told apart before the exchange: they
    get ``again`` and a key of their own, so a passage of any frequency has one
    row of its hash for each portion.
    """
    seen: dict[bytes, tuple[int, int, int]] = {}
    rows: list[tuple[bytes, int, int, int, bool]] = []

    def flush() -> pa.RecordBatch:
        h = np.frombuffer(b"".join(r[0] for r in rows), np.int64).reshape(-1, 2)
        ids, ties, spans = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        again = np.array([r[4] for r in rows], bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(again, (ids ^ ties) * 0x5851F42D4C957F2D + spans * 0x14057B7EF767814F, h[:, 0])),
             pa.array(np.where(again, -1, h[:, 1])), pa.array(ids), pa.array(ties), pa.array(spans),
             pa.array(again)], names=["h1", "h2", "id", "tie", "span", "again"])

    for b in batches:
        both = sorted(zip(*[b.column(c).to_pylist() for c in ("id", "tie", "text")]), key=lambda r: r[:2])
        for i, tie, text in both:
            for digest, first, behind in runs(sentences(text)):
                held = seen.setdefault(digest, (i, tie, first))
                if held > (i, tie, first):  # ids of a later batch may be smaller
                    seen[digest] = (i, tie, first)
                    rows.append((digest, i, tie, first << 32 | behind, False))
                elif held == (i, tie, first):
                    rows.append((digest, i, tie, first << 32 | behind, False))
                else:
                    rows.append((digest, i, tie, first << 32 | behind, True))
            if len(rows) >= RUNS_AT_ONCE:
                yield flush()
                seen, rows = {}, []
    yield flush()


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``(id, tie, span)`` of every run that also stands earlier: in a smaller (id, tie), or further left in the same text."""
    hashed = rows.mapInArrow(_hashed, "h1 long, h2 long, id long, tie long, span long, again boolean")
    place = F.struct("id", "tie", F.shiftright("span", 32))
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    return hashed.withColumn("first", first).filter(F.col("again") | (place > F.col("first"))).select(
        "id", "tie", "span")


def covered(spans: list[int] | None, n: int) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    for s in spans or ():
        low, high = s >> 32, s & 0xFFFFFFFF
        if high <= n:
            gone[low] += 1
            gone[high] -= 1
    return np.cumsum(gone)[:n] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, total, removed, found = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            pieces = sentences(text)
            gone = covered(spans, len(pieces))
            kept.append("".join(p for p, g in zip(pieces, gone) if not g) if spans else text or "")
            total.append(len(pieces))
            removed.append(int(gone.sum()))
            found.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(found, pa.int64())], names=["doc_id", "kept_text", "n_sentences", "n_removed", "n_spans"])


def remove_repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kept_text, n_sentences, n_removed, n_spans)`` of every row.

    A sentence goes if it lies in a run that also stands earlier (smaller
    doc_id, or further left in the same text); the first occurrence stays, and
    the rest of the text is kept to the letter. n_spans counts the maximal
    stretches removed. Null texts are empty and stay whole, as do texts of one
    sentence; a null id comes before all others; rows of the same id and text
    count as one document, different texts of an id (or without one) come in the
    order of a hash; an empty table gives an empty result.
    """
    begin(docs)
    rows = view(docs, doc_id=id_col, text=text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("tie"), "text")
    spans = repeated_runs(rows).groupBy("id", "tie").agg(F.collect_set("span").alias("spans"))
    return rows.join(spans, ["id", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, kept_text string, n_sentences long, n_removed long, n_spans long")
