"""Best-fit packing under conflicts: residual-ordered bins that know their sources and duplicate clusters."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import begin, landed, view, word_count

CAPACITY = 2048  # words of a bin
BLOCK_WORDS = 1 << 20  # words packed together by one call


def best_fit(sizes: list[int], lanes: list, clusters: list, capacity: int) -> list[int]:
    """Bin of every piece, pieces taken as given.

    Bins are kept by (residual, number). The search starts at the first bin
    with room and goes on to the next residual until a bin carries neither the
    piece's source lane nor its cluster; that one is the tightest compatible
    bin. Both memberships are bitmaps. None conflicts with nothing.
    """
    bit: dict = {}
    often: dict = {}
    for c in clusters:
        often[c] = often.get(c, 0) + 1
    masks = []
    for lane, c in zip(lanes, clusters):
        m = 0
        if lane is not None:
            m |= 1 << bit.setdefault(("lane", lane), len(bit))
        if c is not None and often[c] > 1:
            m |= 1 << bit.setdefault(("cluster", c), len(bit))
        masks.append(m)
    order: list[tuple[int, int]] = []
    held: list[int] = []
    out = []
    for size, mask in zip(sizes, masks):
        at = bisect_left(order, (size, -1))
        while at < len(order) and held[order[at][1]] & mask:
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held)
            held.append(0)
        held[b] |= mask
        if room > size:
            insort(order, (room - size, b))
        out.append(b)
    return out


def _packer(capacity: int):
    def pack_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "given", "id", "piece", "cluster"],
                                ascending=[False, False, True, True, True], kind="stable")
        lanes = [None if pd.isna(x) else x for x in rows["lane"]]
        clusters = [None if pd.isna(x) else x for x in rows["cluster"]]
        bins = best_fit(rows["n_words"].tolist(), lanes, clusters, capacity)
        return pd.DataFrame({"id": rows["id"], "given": rows["given"], "piece": rows["piece"], "n_words": rows["n_words"],
                             "bin_id": rows["block"].to_numpy() * (1 << 32) + bins})

    return pack_block


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         capacity: int = CAPACITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, piece, start_word, n_words, bin_id)``: one row per piece of a document.

    A document is cut every ``capacity`` words. No bin exceeds the capacity,
    holds two pieces of equal text's documents (the duplicate cluster), or two
    of the same source lane. A source has one lane, or as many as its share of
    a bin's expected pieces where that is above one, so a source with a third of
    all rows neither fills bins nor leaves them half empty.

    Blocks of pieces are packed independently: pieces are dealt by a hash, a
    block holds ``block_words`` words on average, whatever the size of the
    corpus. A text without words has one row with 0 words and no bin. A null
    source never conflicts; a null id is kept; repeated rows are packed one by
    one, apart from each other; an empty table gives an empty result.
    """
    begin(docs)
    rows = view(docs, id=id_col, text=text_col, source=source_col).select(
        "id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
        F.xxhash64("text").alias("cluster"))
    rows = landed(rows, "sizes")
    total, pieces = rows.agg(F.coalesce(F.sum("size"), F.lit(0)),
                             F.coalesce(F.sum(F.ceil(F.col("size") / capacity)), F.lit(0))).first()
    blocks = max(1, math.ceil(total / block_words))
    per_bin = pieces * capacity / total if total else 1.0
    # sources with more than one expected piece in a bin: fewer than per_bin <= capacity of them
    counts = rows.groupBy("source").agg(F.sum(F.ceil(F.col("size") / capacity)).alias("n"))
    hot = counts.filter(F.col("source").isNotNull() & (F.col("n") * per_bin > max(1, pieces))).collect()
    lanes = F.lit(1)
    for r in hot:
        lanes = F.when(F.col("source") == r["source"], math.ceil(r["n"] / pieces * per_bin)).otherwise(lanes)
    cut = rows.filter("size > 0").select(
        "id", "source", "size", "cluster",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)).alias("piece"))
    spread = F.xxhash64("id", "piece", "cluster")
    cut = cut.select(
        "id", "piece", "cluster", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n_words"),
        F.concat_ws("|", F.pmod(F.xxhash64("id", F.lit("lane")), lanes), "source").alias("lane"), "source",
        F.pmod(spread, F.lit(blocks)).alias("block"))
    cut = cut.withColumn("lane", F.when(F.col("source").isNotNull(), F.col("lane"))).drop("source")
    # no null among the ids that pandas sees: it would make doubles of all of them
    cut = cut.withColumn("given", F.col("id").isNotNull()).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(0)))
    packed = cut.groupBy("block").applyInPandas(
        _packer(capacity), "id long, given boolean, piece int, n_words long, bin_id long")
    packed = packed.select(F.when(F.col("given"), F.col("id")).alias("id"), "piece", "n_words", "bin_id")
    empty = rows.filter("size = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_words"),
                                           F.lit(None).cast("long").alias("bin_id"))
    return packed.union(empty).select(
        F.col("id").alias("doc_id"), "piece", (F.col("piece").cast("long") * capacity).alias("start_word"), "n_words",
        "bin_id")
