"""Phrase collocations: Misra-Gries summaries per hash partition find what can be frequent, a second pass counts it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import begin, input_bytes, landed, view

# What ends a piece, what parts words, and how a score is scaled.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
SCALE = 1_000_000
MOST_WORDS = 3
MIN_COUNT = 10
COVER = 50  # hundredths of a phrase's count that a longer one must reach to stand for it
TOP = 2_000

CHUNK = 1 << 20  # bytes of text that a task works on at once; a longer piece stays whole
BLOCK = 1 << 22  # phrase occurrences that a task sums before it writes them
ROWS_AT_ONCE = 256  # of an Arrow batch that are Python strings together
PART_BYTES = 16 << 20  # of the input, for each hash partition
MOST_PARTS = 1 << 15
KEY_BITS = 48  # of a phrase's hash in the first pass
FILTER_BITS = 1 << 27  # of the filter that the second pass is sent: 16 MB, whatever the input
UNKNOWN_BYTES = 1 << 60  # Spark's guess for an input without files

KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(PIECE_ENDS)] = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PIECE_END = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]")
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """``(bytes, offset of every text, its lang)`` of lower-cased texts, joined by piece ends; long texts are cut at those."""
    held: list[bytes] = []
    langs: list[str] = []
    size = 0

    def joined():
        data = np.frombuffer(b"\n".join(held), np.uint8)
        at = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        return data, at, list(langs)

    some = (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))
    for batch in some:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass").translate(LOWER)
            done = 0
            while done < len(data):
                cut = len(data)
                if cut - done > CHUNK:
                    cut = 1 + max(data.rfind(bytes([c]), done, done + CHUNK) for c in PIECE_ENDS)
                    if not cut:
                        after = PIECE_END.search(data, done + CHUNK)
                        cut = after.end() if after else len(data)
                held.append(data[done:cut])
                langs.append(lang)
                size += cut - done
                done = cut
                if size >= CHUNK:
                    yield joined()
                    held, langs, size = [], [], 0
    if held:
        yield joined()


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(inside, starts, ends, piece)``: which bytes are in words, every word's bounds and the number of its piece."""
    kind = KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return inside[1:-1], starts, ends, np.cumsum(kind == 2)[starts]


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to 0, 1, 2, ... and its inverses, modulo 2**64."""
    up, down = (np.cumprod(np.full(n, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, up]), np.concatenate([one, down])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_keys(data: np.ndarray, at: np.ndarray, langs: list[str], most: int):
    """``(words_of, lang of every word, [(first words, keys) for 1 word, 2 words, ...])``; keys are hashes with the lang."""
    found = words_of(data)
    _, starts, ends, piece = found
    up, down = powers(1 << len(data).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:len(data)], out=total[1:])
    word = (total[ends] - total[starts]) * down[starts]
    doc = np.searchsorted(at, starts, "right") - 1
    salts = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)
    first, key = np.arange(len(starts)), _mixed(word + salts[doc])
    out = [(first, key)]
    for k in range(1, most):
        stays = first + k < len(starts)
        first, key = first[stays], key[stays]
        stays = piece[first] == piece[first + k]
        first, key = first[stays], key[stays]
        key = _mixed(key * np.uint64(BASE) + word[first + k])
        out.append((first, key))
    return found, doc, [(f, x >> np.uint64(64 - KEY_BITS)) for f, x in out]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and what their counts (1 each if none are given) add up to."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[heads], np.diff(np.append(heads, len(keys)))
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between sorted keys and counts, byte plane by byte plane, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    many = np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes() + many.T.tobytes())


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(12, -1)
    steps = np.ascontiguousarray(raw[:8].T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8:].T).view("<u4").ravel().astype(np.int64)


class Summary:
    """Misra-Gries counters: at most ``capacity`` of them stay, and no count is short by more than ``loss``.

    Merging subtracts the first count too many from all, so that each unit of
    loss takes more than ``capacity`` from the mass: with a capacity over mass
    divided by threshold the loss stays below the threshold, and a key with a
    true count of ``threshold`` is never lost.
    """

    def __init__(self, capacity: int):
        self.capacity, self.loss = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        held, many = summed(np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts]))
        if len(held) > self.capacity:
            rank = len(held) - self.capacity - 1
            off = int(np.partition(many, rank)[rank])
            self.loss += off
            many = many - off
            held, many = held[many > 0], many[many > 0]
        self.keys, self.counts = held, many

    def possible(self, threshold: int) -> np.ndarray:
        """The keys whose true count can be the threshold or more."""
        return self.keys[self.counts + self.loss >= threshold]


def _digests(parts: int, most: int):
    """Tasks' sums of phrase occurrences, cut by hash partition: ``(part, mass, payload)``."""
    bounds = np.array([-(-(p << KEY_BITS) // parts) for p in range(parts + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            keys, counts = summed(np.concatenate(held))
            at = np.searchsorted(keys, bounds)
            rows = [(p, int(counts[x:y].sum()), packed(keys[x:y], counts[x:y]))
                    for p, (x, y) in enumerate(zip(at, at[1:])) if y > x]
            part, mass, payload = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(mass, pa.int64()),
                                               pa.array(payload, pa.binary())], names=["part", "mass", "payload"])

        for chunk in chunks(batches):
            for _, keys in phrase_keys(*chunk, most)[2]:
                held.append(keys)
                size += len(keys)
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    return run


def _summaries(threshold: int, slice_bits: int):
    """One hash partition's merged summary as its slice of the filter."""

    def run(table: pa.Table) -> pa.Table:
        summary = Summary(sum(table.column("mass").to_pylist()) // threshold + 1)
        keys, counts, size = [], [], 0
        for payload in table.column("payload"):
            for into, x in zip((keys, counts), unpacked(payload.as_py())):
                into.append(x)
            size += len(keys[-1])
            if size > summary.capacity:
                summary.merge(keys, counts)
                keys, counts, size = [], [], 0
        summary.merge(keys, counts)
        left = summary.possible(threshold)
        bits = np.zeros(slice_bits, np.uint8)
        bits[(left % np.uint64(slice_bits)).astype(np.int64)] = 1
        payload = zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())
        return pa.table({"part": table.column("part").slice(0, 1), "loss": pa.array([summary.loss], pa.int64()),
                         "bits": pa.array([payload], pa.binary())})

    return run


def _occurrences(bits, parts: int, slice_bits: int, most: int):
    """``(lang, phrase, f)`` of a chunk's phrases that pass the filter, and its words with an empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = np.frombuffer(bits.value, np.uint8)

        def possible(key: np.ndarray) -> np.ndarray:
            part = (key * np.uint64(parts)) >> np.uint64(KEY_BITS)
            at = part * np.uint64(slice_bits) + key % np.uint64(slice_bits)
            return (passing[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1

        for data, at, langs in chunks(batches):
            (inside, starts, ends, _), doc, keys = phrase_keys(data, at, langs, most)
            if not len(starts):
                continue
            offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [
                None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
            number, spelled = words.indices.to_numpy().astype(np.int64), words.dictionary
            names = sorted(set(langs))
            numbers = {x: k for k, x in enumerate(names)}
            lang = np.array([numbers[x] for x in langs])[doc]
            for k, (first, key) in enumerate(keys):
                first = first[possible(key)]
                if not len(first):
                    continue
                exact = lang[first]
                for j in range(k + 1):  # numbers of (lang, word, word, ...) met so far: no two phrases share one
                    exact = exact * len(spelled) + number[first + j]
                    if j < k:
                        exact = np.unique(exact, return_inverse=True)[1]
                _, heads, counts = np.unique(exact, return_index=True, return_counts=True)
                heads = first[heads]
                parts_of = [spelled.take(pa.array(number[heads + j])) for j in range(k + 1)]
                phrase = pc.binary_join_element_wise(*parts_of, pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(lang[heads])), phrase.cast(pa.string()),
                                                  pa.array(counts)], names=["lang", "phrase", "f"])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([""] * len(names)),
                                              pa.array(np.bincount(lang, minlength=len(names)))],
                                             names=["lang", "phrase", "f"])

    return run


def phrase_counts(rows: DataFrame, most: int = MOST_WORDS, threshold: int = MIN_COUNT) -> DataFrame:
    """``(lang, phrase, f)`` of every phrase of one to ``most`` words met ``threshold`` times, and all words under ``""``.

    The first pass sums each task's phrase hashes by hash partition and merges
    them to Misra-Gries summaries. What can be frequent sets a bit of a filter
    of fixed size, which the second pass is sent; it counts phrases that pass
    by their letters, so that counts are exact whatever the hashes. On inputs
    with far more frequent phrases than the filter has bits more passes, and
    the second exchange grows to a row for each task and phrase; results stay.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(rows)
    parts = min(MOST_PARTS, max(least, -(-size // PART_BYTES) if size < UNKNOWN_BYTES else 1))
    slice_bits = FILTER_BITS // parts // 8 * 8
    digests = rows.mapInArrow(_digests(parts, most), "part int, mass long, payload binary")
    slices = digests.groupBy("part").applyInArrow(_summaries(threshold, slice_bits), "part int, loss long, bits binary")
    passing = bytearray(parts * slice_bits // 8)
    for row in slices.collect():
        assert row["loss"] < threshold
        at = row["part"] * slice_bits // 8
        passing[at:at + slice_bits // 8] = zstandard.ZstdDecompressor().decompress(row["bits"])
    sent = spark.sparkContext.broadcast(bytes(passing))
    found = rows.mapInArrow(_occurrences(sent, parts, slice_bits, most), "lang string, phrase string, f long")
    counts = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return landed(counts.filter((F.col("f") >= threshold) | (F.col("phrase") == "")), "phrase-counts")


def weakest_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (lang, phrase, words, a) with ``l``, ``r``, ``score`` of the cut that scores lowest, the first of equals."""
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    wide = "CAST({} AS DECIMAL(14, 0))"  # products of three stay within 38 digits
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * ({wide.format('a')} * {wide.format('a')})) "
                   f"DIV ({wide.format('l')} * {wide.format('r')})")
    return both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(candidates: DataFrame, cover: int) -> DataFrame:
    """``(lang, phrase, longest)``: the largest count of a longer candidate that holds the phrase's words in a row."""
    longer = candidates.filter(F.size("words") > 2)
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> "
                   "transform(sequence(1, size(words) - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    inner = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def first_of_each(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every key with their ``rank``; salted shares of a key are cut to ``n`` before they meet."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    share = Window.partitionBy(key, "share").orderBy(*order)
    best = salted.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= n).drop("rank", "share")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(
        F.col("rank") <= n)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS,
                 threshold: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each lang whose words attract each other.

    Phrases are two to ``most`` words in a row within a piece, met ``threshold``
    times in the lang's texts; the score is the lowest of its cuts'
    ``floor(SCALE * a * a / (l * r))``. A phrase leaves if a longer candidate
    holds its words and reaches ``cover`` hundredths of its count. Equal scores
    come by count, then by phrase in byte order. A null text is empty, a null
    lang is ``und``; repeated rows count again; texts of any length are taken
    whole; a table without words gives no rows. Counts must stay below 10**14.
    """
    begin(docs)
    rows = view(docs, text=text_col, lang=lang_col).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = phrase_counts(rows, most, threshold)
    words = F.split("phrase", " ", -1)
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).filter(
        (F.size("words") >= 2) & (F.col("a") >= threshold))
    scored = weakest_cuts(candidates, counts).join(covered(candidates, cover), ["lang", "phrase"], "left")
    scored = scored.filter(F.col("longest").isNull() | (100 * F.col("longest") < cover * F.col("a"))).drop("longest")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    sizes = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    best = first_of_each(scored, "lang", order, top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
