"""Suffix-array dedup: front-coded sorted suffix runs are exchanged and merged by loser trees that know common prefixes.

The design follows distributed string merge sort (Bingmann, Sanders and
Schimek, 2020): only suffixes whose first bytes occur again travel, every run is
sorted and front-coded, and a merge compares two suffixes from the first byte
not yet known to be equal (Ng and Kakehi, 2008).

Suffixes start at anchors: of every ``WIDTH`` bytes the position with the
smallest hash of ``GRAM`` bytes (winnowing, Schleimer et al., 2003). Equal
strings of that width have their anchor at the same place, so every repeat
shows as two suffixes with a common start, together with equal bytes before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import begin, parts_for, view

WIDTH = 100  # bytes of a repeat
GRAM = 24  # bytes hashed at an anchor
BEFORE = WIDTH - GRAM  # bytes before an anchor that a repeat can reach
ROW = WIDTH + BEFORE  # bytes of an exchanged suffix: WIDTH from the anchor, then BEFORE going back
SEGMENT = 1 << 20  # bytes of a text hashed at once
ANCHORS_AT_ONCE = 1 << 18  # anchors whose hashes a task counts before it writes them
SUFFIXES_AT_ONCE = 1 << 16  # suffixes of a run
PART_BYTES = 4 << 20  # input bytes for each part of the merge
NO_ID = -(1 << 63)  # stands for a null id inside
OWN = np.dtype([("id", np.int64), ("tie", np.int64)])  # a document: its id and a hash of its text

# Odd multipliers of the hash.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x0: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    h = x0 * MIX[0]
    h ^= h >> np.uint64(29)
    h += x1
    h *= MIX[1]
    h ^= h >> np.uint64(32)
    h += x2
    h *= MIX[2]
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every position."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
    return _mixed(words[:-16], words[8:-8], words[16:])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all WIDTH-byte windows, in order."""
    if len(raw) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, hashes = [], []
    for start in range(0, len(raw) - WIDTH + 1, SEGMENT):
        h = gram_hashes(raw[start:start + SEGMENT + WIDTH - 1])
        # 40 bits of hash over the position: the minimum is the leftmost smallest
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= BEFORE + 1:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        rest = BEFORE + 1 - reach
        low = (np.minimum(key[:len(key) - rest], key[rest:]) & np.uint64(0xFFFFFF)).astype(np.int64)
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        at.append(low + start)
        hashes.append(h[low])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    return at[new], hashes[new]


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, id, tie, at, n)``: a hash seen once here, or a suffix already known to be repeated under a key of its own.

    Counting before the exchange leaves one row of a hash for each task's
    portion, however often a passage occurs.
    """
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([np.full(len(a), np.array(i, OWN)) for i, a, _ in held] or [np.empty(0, OWN)])
        at = np.concatenate([a for _, a, _ in held] or [np.empty(0, np.int64)])
        h = np.concatenate([x for _, _, x in held] or [np.empty(0, np.uint64)])
        _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        n = np.minimum(n, 2)[back]
        extra = np.ones(len(h), bool)
        extra[first] = False
        own = _mixed(ids["id"].view(np.uint64) ^ ids["tie"].view(np.uint64), at.view(np.uint64), h)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(extra, own, h).view(np.int64)), pa.array(ids["id"]), pa.array(ids["tie"]),
             pa.array(at.astype(np.int32)), pa.array(n.astype(np.int8))], names=["key", "id", "tie", "at", "n"])

    total = 0
    for b in batches:
        for i, tie, text in zip(*[b.column(c).to_pylist() for c in ("id", "tie", "text")]):
            a, h = anchors(_raw(text))
            if len(a):
                held.append(((i, tie), a, h))
                total += len(a)
            if total >= ANCHORS_AT_ONCE:
                yield flush()
                held, total = [], 0
    yield flush()


# --- sorted front-coded runs


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before it; 0 for the first."""
    if not len(rows):
        return np.empty(0, np.int64)
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], common))


def suffix_rows(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The exchanged bytes of each anchor; 0xFF, which UTF-8 never has, stands beyond either end."""
    padded = np.concatenate((np.full(BEFORE, 255, np.uint8), raw, np.full(WIDTH, 255, np.uint8)))
    steps = np.concatenate((np.arange(WIDTH), -1 - np.arange(BEFORE)))
    return padded[(at + BEFORE)[:, None] + steps]


def _sorted_by(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel().argsort(kind="stable")


def _earlier(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of each suffix by document, then start."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((at, ids["tie"], ids["id"]))] = np.arange(len(ids))
    return rank


RUN = "part long, ids binary, at binary, room binary, common binary, tails binary"  # blobs are zstd frames


def packed(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(blob) if blob else b""


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob) if blob else b""


def _runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            at = np.concatenate([x[1] for x in held])
            rows = np.concatenate([x[2] for x in held])
            order = _sorted_by(rows)
            ids, at, rows = ids[order], at[order], rows[order]
            room = np.stack([np.concatenate([x[3] for x in held])[order], np.minimum(at, BEFORE)], axis=1)
            out: dict[str, list] = {c.split()[0]: [] for c in RUN.split(", ")}
            # equal rows: all but the earliest are repeats already, whatever the other runs hold
            same = np.concatenate(([False], (rows[1:] == rows[:-1]).all(axis=1)))
            group = np.cumsum(~same) - 1
            rank = _earlier(ids, at)
            best = np.full(group[-1] + 1, len(ids))
            np.minimum.at(best, group, rank)
            first = rank == best[group]
            where = np.empty(len(ids), np.int64)
            where[rank] = np.arange(len(ids))
            lead = where[best[group]]
            repeat = ~first & ~((ids == ids[lead]) & (at == at[lead]))
            done = repeat & (room.sum(axis=1) >= WIDTH)
            spans = np.stack([at - room[:, 1], at + room[:, 0]], axis=1)
            keep = first
            words = np.ascontiguousarray(rows[:, :GRAM]).view("<u8")
            part = (_mixed(words[:, 0], words[:, 1], words[:, 2]) % np.uint64(parts)).astype(np.int64)

            def add(p, **values):
                for name in out:
                    out[name].append(p if name == "part" else packed(values[name]))

            if done.any():  # spans travel along: ids and bounds, no suffix
                p = int((ids["id"].sum() + ids["tie"].sum() + at.sum()) % parts)
                add(p, ids=ids[done].tobytes(), at=spans[done].astype(np.int64).tobytes(), room=b"", common=b"",
                    tails=b"")
            kept = np.flatnonzero(keep)
            kept = kept[np.argsort(part[kept], kind="stable")]
            cuts = np.flatnonzero(np.diff(part[kept])) + 1
            for own in np.split(kept, cuts):
                mine = rows[own]
                common = shared_prefix(mine)
                tails = mine[np.arange(ROW) >= common[:, None]]
                add(int(part[own[0]]), ids=ids[own].tobytes(), at=at[own].tobytes(),
                    room=room[own].astype(np.uint8).tobytes(), common=common.astype(np.uint8).tobytes(),
                    tails=tails.tobytes())
            return pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.int64() if k == "part" else pa.binary()) for k, v in out.items()})

        total = 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("id", "tie", "text", "starts")]
            for i, tie, text, starts in zip(*columns):
                raw, starts = _raw(text), np.unique(np.array(starts, np.int64))
                starts = starts[starts < len(raw)]
                for s in range(0, len(starts), SUFFIXES_AT_ONCE):
                    at = starts[s:s + SUFFIXES_AT_ONCE]
                    held.append((np.full(len(at), np.array((i, tie), OWN)), at, suffix_rows(raw, at),
                                 np.minimum(len(raw) - at, WIDTH)))
                    total += len(at)
                    if total >= SUFFIXES_AT_ONCE:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()

    return run


# --- merge


def decoded(common: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """``(bytes shared with the row before, row)`` of a front-coded run."""
    row, at = b"", 0
    for c in common:
        row = row[:c] + tails[at:at + ROW - c]
        at += ROW - c
        yield c, row


def merged(runs: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int]]:
    """``(run, bytes shared with the row given before)`` in sorted order of all rows.

    A loser tree: each inner node keeps the loser of its match and how many
    bytes it shares with the winner. Of two rows compared with the same last
    winner, the one that shares more with it is smaller; only when both share
    as much are bytes compared, from that point on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    feeds = [decoded(*r) for r in runs]
    heads: list[bytes | None] = [next(f)[1] for f in feeds] + [None] * (k - len(runs))
    shared = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared bytes become those with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        c = shared[a]
        rest_x, rest_y = x[c:], y[c:]
        if rest_x == rest_y:
            shared[b] = ROW
            return a, b
        apart = int.from_bytes(rest_x, "big") ^ int.from_bytes(rest_y, "big")
        c += (8 * len(rest_x) - apart.bit_length()) // 8
        win, lose = (a, b) if rest_x < rest_y else (b, a)
        shared[lose] = c
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    top = build(1) if k > 1 else 0
    while heads[top] is not None:
        yield top, shared[top]
        step = next(feeds[top], None)
        if step is None:
            heads[top] = None
        else:
            shared[top], heads[top] = step
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeats(ids: np.ndarray, at: np.ndarray, room: np.ndarray, common: np.ndarray, rows: np.ndarray):
    """``(ids, starts, ends)`` of bytes that repeat earlier ones, from suffixes in sorted order.

    ``common`` are the shared bytes of neighbours. For each way to lay a window
    over an anchor (``back`` bytes before it), windows are equal if the suffixes
    share what lies ahead (a run of the array) and what lies behind (a run in
    the order of the reversed bytes); all but the earliest are repeats.
    """
    rank = _earlier(ids, at)
    behind = rows[:, WIDTH:]
    order = _sorted_by(behind)
    behind_common = shared_prefix(behind[order])
    in_rank = np.empty(len(ids), np.int64)
    in_rank[rank] = np.arange(len(ids))
    covered = np.zeros((len(ids), BEFORE + 2), bool)
    lid = np.empty(len(ids), np.int64)
    for back in range(BEFORE + 1):
        fits = (room[in_rank, 0] >= WIDTH - back) & (room[in_rank, 1] >= back)
        own = in_rank[fits]
        if len(own) < 2:
            continue
        ahead_id = np.cumsum(common < WIDTH - back)
        lid[order] = np.cumsum(behind_common < back)
        both = ahead_id[own] * (len(ids) + 1) + lid[own]
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        covered[own, back] = first[inverse] != np.arange(len(own))
    edge = np.diff(covered.astype(np.int8), axis=1, prepend=0)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return ids[row], at[row] - (high - 1), at[row] - low + WIDTH


def _merge_part(part: pa.Table) -> pa.Table:
    """Spans of one part: those its runs brought along, and those found in its merged suffixes."""
    ids, starts, ends, runs = [], [], [], []
    for r in part.to_pylist():
        r = {k: v if k == "part" else unpacked(v) for k, v in r.items()}
        if r["common"]:
            runs.append(r)
        else:
            spans = np.frombuffer(r["at"], np.int64).reshape(-1, 2)
            ids.append(np.frombuffer(r["ids"], OWN))
            starts.append(spans[:, 0])
            ends.append(spans[:, 1])
    if runs:
        order, common = [], []
        for run, c in merged([(r["common"], r["tails"]) for r in runs]):
            order.append(run)
            common.append(c)
        order = np.array(order)
        place = np.empty(len(order), np.int64)
        place[np.argsort(order, kind="stable")] = np.arange(len(order))  # k-th row of the runs one after another
        common = np.array(common)
        rows = np.frombuffer(b"".join(row for r in runs for _, row in decoded(r["common"], r["tails"])),
                             np.uint8).reshape(-1, ROW)
        all_ids = np.concatenate([np.frombuffer(r["ids"], OWN) for r in runs])
        at = np.concatenate([np.frombuffer(r["at"], np.int64) for r in runs])
        room = np.concatenate([np.frombuffer(r["room"], np.uint8).reshape(-1, 2) for r in runs]).astype(np.int64)
        new = np.zeros(len(order), bool)  # the same suffix twice: a row given twice
        by_key = np.lexsort((at, all_ids["tie"], all_ids["id"]))
        new[by_key] = np.concatenate(([True], (all_ids[by_key[1:]] != all_ids[by_key[:-1]]) | (np.diff(at[by_key]) != 0)))
        common = _without(common, new[place])
        place = place[new[place]]
        found = repeats(all_ids[place], at[place], room[place], common, rows[place])
        for total, x in zip((ids, starts, ends), found):
            total.append(x)
    empty = np.empty(0, np.int64)
    bounds = (np.concatenate(starts or [empty]) << 32) | np.concatenate(ends or [empty])
    ids = np.concatenate(ids or [np.empty(0, OWN)])
    return pa.table({"id": np.ascontiguousarray(ids["id"]), "tie": np.ascontiguousarray(ids["tie"]), "span": bounds})


def _without(common: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Shared bytes of neighbours after some rows leave: the least on the way."""
    if keep.all():
        return common
    group = np.cumsum(keep)
    out = np.full(group[-1] + 2, ROW)
    np.minimum.at(out, np.where(keep, group, group + 1), common)
    return out[1:group[-1] + 1]


# --- documents


def merge_spans(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans or ()):
        low, high = s >> 32, s & 0xFFFFFFFF
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, digests, n, removed, runs = [], [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            gone = merge_spans(spans)
            edges = [0, *[x for s in gone for x in s], len(raw)]
            kept = b"".join(raw[low:high] for low, high in zip(edges[::2], edges[1::2]))
            texts.append(text if not gone else kept.decode("utf-8", "ignore"))
            digests.append(hashlib.sha256(kept).hexdigest())
            n.append(len(raw))
            removed.append(len(raw) - len(kept))
            runs.append(len(gone))
        own = [b.column(i) for i in range(b.num_columns - 2)]
        yield pa.RecordBatch.from_arrays(
            own + [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                   pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
            names=[*b.schema.names[:b.num_columns - 2], "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, parts: int) -> DataFrame:
    """``(id, tie, span)`` of all bytes to remove, span = start << 32 | end; ``rows`` are ``(id, tie, text)``, no key null."""
    found = rows.mapInArrow(_anchor_rows, "key long, id long, tie long, at int, n byte")
    seen = F.sum("n").over(Window.partitionBy("key"))
    again = found.withColumn("seen", seen).filter("seen > 1").groupBy("id", "tie").agg(
        F.collect_list("at").alias("starts"))
    # all columns go along: this exchange of the texts is then the very one that remove_repeats joins once more
    runs = rows.join(again, ["id", "tie"]).mapInArrow(_runs(parts), RUN)
    return runs.groupBy("part").applyInArrow(_merge_part, "id long, tie long, span long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, <keep>, kept_text, n_bytes, n_removed, n_spans, kept_sha256)`` of every row.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller
    doc_id, or further left in the same document, judged on the input. The kept
    text leaves out characters of which only some bytes are kept. Null texts
    are empty; a null id comes before all others; rows of the same id and text
    count as one document, so repeated rows all stay, and different texts of an
    id (or without one) come in the order of a hash; an empty table gives an
    empty result. Texts are up to 4 GB.
    """
    begin(docs)
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    tie = F.xxhash64(F.col(f"`{text_col}`"))
    rows = docs.select(own.alias("id"), tie.alias("tie"), *[F.col(f"`{c}`").alias(f"k_{c}") for c in keep],
                       F.col(f"`{text_col}`").alias("text"))
    spans = repeated_spans(rows, parts_for(docs, PART_BYTES)).groupBy("id", "tie").agg(
        F.collect_set("span").alias("spans"))
    joined = rows.join(spans, ["id", "tie"], "left").select("id", *[f"k_{c}" for c in keep], "text", "spans")
    schema = ", ".join(["id long", *[f"`{c}` {kind}" for c, kind in rows.dtypes if c.startswith("k_")]])
    out = joined.mapInArrow(_cut, schema + ", kept_text string, n_bytes long, n_removed long, n_spans long,"
                                           " kept_sha256 string")
    out = out.withColumn("doc_id", F.nullif("id", F.lit(NO_ID)))
    return out.select("doc_id", *[F.col(f"`k_{c}`").alias(c) for c in keep], "kept_text", "n_bytes", "n_removed",
                      "n_spans", "kept_sha256")
