"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Words are hashed to ``BUCKETS`` ids; the ids form ``CLASSES`` classes (frequent
ids alone, the others dealt out). The network gives P(class | two words on each
side) from the ids of these words, each with a row for either side of its own
added to its class's, corpus counts give P(id | class); their logarithms add up over a text
(pseudo-log-likelihood, Wang and Cho 2019; Salazar et al. 2020).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import begin, landed, view

BUCKETS = 1 << 16  # hashed vocabulary
CLASSES = 128  # classes of the output layer; class 0 is the edge of a text
OWN = 64  # ids that are classes of their own
SIDE = 2  # words seen on each side
HIDDEN = 32
ROUNDS = 3  # passes of local training and averaging
RATE = 0.3
BATCH = 512
SLICE = 2048  # tokens scored at once
CHUNK = 1 << 16  # tokens whose neighbours are looked up at once, or a little more
SAFE = 80.0  # exp of it is a 32-bit float
ONES = np.ones(CLASSES, np.float32)
MERGE = 64  # groups of tasks that are averaged first
PARTS = 64  # of the word rows, averaged apart
WORDS = BUCKETS + 1  # word rows of a side; the last one is the edge of a text
WORD_SQUARES = 1e-6  # Adagrad's start for word rows, low as most words are in few batches


# --- encoding and counts


def encode(text: str | None) -> np.ndarray:
    """Word ids of a text: CRC-32 of the lower-case word, 16 bits."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (BUCKETS - 1)).astype(np.uint16)


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [encode(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes, pa.binary())], names=["id", "codes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for _, texts in _chunks(batches):  # some texts at once, as each sum runs over all ids
        total += np.bincount(np.concatenate(texts), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(encoded: DataFrame) -> np.ndarray:
    """Counts of all ids over all texts; each task sums its own texts first."""
    rows = encoded.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of every id: the most frequent have their own, the rest are dealt out in order of frequency."""
    order = np.lexsort((np.arange(BUCKETS), -counts))
    out = np.empty(BUCKETS, np.uint8)
    out[order[:OWN]] = 1 + np.arange(OWN)
    out[order[OWN:]] = 1 + OWN + np.arange(BUCKETS - OWN) % (CLASSES - 1 - OWN)
    return out


def within_class(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log P(id | class), every id counted once more than seen."""
    smooth = counts + 1.0
    return np.log(smooth / np.bincount(classes, weights=smooth, minlength=CLASSES)[classes])


# --- the network


@dataclass
class Network:
    """tanh(sum of the class row and the word row of each neighbour + b) @ out + bias."""

    rows: np.ndarray  # (2 * SIDE, CLASSES, HIDDEN)
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    words: np.ndarray  # (2 * WORDS, HIDDEN), by turns left and right of a position, zero until trained

    @staticmethod
    def start(class_counts: np.ndarray) -> Network:
        rng = np.random.default_rng(7)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        bias = np.log((class_counts + 1.0) / (class_counts + 1.0).sum()).astype(np.float32)
        return Network(small(2 * SIDE, CLASSES, HIDDEN), np.zeros(HIDDEN, np.float32), small(HIDDEN, CLASSES), bias,
                       np.zeros((2 * WORDS, HIDDEN), np.float32))

    def dense(self) -> np.ndarray:
        """All but the word rows."""
        return np.concatenate([x.ravel() for x in (self.rows, self.b, self.out, self.bias)])

    def flat(self) -> np.ndarray:
        return np.concatenate((self.dense(), self.words.ravel()))

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """What goes to the tasks, word rows at half the bytes."""
        return self.dense(), self.words.astype(np.float16).ravel()

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        flat = flat.astype(np.float32)
        cut = np.cumsum([2 * SIDE * CLASSES * HIDDEN, HIDDEN, HIDDEN * CLASSES, CLASSES])
        rows, b, out, bias, words = np.split(flat, cut)
        return Network(rows.reshape(2 * SIDE, CLASSES, HIDDEN).copy(), b.copy(),
                       out.reshape(HIDDEN, CLASSES).copy(), bias.copy(), words.reshape(-1, HIDDEN).copy())

    def hidden(self, context: np.ndarray, near: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
        """Values of the hidden layer; ``words`` are the rows that ``near`` numbers, if not all word rows."""
        h = self.rows[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.rows[k].take(context[:, k], axis=0)
        if near is not None:
            words = self.words if words is None else words
            for k in range(2 * SIDE):
                h += words.take(near[:, k], axis=0)
        return self._bent(h)

    def hidden_of_text(self, classes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The same for all positions of a text in a row, ``SIDE`` more at both ends; each word is looked up once a side."""
        n, steps = len(codes) - 2 * SIDE, [k for k in range(2 * SIDE + 1) if k != SIDE]
        sides = [self.words.take(2 * codes + side, axis=0) for side in range(2)]
        h = self.rows[0].take(classes[:n], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.rows[k].take(classes[steps[k]:steps[k] + n], axis=0)
        for k in range(2 * SIDE):
            h += sides[k // SIDE][steps[k]:steps[k] + n]
        return self._bent(h)

    def _bent(self, h: np.ndarray) -> np.ndarray:
        h += self.b
        return np.tanh(h, out=h)

    def most(self) -> float:
        """Bound of all logits, as hidden values lie within -1 and 1."""
        return float(np.abs(self.out).sum(axis=0).max() + np.abs(self.bias).max())

    def odds(self, h: np.ndarray, room: np.ndarray | None = None, safe: bool | None = None) -> np.ndarray:
        """Logits, lowered to at most 0 where their exp could overflow, unless ``safe``; ``room`` is memory for them."""
        logits = np.matmul(h, self.out, out=None if room is None else room[:len(h)])
        logits += self.bias
        if not (self.most() <= SAFE if safe is None else safe):
            logits -= logits.max(axis=1, keepdims=True)
        return logits

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """log P(target class | neighbours) of each position; ``near`` are the word rows of the neighbours."""
        return _log_probabilities(self.odds(self.hidden(context, near)), target)

    def log_probabilities_of_text(self, classes: np.ndarray, codes: np.ndarray, room: np.ndarray | None = None,
                                  safe: bool | None = None) -> np.ndarray:
        """The same for all positions of a text in a row, ``SIDE`` more at both ends; ``room`` and ``safe`` as in odds()."""
        logits = self.odds(self.hidden_of_text(classes, codes), room, safe)
        return _log_probabilities(logits, classes[SIDE:len(classes) - SIDE])


def _log_probabilities(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    chosen = logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + target).astype(np.float64)
    return chosen - np.log((np.exp(logits, out=logits) @ ONES).astype(np.float64))


def laid_out(texts: list[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, edges between them: ids, classes, place of every word, its position in its text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(total) + np.repeat(SIDE * np.arange(len(texts)), lengths)
    codes = np.full(total + SIDE * len(texts), BUCKETS, np.int32)
    codes[at] = np.concatenate(texts)
    return codes, np.append(classes, np.uint8(0))[codes], at, within


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and texts, some ``CHUNK`` words at a time; a batch ends a chunk."""
    for b in batches:
        docs, texts, n = [], [], 0
        for doc, raw in zip(b.column("id").to_pylist(), b.column("codes").to_pylist()):
            docs.append(doc)
            texts.append(np.frombuffer(raw, np.uint16))
            n += len(texts[-1])
            if n >= CHUNK:
                yield docs, texts
                docs, texts, n = [], [], 0
        if docs:
            yield docs, texts


def contexts(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of the words around each position; 0 beyond the ends."""
    padded = np.concatenate((np.zeros(SIDE, np.uint8), classes, np.zeros(SIDE, np.uint8)))
    steps = [k for k in range(2 * SIDE + 1) if k != SIDE]
    return np.stack([padded[at + k] for k in steps], axis=1)


def neighbours(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Word rows of the words around each position."""
    edge = np.full(SIDE, BUCKETS, np.int32)
    padded = np.concatenate((edge, codes.astype(np.int32), edge))
    steps = [k for k in range(2 * SIDE + 1) if k != SIDE]
    return np.stack([2 * padded[at + k] + np.int32(i // SIDE) for i, k in enumerate(steps)], axis=1)


class _Trainer:
    """Adagrad over mini-batches, local to a task."""

    def __init__(self, net: Network):
        self.net, self.seen, self.most = net, 0, np.inf
        self.rest = np.concatenate([x.ravel() for x in (net.b, net.out, net.bias)])
        net.b, net.out, net.bias = _parts(self.rest)
        self.squares = [np.full_like(x, 1e-2) for x in (net.rows, self.rest)]
        self.word_squares = np.full_like(net.words, WORD_SQUARES)
        self.room = np.empty((0, CLASSES), np.float32)  # taken once, a step's largest array

    def step(self, context: np.ndarray, target: np.ndarray, near: np.ndarray | None = None) -> None:
        net, n = self.net, np.float32(len(target))
        context = context.astype(np.intp, order="F")  # a column is an index as it stands
        if near is None:
            h = net.hidden(context)
        else:  # a word row is read once a step, however often the batch meets it, and written once
            met = _Groups.of(near.T.ravel())
            words = net.words.take(met.values, axis=0)
            h = net.hidden(context, met.numbers().reshape(2 * SIDE, -1).T, words)
        if len(self.room) < len(h):
            self.room = np.empty((len(h), CLASSES), np.float32)
        p = net.odds(h, self.room, self._safe())
        np.exp(p, out=p)
        p *= (1 / (n * (p @ ONES)))[:, None]
        p.reshape(-1)[np.arange(0, p.size, CLASSES) + target] -= 1 / n
        back = p @ net.out.T
        back *= 1 - h * h
        if near is not None:
            self._word_step(met.values, words, met.sums(back))
        cells = _Groups.of((context.T + np.arange(0, 2 * SIDE * CLASSES, CLASSES, dtype=np.int32)[:, None]).ravel())
        rows, rest = np.zeros((2 * SIDE * CLASSES, HIDDEN), np.float32), np.empty_like(self.rest)
        rows[cells.values] = _summed(back.take(cells.rows(len(back)), axis=0), cells.starts)
        b, out, bias = _parts(rest)
        np.einsum("ij->j", back, out=b)
        np.matmul(h.T, p, out=out)
        np.matmul(np.ones(len(p), np.float32), p, out=bias)
        for x, s, g in zip((net.rows, self.rest), self.squares, (rows.reshape(net.rows.shape), rest)):
            s += g * g
            g *= np.float32(RATE)
            g /= np.sqrt(s)
            x -= g
        self.seen += len(target)

    def _safe(self) -> bool:
        """Whether no exp of a logit overflows; a step moves no weight by more than RATE, so few steps look at all."""
        self.most += RATE * (HIDDEN + 1)
        if self.most > SAFE:
            self.most = self.net.most()
        return self.most <= SAFE

    def _word_step(self, at: np.ndarray, words: np.ndarray, g: np.ndarray) -> None:
        """Step of the word rows at these places; ``words`` holds them, ``g`` is their gradient, both are used up."""
        s = self.word_squares.take(at, axis=0)
        s += g * g
        self.word_squares[at] = s
        g *= np.float32(RATE)
        g /= np.sqrt(s, out=s)
        words -= g
        self.net.words[at] = words


def _parts(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b, out and bias, which lie in one array."""
    return rest[:HIDDEN], rest[HIDDEN:-CLASSES].reshape(HIDDEN, CLASSES), rest[-CLASSES:]


@dataclass
class _Groups:
    """Equal numbers of an array, in ascending order."""

    values: np.ndarray  # each number once
    places: np.ndarray  # of all numbers in order, equal ones by place
    new: np.ndarray  # whether another number than the one before
    starts: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> _Groups:
        places, ordered = _in_order(x)
        starts, new = _starts(ordered), np.zeros(len(x), bool)
        new[starts] = True
        return _Groups(ordered.take(starts).astype(np.intp), places.astype(np.intp), new, starts)

    def numbers(self) -> np.ndarray:
        """The group of each place."""
        out = np.empty(len(self.places), np.intp)
        out[self.places] = np.cumsum(self.new) - 1
        return out

    def rows(self, n: int) -> np.ndarray:
        """Places that run through ``n`` rows again and again, as rows."""
        return self.places & (n - 1) if n & (n - 1) == 0 else self.places % n

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the rows of each group, of which many have one place only."""
        at = self.rows(len(rows))
        alone = self.new.copy()  # a start before another start
        alone[:-1] &= self.new[1:]
        out, more = rows.take(at.take(self.starts), axis=0), np.flatnonzero(~alone)
        if len(more):
            starts = np.flatnonzero(self.new.take(more))
            out[np.flatnonzero(~alone.take(self.starts))] = _summed(rows.take(at.take(more), axis=0), starts)
        return out


def _in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the numbers in ascending order, equal ones by place, and the numbers so ordered."""
    bits = len(x).bit_length()
    kind = np.int32 if 2 * WORDS << bits < 1 << 31 else np.int64  # numbers are word rows or fewer
    keys = np.sort((x.astype(kind) << bits) + np.arange(len(x), dtype=kind))
    return keys & ((1 << bits) - 1), keys >> bits


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a new number starts among ordered ones."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _summed(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of neighbouring rows, from each start to the next; two floats are added as one complex number."""
    return np.add.reduceat(rows.view(np.complex64), starts).view(np.float32)


LOCAL = "part long, slot long, first long, ids binary, weights binary, values binary"


def _local_training(sent: tuple[np.ndarray, np.ndarray], classes: np.ndarray, offset: int, rounds: int):
    """Trains on every ``rounds``-th position of each text, so that ``rounds`` offsets meet every position once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, n, first = _Trainer(Network.of(np.concatenate(sent))), [], 0, None
        times = np.zeros(2 * WORDS, np.int64)  # how often each word row was met
        for docs, texts in _chunks(batches):
            first = docs[0] if first is None else first
            codes, c, at, within = laid_out(texts, classes)
            start = np.repeat([(offset + (doc or 0)) % rounds for doc in docs], [len(t) for t in texts])
            at = at[within % rounds == start]
            held.append((contexts(c, at), c[at], neighbours(codes, at)))
            times += np.bincount(held[-1][2].ravel(), minlength=2 * WORDS)
            n += len(at)
            context, target, near = map(np.concatenate, zip(*held))
            low = 0
            while n - low >= BATCH:
                part = slice(low, low + BATCH)
                trainer.step(context[part], target[part], near[part])
                low += BATCH
            held, n = [(context[low:], target[low:], near[low:])], n - low
        if n:
            trainer.step(*map(np.concatenate, zip(*held)))
        if trainer.seen:
            slot, met = zlib.crc32(str(first).encode()) % MERGE, np.flatnonzero(times)
            rows = [(-1, np.zeros(1, np.int64), np.array([trainer.seen]), trainer.net.dense())]
            for part in range(PARTS):
                ids = met[met % PARTS == part]
                if len(ids):
                    rows.append((part, ids, times[ids], trainer.net.words[ids].astype(np.float16)))
            for part, *arrays in rows:
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int64()), "slot": pa.array([slot], pa.int64()),
                    "first": pa.array([first], pa.int64()),
                    **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "weights", "values"), arrays)}})

    return run


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, weights = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "weights"))
    kind = np.float32 if rows["part"].iloc[0] < 0 else np.float16
    return ids, weights, np.frombuffer(b"".join(rows["values"]), kind).reshape(len(ids), -1)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Mean of each id's values by their weights, with the weights' sum."""
    rows = rows.sort_values(["first", "slot", "weights"], kind="stable")
    ids, weights, values = _unpacked(rows)
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
    total = np.add.reduceat(weights[order], starts)
    sums = np.add.reduceat(values[order] * weights[order, None].astype(np.float64), starts)
    means = (sums / total[:, None]).astype(values.dtype)
    return rows.iloc[:1].assign(ids=ids[order][starts].tobytes(), weights=total.tobytes(), values=means.tobytes())


def train(encoded: DataFrame, classes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Rounds of local training; together they meet every position of all texts once.

    Weights of the tasks are averaged by the tokens they saw, word rows by how
    often a task met them. Values are merged in MERGE groups, then in one row
    for each of PARTS parts, so the driver receives one network, however many
    tasks there are.
    """
    net = Network.start(np.bincount(classes, weights=counts, minlength=CLASSES))
    for r in range(rounds):
        local = encoded.mapInArrow(_local_training(net.sent(), classes, r, rounds), LOCAL)
        merged = local.groupBy("part", "slot").applyInPandas(_merge, LOCAL)
        rows = merged.groupBy("part").applyInPandas(_merge, LOCAL).toPandas()
        if rows.empty:  # no words in this round
            continue
        dense, words = rows[rows["part"] < 0], rows[rows["part"] >= 0]
        ids, _, values = _unpacked(words)
        net.words[ids] = values
        net = Network.of(np.concatenate((_unpacked(dense)[2].ravel(), net.words.ravel())))
    return net


def pseudo_likelihoods(texts: list[np.ndarray], net: Network, classes: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """For each text the sum over its positions of log P(class | both sides) + log P(id | class); 0.0 without words.

    Products start anew with every text, so that equal texts score the same wherever they stand.
    """
    out, room, safe = np.zeros(len(texts)), np.empty((SLICE, CLASSES), np.float32), net.most() <= SAFE
    edge, with_edge = np.full(SIDE, BUCKETS, np.intp), np.append(classes, np.uint8(0))
    for i, text in enumerate(texts):
        codes, total = np.concatenate((edge, text, edge)), 0.0
        c = with_edge[codes].astype(np.intp)
        for low in range(0, len(text), SLICE):
            part = slice(low, low + SLICE + 2 * SIDE)
            total += net.log_probabilities_of_text(c[part], codes[part], room, safe).sum()
        out[i] = total + inner[text].sum()
    return out


def pseudo_likelihood(codes: np.ndarray, net: Network, classes: np.ndarray, inner: np.ndarray) -> float:
    return float(pseudo_likelihoods([codes], net, classes, inner)[0])


def _scorer(sent: tuple[np.ndarray, np.ndarray], classes: np.ndarray, inner: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.of(np.concatenate(sent))
        for docs, texts in _chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(pseudo_likelihoods(texts, net, classes, inner))], names=["id", "n_tokens", "log_likelihood"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, per_token)`` of every row.

    Counts, classes and the network come from all texts. Null, empty and blank
    texts have 0 tokens, log-likelihood 0.0 and a null mean. Repeated rows and
    null ids are scored like others; an empty table gives an empty result.
    """
    begin(docs)
    encoded = landed(view(docs, id=id_col, text=text_col).mapInArrow(_encoder, "id long, codes binary"), "codes")
    counts = bucket_counts(encoded)
    classes = classes_of(counts)
    net = train(encoded, classes, counts)
    rows = encoded.mapInArrow(_scorer(net.sent(), classes, within_class(counts, classes)),
                              "id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "log_likelihood", mean.alias("per_token"))
