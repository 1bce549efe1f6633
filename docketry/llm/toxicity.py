"""Toxicity scores from the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import begin, landed, view

MAX_EXAMPLES = 20_000  # labelled rows the index is fitted on: the documented bound
MAX_TERMS = 1_024  # terms of the index
MIN_EXAMPLES = 5  # examples that must hold a term
MIN_CHI2 = 25.0
MIN_RATIO = 3.0  # a term's rate in one class over that in the other, or the reverse
NEIGHBOURS = 25
BLOCK = 64  # examples under one maximum
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
WORDS = re.compile(r"\w+")
CACHE = 500_000  # words a worker remembers


def terms_of(word: str) -> list[str]:
    """A word and its prefixes; prefixes end in a mark so that they never equal a word."""
    return [word] + [word[:n] + "^" for n in PREFIXES if len(word) > n]


def _words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


# --- which terms tell the labels apart


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = (Counter(), Counter())
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            seen[y].update({t for w in set(_words(text)) for t in terms_of(w)})
        terms = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(terms, pa.string()),
            "neg": pa.array([seen[0][t] for t in terms], pa.int64()),
            "pos": pa.array([seen[1][t] for t in terms], pa.int64())})


def choose_terms(examples: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """The terms with the highest chi-square against the label, over all examples; a fixed number at most.

    Words that merely lean to one label, as those of a language do, say little
    about an example: one label's rate must be MIN_RATIO times the other's.
    """
    n = examples.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in n}
    if len(n) < 2:
        return []
    counts = examples.mapInArrow(_label_counts, "term string, neg long, pos long").groupBy("term").agg(
        F.sum("neg").alias("b"), F.sum("pos").alias("a")).filter(F.col("a") + F.col("b") >= MIN_EXAMPLES)
    rate = (F.col("a") + F.col("b")) / float(n[0] + n[1])
    chi2 = F.pow(F.col("a") / float(n[1]) - F.col("b") / float(n[0]), F.lit(2.0)) / (
        rate * (1 - rate) * (1.0 / n[1] + 1.0 / n[0]))
    toxic, clean = F.col("a") / float(n[1]), F.col("b") / float(n[0])
    telling = (toxic >= MIN_RATIO * clean) | (clean >= MIN_RATIO * toxic)
    best = counts.filter(telling).withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2)
    return sorted(r["term"] for r in best.orderBy(F.desc("chi2"), "term").limit(max_terms).select("term").collect())


# --- the chosen terms of every text


class _Terms:
    """Chosen terms and their counts of a text; a worker remembers the words it has met."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        tf: Counter = Counter()
        for w, n in Counter(_words(text)).items():
            hit = self.known.get(w)
            if hit is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                hit = self.known[w] = [self.index[t] for t in terms_of(w) if t in self.index]
            for i in hit:
                tf[i] += n
        at = sorted(tf)
        return at, [tf[i] for i in at]


def _term_reader(terms: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Terms(terms)
        for b in batches:
            rows = [of(text) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["id", "terms", "tfs"])

    return read


TERM_ROWS = "id long, terms array<int>, tfs array<int>"


def _frequencies(n_terms: int):
    """Documents of each term, summed within a task: a row for each term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    return run


# --- the index


@dataclass
class BlockMaxIndex:
    """Distinct unit vectors of the examples, in blocks; for each term the largest weight in each block.

    ``top`` finds the exact nearest: blocks are visited by their upper bound
    (the query's terms times their block maxima), a block that is visited is
    scored in full, and the search stops when no bound can beat what is found.
    Examples with the same vector stand as one, with their number and labels.
    """

    idf: np.ndarray
    counts: np.ndarray  # examples of each vector
    labels: np.ndarray  # how many of them are toxic
    ids: list[list[int]]  # the three smallest ids of each
    rows: np.ndarray  # start of each vector in terms and values
    terms: np.ndarray
    values: np.ndarray
    maxima: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, list[int], list[int], int]], idf: np.ndarray) -> BlockMaxIndex:
        held: dict[tuple, list] = {}
        for i, t, f, y in rows:
            if t:
                held.setdefault((tuple(t), tuple(f)), []).append((i, y))
        vectors = [(weights(list(t), list(f), idf), t, sorted(own)) for (t, f), own in held.items()]
        # like vectors stand together, so block maxima are close to what the block holds
        vectors.sort(key=lambda v: (v[1][int(np.argmax(v[0]))], v[1], v[0].tolist()))
        sizes = [len(v[1]) for v in vectors]
        maxima = np.zeros((len(idf), max(1, -(-len(vectors) // BLOCK))))
        for at, (w, t, _) in enumerate(vectors):
            np.maximum.at(maxima[:, at // BLOCK], list(t), w)
        return BlockMaxIndex(
            idf, np.array([len(v[2]) for v in vectors], np.int64), np.array([sum(y for _, y in v[2]) for v in vectors]),
            [[i for i, _ in v[2][:3]] for v in vectors], np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))),
            np.array([x for v in vectors for x in v[1]], np.int64),
            np.concatenate([v[0] for v in vectors] or [np.empty(0)]), maxima)

    def top(self, terms: list[int], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the nearest vectors, as many as hold k examples (ties: lower position); none of cosine 0."""
        bounds = q @ self.maxima[terms]
        dense = np.zeros(len(self.idf))
        dense[terms] = q
        best: list[tuple[float, int]] = []
        least = 0.0
        for blk in np.argsort(-bounds, kind="stable"):
            if bounds[blk] <= 0 or bounds[blk] < least - 1e-12:
                break
            first = blk * BLOCK
            starts = self.rows[first:first + BLOCK + 1]
            s, e = starts[0], starts[-1]
            cos = np.add.reduceat(self.values[s:e] * dense[self.terms[s:e]], starts[:-1] - s).round(12)
            near = np.flatnonzero(cos > max(0.0, least - 1e-12))
            if len(near):
                best += [(-cos[j], int(first + j)) for j in near]
                best.sort()
                held = 0
                for n, (c, at) in enumerate(best):
                    held += self.counts[at]
                    if held >= k:
                        del best[n + 1:]
                        least = -c
                        break
        return np.array([at for _, at in best], np.int64), np.array([-c for c, _ in best])


def weights(terms: list[int], tfs: list[int], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector of the given terms: (1 + ln tf) * idf."""
    w = (1 + np.log(np.asarray(tfs, float))) * idf[terms]
    return w / np.sqrt(w @ w)


def vote(cosines: np.ndarray, counts: np.ndarray, toxic: np.ndarray, k: int, prior: float) -> float:
    """Toxic share among the k nearest, each weighing 1 / (distance + 0.05), with one vote for the prior.

    Of the last vector only as many examples vote as are wanted, with its share of labels.
    """
    before = np.cumsum(counts) - counts
    wanted = np.clip(k - before, 0, counts)
    w = wanted / (1.05 - np.minimum(cosines, 1.0))
    share = np.divide(toxic, counts, out=np.zeros(len(counts)), where=counts > 0)
    return float((w @ share + prior) / (w.sum() + 1))


@dataclass
class ToxicityModel:
    """Fitted state: bounded by MAX_EXAMPLES rows and MAX_TERMS terms, whatever the corpus."""

    terms: list[str]
    index: BlockMaxIndex
    prior: float
    empty: float
    edges: np.ndarray
    values: np.ndarray

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.edges, self.values)) if len(self.edges) else raw


def isotonic(raw: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the held-one-out votes; every level takes one prior vote more."""
    pools: list[list[float]] = []
    for x, t in sorted(zip(raw.tolist(), y.tolist())):
        pools.append([t, 1.0, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    edges, values = [], []
    for s, n, low, high in pools:
        level = (s + prior) / (n + 1)
        edges += [low, high]
        values += [level, level]
    return np.array(edges), np.maximum.accumulate(np.array(values)) if values else np.array(values)


def _votes(index: BlockMaxIndex, prior: float, terms: list[int], tfs: list[int], own: int | None = None):
    """Vote of the nearest examples; ``own`` is the label of an example that must not vote for itself."""
    q = weights(terms, tfs, index.idf)
    at, cos = index.top(terms, q, NEIGHBOURS + (own is not None))
    counts, toxic = index.counts[at].copy(), index.labels[at].astype(float)
    if own is not None:
        for n, v in enumerate(at):  # its own vector: equal terms and weights
            s, e = index.rows[v], index.rows[v + 1]
            if e - s == len(terms) and (index.terms[s:e] == terms).all() and np.allclose(index.values[s:e], q):
                counts[n] -= 1
                toxic[n] -= own
                break
    return vote(cos, counts, toxic, NEIGHBOURS, prior), at, cos


def _held_one_out(index: BlockMaxIndex, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            rows = [(_votes(index, prior, t, f, y)[0], y) for t, f, y in zip(d["terms"], d["tfs"], d["y"]) if t]
            yield pa.RecordBatch.from_pydict({"raw": pa.array([r[0] for r in rows], pa.float64()),
                                              "y": pa.array([r[1] for r in rows], pa.int32())})

    return run


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic",
             max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """``(lid, y)``: labels that may be learned from, the ``max_examples`` with the smallest id hash; 0 or 1 only."""
    rows = view(labels, lid=id_col, y=label_col).filter("lid IS NOT NULL AND y IN (0, 1)").filter(
        ~held_out(F.col("lid"))).groupBy("lid").agg(F.max(F.col("y").cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("lid"), "lid").limit(max_examples)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> tuple[ToxicityModel, DataFrame]:
    """The model, and ``(id, terms, tfs)`` of every document from one pass over all texts.

    Terms are chosen on the labelled examples; their document frequencies are
    counted over all documents. The examples reach the driver as sparse rows of
    the chosen terms: at most MAX_EXAMPLES of them.
    """
    begin(docs)
    rows = view(docs, id=id_col, text=text_col)
    chosen = landed(labelled(labels, id_col, label_col), "labelled")
    examples = landed(rows.join(F.broadcast(chosen), rows["id"] == chosen["lid"]).select("id", "text", "y"),
                      "examples")
    terms = choose_terms(examples)
    found = landed(rows.mapInArrow(_term_reader(terms), TERM_ROWS), "terms")
    total = found.count()
    df = np.zeros(max(1, len(terms)))
    counted = found.select("terms").mapInArrow(_frequencies(max(1, len(terms))), "t long, n long")
    for r in counted.groupBy("t").agg(F.sum("n").alias("n")).collect():  # MAX_TERMS rows at most
        df[r["t"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    sparse = examples.select("id", "text").mapInArrow(_term_reader(terms), TERM_ROWS)
    sparse = landed(sparse.join(F.broadcast(chosen), sparse["id"] == chosen["lid"]).select("id", "terms", "tfs", "y"),
                    "sparse").dropDuplicates(["id"])
    train = sorted((r["id"], r["terms"], r["tfs"], r["y"]) for r in sparse.collect())
    positives = sum(r[3] for r in train)
    prior = (positives + 1) / (len(train) + 2)
    blank = [r[3] for r in train if not r[1]]
    index = BlockMaxIndex.build(train, idf)
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    loo = sparse.repartition(tasks, "id", "y").mapInArrow(_held_one_out(index, prior), "raw double, y int").collect()
    edges, values = isotonic(np.array([r["raw"] for r in loo]), np.array([r["y"] for r in loo], float), prior)
    return ToxicityModel(terms, index, prior, (sum(blank) + prior) / (len(blank) + 1), edges, values), found


class _Score:
    """Score, nearest examples and cosines of a text's terms; equal terms are looked up once."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.known: dict = {}

    def __call__(self, terms: list[int], tfs: list[int]) -> tuple[float, list[int], list[float]]:
        key = (tuple(terms), tuple(tfs))
        hit = self.known.get(key)
        if hit is None:
            model = self.model
            if not terms:
                hit = (model.empty, [], [])
            else:
                raw, at, cos = _votes(model.index, model.prior, terms, tfs)
                near = [(i, float(c)) for v, c in zip(at[:3], cos[:3]) for i in model.index.ids[v]][:3]
                hit = (min(1.0, max(0.0, model.calibrated(raw))), [i for i, _ in near], [c for _, c in near])
            if len(self.known) >= CACHE // 10:
                self.known.clear()
            self.known[key] = hit
        return hit


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Score(model)
        for b in batches:
            rows = [score(t, f) for t, f in zip(b.column("terms").to_pylist(), b.column("tfs").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([r[0] for r in rows], pa.float64()),
                 pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["id", "score", "evidence", "cosines"])

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns; cases as in ``toxicity``.

    Rows are scored where they are read: no text is exchanged and no verdict joined.
    """
    model, _ = fit(docs, labels, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, score = _Terms(model.terms), _Score(model)
        for b in batches:
            yield b.filter(pa.array([score(*of(t))[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence, cosines)`` of every row.

    The score is the calibrated, distance-weighted vote of the nearest labelled
    examples; evidence names the three nearest. A text without any chosen term
    (null and empty texts too) has no neighbour and scores the toxic share of
    such examples. Without labels of both classes all score the prior. Labels
    other than 0 and 1 are not learned from. A row with a null id is scored and
    never held out; repeated rows are scored one by one; an empty table gives an
    empty result.
    """
    model, found = fit(docs, labels, id_col, text_col, label_col)
    scored = found.mapInArrow(_scorer(model), "id long, score double, evidence array<long>, cosines array<double>")
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosines")
