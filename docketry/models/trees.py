"""Trees over sparse non-negative features; work and storage follow the non-zero entries.

Spark's own tree learner holds every row as an array over all columns, and a
task's sums for a node cover all columns too. Here rows are kept in blocks of the bins
of their non-zero entries; a level of all trees is one pass, whose sums by (node, column,
bin) meet by node or column, and zeros are what a node's total leaves. Rows find their
node from the splits so far, so no pass leaves a state behind. Thresholds, gains, ties
and pruning follow Spark's learner with its defaults (32 bins).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.features import sparse_columns
from docketry.session import written

BINS = 32
EPSILON = 2.220446049250313e-16


def any_negative(dataset: DataFrame, features: str) -> bool:
    """Whether a feature is below zero, as in document vectors: those have few columns, all filled, and stay with Spark's trees."""
    return not sparse_columns(dataset.select(features), features).filter(F.exists("_val", lambda x: x < 0)).isEmpty()


def thresholds(entries: DataFrame, n: int) -> DataFrame:
    """``(feature, cut)``: thresholds of every column from its distinct values and their counts, zeros included.

    As many as there are gaps between values, or, with more values than bins, those
    where the running count passes the next multiple of n / ``BINS``.
    """
    counts = entries.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    listed = counts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("value", "c"))).alias("v"),
                                           F.sum("c").alias("filled"))
    zero = F.array(F.struct(F.lit(0.0).alias("value"), (F.lit(n) - F.col("filled")).alias("c")))
    listed = listed.withColumn("v", F.when(F.col("filled") < n, F.concat(zero, "v")).otherwise(F.col("v")))
    bins = min(BINS, n)
    stride = float(n) / max(bins, 1)
    gaps = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v")),
                      lambda a, b: F.struct(((a["value"] + b["value"]) / 2).alias("cut"), b["c"].alias("c")))
    start = F.struct(F.col("v")[0]["c"].alias("seen"), F.lit(stride).alias("target"),
                     F.array().cast("array<double>").alias("cut"))

    def step(s, gap):
        seen = s["seen"] + gap["c"]
        passed = F.abs(s["seen"] - s["target"]) < F.abs(seen - s["target"])
        return F.struct(
            seen.alias("seen"), F.when(passed, s["target"] + stride).otherwise(s["target"]).alias("target"),
            F.when(passed, F.concat(s["cut"], F.array(gap["cut"]))).otherwise(s["cut"]).alias("cut"))

    quantiles = F.aggregate(gaps, start, step, lambda s: s["cut"])
    return listed.filter(F.size("v") > 1).select(
        "feature", F.when(F.size("v") <= bins, F.transform(gaps, lambda g: g["cut"])).otherwise(quantiles).alias("cut"))


def _placed(dataset: DataFrame, features: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(row, label, ..)``, entries ``(row, feature, bin)`` without those in the lowest bin, and the thresholds by column."""
    known = F.coalesce(F.col(label).cast("double"), F.raise_error(F.lit("labels must not be null")).cast("double"))
    rows = sparse_columns(dataset.select(features, known.alias("label")), features)
    held = written(rows.select(F.monotonically_increasing_id().alias("row"), "label", "_idx", "_val"), "tree-rows")
    zipped = F.explode(F.arrays_zip("_idx", "_val"))
    entries = held.select("row", zipped.alias("e")).select(
        "row", F.col("e._idx").alias("feature"), F.col("e._val").alias("value")).filter("value <> 0")
    cuts = written(thresholds(entries, held.count()), "tree-cuts")
    bins = F.size(F.filter("cut", lambda c: c < F.col("value")))
    return held, entries.join(cuts, "feature").select("row", "feature", bins.alias("bin")).filter("bin > 0"), cuts


def binned(dataset: DataFrame, features: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(label, idx, bin)``, entries in the lowest bin left out, and the thresholds by column; both written once."""
    held, placed, cuts = _placed(dataset, features, label)
    lists = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("feature", "bin"))).alias("e"))
    out = held.select("row", "label").join(lists, "row", "left")
    empty = F.array().cast("array<int>")
    return written(out.select("label", F.coalesce("e.feature", empty).alias("idx"), F.coalesce("e.bin", empty).alias("bin")),
                   "tree-bins"), cuts


BLOCK = 1 << 20  # entries of a block of rows, about
BLOCK_ROWS = 1 << 16
BLOCK_COLUMNS = "block long, label binary, key binary, start binary, row binary"
SUMS = "part int, block long, node binary, key binary, sums binary"
BEST = "node int, feature int, cut int, gain double, n double, a double, b double"


class Block:
    """Rows as labels and their entries ordered by column and bin; ``start`` bounds the entries of each (column, bin)."""

    def __init__(self, number: int, label: np.ndarray, key: np.ndarray, start: np.ndarray, row: np.ndarray):
        self.number, self.label, self.key, self.start, self.row = number, label, key, start, row

    def above(self, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (column, cut): rows above the cut, and which of the pairs they belong to."""
        low = self.start[np.searchsorted(self.key, feature * BINS + cut + 1)]
        high = self.start[np.searchsorted(self.key, (feature + 1) * BINS)]
        lengths = high - low
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(int(lengths.sum())) + np.repeat(low - np.cumsum(lengths) + lengths, lengths)
        return self.row[at], owner


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for number, label, key, start, row in zip(*(b.column(i).to_pylist() for i in range(5))):
            yield Block(number, np.frombuffer(label), np.frombuffer(key, np.int64), np.frombuffer(start, np.int64),
                        np.frombuffer(row, np.int32))


def _block(number: int, held: list) -> pa.RecordBatch:
    label, lengths, idx, bins = (np.concatenate(x) for x in zip(*held))
    row = np.repeat(np.arange(len(label), dtype=np.int32), lengths)
    key = idx.astype(np.int64) * BINS + bins
    order = np.argsort(key, kind="stable")
    key, start = np.unique(key[order], return_index=True)
    arrays = (label, key, np.append(start, len(order)).astype(np.int64), row[order])
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]],
                                      names=["block", "label", "key", "start", "row"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, entries, number = [], 0, 0, TaskContext.get().partitionId() << 32
    for b in batches:
        for low in range(0, b.num_rows, 1024):
            part = b.slice(low, 1024)
            idx, bins = part.column("idx"), part.column("bin")
            held.append((part.column("label").to_numpy(zero_copy_only=False).astype(float), idx.value_lengths().to_numpy(),
                         idx.flatten().to_numpy(), bins.flatten().to_numpy()))
            n, entries = n + part.num_rows, entries + len(held[-1][2])
            if entries >= BLOCK or n >= BLOCK_ROWS:
                yield _block(number, held)
                held, n, entries, number = [], 0, 0, number + 1
    if n:
        yield _block(number, held)


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of binned rows, written once; a task holds one block at a time."""
    entries = rows.agg(F.sum(F.size("idx").cast("long"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-entries // BLOCK))
    return written(rows.repartition(tasks).mapInArrow(_pack, BLOCK_COLUMNS), "tree-blocks").persist(
        StorageLevel.MEMORY_AND_DISK)


class Tree:
    """A tree while it grows; nodes are numbered level by level, with their sums (rows, a, b).

    For classes, a and b are the weights of class 0 and 1; for numbers, their sum and sum of squares.
    """

    def __init__(self, total: tuple[float, float, float], impurity: str):
        self.impurity, self.total = impurity, [total]
        self.feature, self.cut, self.left, self.right, self.levels = [-1], [0], [0], [0], [0, 1]
        self.open = [0] if total[0] and own_impurity(impurity, *total) >= EPSILON else []

    def extend(self, found: list[tuple], last: bool) -> None:
        """Take in a level's splits, ``(node, feature, cut, n, a, b)`` with the sums of the right side, by node."""
        self.open = []
        for node, feature, cut, *right in found:
            left = len(self.total)
            self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, left + 1
            for side in (tuple(x - y for x, y in zip(self.total[node], right)), tuple(right)):
                if not last and abs(own_impurity(self.impurity, *side)) >= EPSILON:
                    self.open.append(len(self.total))
                self.total.append(side)
                for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0)):
                    column.append(empty)
        self.levels.append(len(self.total))

    def prune(self) -> Tree:
        """Leaves of one node that predict the same class become one."""
        for node in reversed(range(len(self.total))):  # children have larger numbers
            a, b = self.left[node], self.right[node]
            if self.feature[node] >= 0 and self.feature[a] < 0 and self.feature[b] < 0 and self.predicted(a) == self.predicted(b):
                self.feature[node] = -1
        return self

    def predicted(self, node: int) -> float:
        return float(self.total[node][2] > self.total[node][1])

    def routes(self) -> tuple:
        """What places rows: arrays over nodes, 9 bytes each, and where levels end; a right child follows its left one."""
        return tuple(np.array(x, t) for x, t in ((self.feature, np.int32), (self.cut, np.uint8), (self.left, np.int32))), self.levels

    def state(self, cuts: dict, value) -> dict:
        """Plain lists for the model; ``value`` maps a leaf to its list of numbers."""
        number, order = {}, [0]
        for node in order:  # grows while it is read
            number[node] = len(number)
            order += (self.left[node], self.right[node]) if self.feature[node] >= 0 else ()
        inner = [n if self.feature[n] >= 0 else None for n in order]
        return {
            "feature": [self.feature[n] for n in order],
            "cut": [0.0 if n is None else cuts[self.feature[n]][self.cut[n]] for n in inner],
            "left": [0 if n is None else number[self.left[n]] for n in inner],
            "right": [0 if n is None else number[self.right[n]] for n in inner],
            "value": [value(n) if self.feature[n] < 0 else [] for n in order],
        }


def place(block: Block, routes: tuple) -> np.ndarray:
    """The node of every row of a block."""
    (feature, cut, left), levels = routes
    node = np.zeros(len(block.label), np.int64)
    for low, high in zip(levels, levels[1:]):
        inner = low + np.flatnonzero(feature[low:high] >= 0)
        if len(inner):
            row, owner = block.above(feature[inner].astype(np.int64), cut[inner].astype(np.int64))
            owner = inner[owner]
            own = node[row] == owner
            row, owner = row[own], owner[own]
            node = np.where(feature[node] >= 0, left[node], node)
            node[row] = left[owner] + 1
    return node


def impurity_of(kind: str, n, a, b):
    if kind == "gini":
        total = a + b
        return 1.0 - a / total * (a / total) - b / total * (b / total)
    return (b - a * a / n) / n


def own_impurity(kind: str, n: float, a: float, b: float) -> float:
    return impurity_of(kind, n, a, b) if n and (kind != "gini" or a + b) else 0.0


def _sums_of(block: Block, rows, open_nodes: list, share: float, parts: int):
    """A block's sums (rows, a, b) by open node and (column, bin), by part of the reduction.

    ``rows`` gives for each tree the node of every row and its three weights. With a
    ``share`` below one, a node sees the columns whose hash with the node's number falls below it.
    """
    column = block.key // BINS
    each = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(block.start))
    salted = _mixed(column.astype(np.uint64))
    found, first = [], 0
    for tree, (node, *weights) in enumerate(rows):
        opened = np.asarray(open_nodes[tree], np.int64)
        if not len(opened):
            continue
        number = np.full(max(int(node.max(initial=0)), int(opened.max())) + 1, -1, np.int32)
        number[opened] = first + np.arange(len(opened))
        at = np.where(weights[0] > 0, number[node], np.int32(-1))
        first += len(opened)
        here = at[block.row]
        chosen = np.flatnonzero(here >= 0)
        if share < 1.0:
            salt = _mixed((np.uint64(tree + 1) << np.uint64(32)) + np.arange(len(number), dtype=np.uint64))
            drawn = _mixed(salted[each[chosen]] ^ salt[node][block.row[chosen]])
            chosen = chosen[drawn < np.uint64(int(share * 2.0**64))]
        here = here[chosen]
        if len(opened) > 1:  # entries come by column and bin
            order = np.argsort((here - number[opened[0]]).astype(np.int16 if len(opened) < 1 << 15 else np.int32), kind="stable")
            chosen, here = chosen[order], here[order]
        if not len(chosen):
            continue
        key, row = each[chosen], block.row[chosen]
        start = np.flatnonzero((np.diff(here, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
        found.append((here[start].astype(np.int64), block.key[key[start]],
                      np.stack([np.add.reduceat(w[row], start) for w in weights], axis=1)))
    if not found:
        return
    node, key, sums = (np.concatenate(x) for x in zip(*found))
    part = (node if first >= parts else key // BINS) % parts
    for p in range(parts):
        own = part == p
        if own.any():
            yield p, block.number, node[own].tobytes(), key[own].tobytes(), sums[own].tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _best_of(node: np.ndarray, key: np.ndarray, sums: np.ndarray, total: np.ndarray, kind: str) -> tuple[np.ndarray, ...]:
    """``(node, feature, cut, gain, sums of the right side)`` of the best split of every node.

    ``sums`` has one row for each node and (column, bin); those of a node and column follow each other from the highest bin down.
    """
    feature = key // BINS
    head = (np.diff(node, prepend=-1) != 0) | (np.diff(feature, prepend=-1) != 0)
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    at = np.flatnonzero(rank == 1)
    while len(at):  # bins at most
        sums[at] += sums[at - 1]
        at = at[at + 1 < len(rank)] + 1
        at = at[rank[at] > 0]
    cut = np.where(np.append(head[1:], True), 0, np.append(key[1:], 0) % BINS)  # the next lower bin with rows
    whole = total[node]
    left = whole - sums
    with np.errstate(divide="ignore", invalid="ignore"):
        size, low, high = ((x[:, 1] + x[:, 2]) if kind == "gini" else x[:, 0] for x in (whole, left, sums))
        gain = (impurity_of(kind, *whole.T) - low / size * impurity_of(kind, *left.T)
                - high / size * impurity_of(kind, *sums.T))
    sided = (sums[:, 0] > 0) & (left[:, 0] > 0) & (low > 0) & (high > 0) & (gain > 0)
    return _first_of(*(x[sided] for x in (node, feature, cut, gain, sums)))


def _first_of(node, feature, cut, gain, *rest) -> tuple[np.ndarray, ...]:
    """Each node's split of largest gain; equal gains go to the smaller column, then the lower cut."""
    most = np.full(int(node.max(initial=-1)) + 1, -np.inf)
    np.maximum.at(most, node, gain)
    top = np.flatnonzero(gain == most[node])
    order = top[np.lexsort((cut[top], feature[top], node[top]))]
    order = order[np.diff(node[order], prepend=-1) != 0]
    return tuple(x[order] for x in (node, feature, cut, gain, *rest))


def _best_in(total: np.ndarray, kind: str):
    """The best split of every node over the columns of a part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        node, key = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("node", "key"))
        sums = np.frombuffer(b"".join(table.column("sums").to_pylist())).reshape(-1, 3)
        order = np.lexsort((-(key % BINS), key // BINS, node))
        node, key, sums = node[order], key[order], sums[order]
        start = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
        node, feature, cut, gain, sums = _best_of(node[start], key[start], np.add.reduceat(sums, start), total, kind)
        return pa.table([pa.array(x).cast(t) for x, t in (
            (node, pa.int32()), (feature, pa.int32()), (cut, pa.int32()), (gain, pa.float64()),
            (sums[:, 0], pa.float64()), (sums[:, 1], pa.float64()), (sums[:, 2], pa.float64()))],
            names=["node", "feature", "cut", "gain", "n", "a", "b"])

    return run


def grow_level(blocks: DataFrame, weighed, trees: list[Tree], last: bool, share: float = 1.0) -> None:
    """One level more for all ``trees``: one pass over the blocks, whose sums meet by node or by column.

    ``weighed(block)`` yields for each tree the node of every row and its weights (rows, a, b).
    """
    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    opened = [t.open for t in trees]
    total = np.array([t.total[node] for t in trees for node in t.open], float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            for p, number, *arrays in _sums_of(block, weighed(block), opened, share, parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in arrays]],
                    names=["part", "block", "node", "key", "sums"])

    best = blocks.mapInArrow(sums, SUMS).groupBy("part").applyInArrow(_best_in(total, trees[0].impurity), BEST).toPandas()
    best = best.sort_values(["node", "gain", "feature", "cut"], ascending=[True, False, True, True]).drop_duplicates("node")
    owner = [(t, node) for t in trees for node in t.open]
    found = {id(t): [] for t in trees}
    for at, *split in best.drop(columns="gain").itertuples(index=False, name=None):
        found[id(owner[at][0])].append((owner[at][1], *split))
    for t in trees:
        t.extend(found[id(t)], last)


def roots(blocks: DataFrame, weighed, count: int, impurity: str) -> list[Tree]:
    """Trees of one node each, with its sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            rows = [[float(w.sum()) for w in weights] for _, *weights in weighed(block)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), block.number), pa.int64()),
                 *[pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]], names=["tree", "block", "n", "a", "b"])

    found = blocks.mapInArrow(sums, "tree int, block long, n double, a double, b double").groupBy("tree").agg(
        *[F.sum(c).alias(c) for c in "nab"]).collect()
    total = {r["tree"]: (r["n"], r["a"], r["b"]) for r in found}
    return [Tree(total.get(t, (0.0, 0.0, 0.0)), impurity) for t in range(count)]


def cuts_of(cuts: DataFrame, trees: list[Tree]) -> dict[int, list[float]]:
    """Thresholds of the columns that the trees split on."""
    used = sorted({f for t in trees for f in t.feature if f >= 0})
    chosen = cuts.sparkSession.createDataFrame([(f,) for f in used], "feature int")
    return {r["feature"]: r["cut"] for r in cuts.join(F.broadcast(chosen), "feature").collect()}


def grow(blocks: DataFrame, depth: int, count: int = 1, share: float = 1.0, seed: int = 42) -> list[Tree]:
    """Class trees of any depth, all at once; several ones see each row a Poisson(1) number of times."""

    def weighed(routes):
        def of(block: Block):
            rng = np.random.default_rng([seed, block.number])
            for t in range(count):
                w = rng.poisson(1.0, len(block.label)).astype(float) if count > 1 else np.ones(len(block.label))
                yield (place(block, routes[t]) if routes else np.zeros(len(w), np.int64), w, w * (1 - block.label),
                       w * block.label)

        return of

    trees = roots(blocks, weighed(None), count, "gini")
    for level in range(depth):
        if not any(t.open for t in trees):
            break
        grow_level(blocks, weighed([t.routes() for t in trees]), trees, level + 1 == depth, share)
    return [t.prune() for t in trees]


COLUMN_BLOCK = 1 << 21  # entries of a block of columns, about


class Columns:
    """All entries dealt by column: a task has all rows of its columns, so that no sums meet and a level is one pass without exchange.

    The driver keeps some numbers for every row (label, node, weights: 40 bytes) and sends them
    to the tasks; a task answers with its best split of every node and a bit for every row.
    """

    def __init__(self, dataset: DataFrame, features: str, label: str):
        held, placed, self.cuts = _placed(dataset, features, label)
        rows = held.select("row", "label").toPandas().sort_values("row")  # numbers only
        self.label = rows["label"].to_numpy(float)
        part, first = np.unique(rows["row"].to_numpy(np.int64) >> 33, return_index=True)
        spark = dataset.sparkSession
        starts = spark.createDataFrame([(int(p), int(f)) for p, f in zip(part, first)], "part long, start long")
        entries = written(placed.join(F.broadcast(starts), F.shiftright("row", 33) == F.col("part")).select(
            "feature", "bin", (F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1)).cast("int").alias("row")), "tree-entries")
        tasks = max(spark.sparkContext.defaultParallelism, -(-entries.count() // COLUMN_BLOCK))
        self.blocks = written(entries.repartition(tasks, "feature").mapInArrow(_pack_columns, BLOCK_COLUMNS),
                              "tree-columns").persist(StorageLevel.MEMORY_AND_DISK)

    def unpersist(self) -> None:
        self.blocks.unpersist()

    def grow(self, depth: int, impurity: str, a: np.ndarray, b: np.ndarray) -> tuple[Tree, np.ndarray]:
        """A tree and the node of every row, for the rows' weights or numbers ``a`` and ``b``."""
        n, node = len(self.label), np.zeros(len(self.label), np.int32)
        tree = Tree((float(n), float(a.sum()), float(b.sum())), impurity)
        for level in range(depth):
            if not tree.open:
                break
            opened = np.array(tree.open)
            number = np.full(len(tree.total), -1, np.int32)
            number[opened] = np.arange(len(opened))
            found, right = self._best(number[node], a, b, np.array([tree.total[o] for o in opened], float), impurity)
            tree.extend([(int(opened[at]), int(f), int(c), *map(float, sums)) for at, f, c, _, sums in zip(*found)], level + 1 == depth)
            left, other, feature = (np.array(x, np.int32) for x in (tree.left, tree.right, tree.feature))
            node = np.where(feature[node] >= 0, np.where(right, other[node], left[node]), node)
        return tree, node

    def _best(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, kind: str):
        """The best split of every open node (``at``: its number for each row, or -1), and which rows lie above theirs."""
        n, sent = len(at), self.blocks.sparkSession.sparkContext.broadcast((at, a, b, total))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, a, b, total = sent.value
            for block in blocks_in(batches):
                node, key, sums = _column_sums(block, at, a, b)
                if not len(node):
                    continue
                found = _best_of(node[::-1], key[::-1], sums[::-1].copy(), total, kind)
                above, owner = block.above(found[1], found[2])
                bits = np.zeros(n, bool)
                bits[above[at[above] == found[0][owner]]] = True
                arrays = [np.asarray(x, t).tobytes() for x, t in zip(found, (np.int64, np.int64, np.int64, float, float))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*arrays, np.packbits(bits).tobytes())],
                                                 names=["node", "feature", "cut", "gain", "sums", "bits"])

        answers = self.blocks.mapInArrow(run, "node binary, feature binary, cut binary, gain binary, sums binary, bits binary").collect()
        sent.unpersist()
        kinds = (("node", np.int64), ("feature", np.int64), ("cut", np.int64), ("gain", float))
        found = [np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in answers)]) for c, t in kinds]
        sums = np.concatenate([np.zeros((0, 3)), *(np.frombuffer(r["sums"]).reshape(-1, 3) for r in answers)])
        block = np.repeat(np.arange(len(answers)), [len(r["node"]) // 8 for r in answers])
        *found, sums, block = _first_of(*found, sums, block)
        by_node = np.full(len(total) + 1, -1)  # last: rows of no open node
        by_node[found[0]] = block
        wins, right = by_node[at], np.zeros(n, bool)
        for number in np.unique(block):
            own = np.flatnonzero(wins == number)
            right[own] = np.unpackbits(np.frombuffer(answers[number]["bits"], np.uint8), count=n)[own].astype(bool)
        return (*found, sums), right


def _pack_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(c).to_numpy() for c in ("feature", "bin", "row")] for b in batches]
    if held:
        feature, bins, row = (np.concatenate(x) for x in zip(*held))
        key = feature.astype(np.int64) * BINS + bins
        order = np.lexsort((row, key))
        key, start = np.unique(key[order], return_index=True)
        arrays = (np.zeros(0), key, np.append(start, len(order)).astype(np.int64), row[order].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          *[pa.array([x.tobytes()], pa.binary()) for x in arrays]],
                                         names=["block", "label", "key", "start", "row"])


def _column_sums(block: Block, at: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Sums (rows, a, b) of a block of columns by open node and (column, bin)."""
    each = np.repeat(np.arange(len(block.key), dtype=np.int32), np.diff(block.start))
    here = at[block.row]
    if here.max(initial=-1) > 0:  # entries come by column and bin
        order = np.argsort(here.astype(np.int16) if here.max() < 1 << 15 else here, kind="stable")
        order = order[np.searchsorted(here[order], 0):]
    else:
        order = np.flatnonzero(here >= 0)
    here, each, row = here[order].astype(np.int64), each[order], block.row[order]
    start = np.flatnonzero((np.diff(here, prepend=-1) != 0) | (np.diff(each, prepend=-1) != 0))
    if not len(start):
        return here, each, np.zeros((0, 3))
    counts = np.diff(np.append(start, len(row))).astype(float)
    sums = np.stack([counts, np.add.reduceat(a[row], start), np.add.reduceat(b[row], start)], axis=1)
    return here[start], block.key[each[start]], sums


class SparseTree(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Classification tree by Gini impurity."""

    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", depth=30):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", depth=30)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        if any_negative(dataset, self.getFeaturesCol()):
            return DecisionTreeClassifier(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                                          maxDepth=self.getOrDefault(self.depth), seed=42).fit(dataset)
        columns = Columns(dataset, self.getFeaturesCol(), self.getLabelCol())
        try:
            tree = columns.grow(self.getOrDefault(self.depth), "gini", 1 - columns.label, columns.label)[0].prune()
        finally:
            columns.unpersist()
        state = [tree.state(cuts_of(columns.cuts, [tree]), lambda node: list(tree.total[node][1:]))]
        return SparseTreesModel(featuresCol=self.getFeaturesCol(), kind="counts", state=json.dumps(state))


class SparseForest(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random forest by Gini impurity: rows drawn with replacement, each node sees the square root of the columns on average."""

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="treated", trees=100, depth=30, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="treated", trees=100, depth=30, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        features, depth, seed = self.getFeaturesCol(), self.getOrDefault(self.depth), self.getOrDefault(self.seed)
        count = self.getOrDefault(self.trees)
        if any_negative(dataset, features):
            return RandomForestClassifier(featuresCol=features, labelCol=self.getLabelCol(), numTrees=count,
                                          featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed).fit(dataset)
        vec = F.unwrap_udt(F.col(features))
        width = dataset.agg(F.max(F.coalesce(vec["size"], F.size(vec["values"])))).first()[0] or 1
        rows, cuts = binned(dataset, features, self.getLabelCol())
        blocks = packed(rows)
        try:
            grown = grow(blocks, depth, count, math.ceil(math.sqrt(width)) / width, seed)
        finally:
            blocks.unpersist()
        known = cuts_of(cuts, grown)

        def shares(tree: Tree, node: int) -> list[float]:
            _, w0, w1 = tree.total[node]
            return [w0 / (w0 + w1), w1 / (w0 + w1)] if w0 + w1 else [0.5, 0.5]

        state = [t.state(known, lambda node, t=t: shares(t, node)) for t in grown]
        return SparseTreesModel(featuresCol=features, kind="shares", state=json.dumps(state))


def _sent(tree: dict, width: int) -> tuple[np.ndarray, ...]:
    """Column, cut and left child of the nodes, for a leaf the place of its values, and these; a right child follows its left one."""
    feature = np.array(tree["feature"], np.int32)
    leaf = feature < 0
    left = np.where(leaf, np.cumsum(leaf) - 1, np.array(tree["left"], np.int64)).astype(np.int32)
    return feature, np.array(tree["cut"], float), left, np.array([v for v in tree["value"] if v], float).reshape(-1, width)


class SparseTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Applies trees to sparse rows: class weights of one tree, class shares or a margin summed over trees."""

    kind = Param(Params._dummy(), "kind", "counts: class weights of one tree; shares: class shares summed; "
                 "vote, boosted: margins summed", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "nodes of the trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, kind=None, state=None):
        super().__init__()
        self._setDefault(featuresCol="features", kind="counts")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state, kind = json.loads(self.getOrDefault(self.state)), self.getOrDefault(self.kind)
        width = 2 if kind in ("counts", "shares") else 1
        trees = [_sent(t, width) for t in state]
        del state
        sent = dataset.sparkSession.sparkContext.broadcast(trees)  # nodes only

        @F.pandas_udf("array<double>")
        def leaves(ix: pd.Series, vx: pd.Series) -> pd.Series:
            n = len(ix)
            total = np.zeros((n, width))
            if not n:
                return pd.Series([], dtype=object)
            col = np.concatenate([np.asarray(a, np.int64) for a in ix])
            val = np.concatenate([np.asarray(a, float) for a in vx])
            span = max(int(col.max(initial=0)), max((int(t[0].max()) for t in sent.value), default=0)) + 1
            place = np.repeat(np.arange(n), [len(a) for a in ix]) * span + col  # ascending
            place, val = np.append(place, n * span), np.append(val, 0.0)
            for feature, cut, left, value in sent.value:
                node = np.zeros(n, np.int64)
                moving = np.flatnonzero(feature[node] >= 0)
                while len(moving):
                    here = node[moving]
                    wanted = moving * span + feature[here]
                    at = np.searchsorted(place, wanted)
                    x = np.where(place[at] == wanted, val[at], 0.0)
                    node[moving] = left[here] + (x > cut[here])
                    moving = moving[feature[node[moving]] >= 0]
                total += value[left[node]]
            return pd.Series(list(total))

        held = sparse_columns(dataset, self.getFeaturesCol()).withColumn("_leaf", leaves("_idx", "_val"))
        m = F.col("_leaf")[0]
        if width == 2:
            raw, p = F.col("_leaf"), F.col("_leaf")[1] / (F.col("_leaf")[0] + F.col("_leaf")[1])
            label = (F.col("_leaf")[1] > F.col("_leaf")[0]).cast("double")
        else:
            shrunk = m / F.lit(float(max(len(trees), 1))) if kind == "vote" else m
            raw, p, label = F.array(-m, m), 1 / (1 + F.exp(-2 * shrunk)), (m > 0).cast("double")
        return (held.withColumn("_p", p).withColumn("rawPrediction", array_to_vector(raw))
                .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", label).drop("_idx", "_val", "_leaf", "_p"))
