"""Nystrom feature maps for polynomial and RBF kernels (Williams and Seeger, 2001).

k(x, z) is approximated by phi(x) . phi(z) with phi(x) = W^(-1/2) k(L, x), W the
kernel matrix of m landmark rows L. A linear margin classifier on phi is then a
kernel classifier. What is sent to the tasks are m sparse landmark rows and one
m x m matrix, whatever the number of rows to be mapped.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.features import sparse_columns


class _KernelParams(HasInputCol, HasOutputCol):
    kernel = Param(Params._dummy(), "kernel", "poly or rbf", TypeConverters.toString)
    degree = Param(Params._dummy(), "degree", "degree of the polynomial", TypeConverters.toInt)
    coef0 = Param(Params._dummy(), "coef0", "constant of the polynomial", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width, 0 = scale", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "number of landmark rows", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    choice = Param(Params._dummy(), "choice", "landmarks by leverage or by hash alone", TypeConverters.toString)


def scale_gamma(df: DataFrame, features: str) -> float:
    """1 / (columns * variance of all entries, zeros included), for non-negative features."""
    entries = F.transform(F.col("_val"), F.abs)
    added = F.aggregate(entries, F.lit(0.0), lambda t, x: t + x)
    squares = F.aggregate(entries, F.lit(0.0), lambda t, x: t + x * x)
    vec = F.unwrap_udt(F.col(features))
    rows = sparse_columns(df.select(features), features)
    row = rows.agg(F.sum(added).alias("sum"), F.sum(squares).alias("squares"), F.count(features).alias("count"),
                   F.max(F.coalesce(vec["size"], F.size("_val"))).alias("width")).first()
    v, cells = row["width"], float(row["count"]) * row["width"]
    mean, square = row["sum"] / cells, row["squares"] / cells
    variance = square - mean * mean
    return 1.0 / (v * variance) if variance > 0 else 1.0


def kernel_values(dots: np.ndarray, sq_x: np.ndarray, sq_l: np.ndarray, kernel: str, gamma: float, degree: int,
                  coef0: float) -> np.ndarray:
    if kernel == "poly":
        return (gamma * dots + coef0) ** degree
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum(sq_x[:, None] + sq_l[None, :] - 2 * dots, 0.0))
    raise ValueError(f"unknown kernel {kernel!r}")


def own_values(squares: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    """Kernel of each row with itself."""
    return np.ones(len(squares)) if kernel == "rbf" else (gamma * squares + coef0) ** degree


OFTEN = 8  # landmarks that hold a column before it counts as frequent
MOST_OFTEN = 2_048  # frequent columns, kept as a matrix
ROWS_AT_ONCE = 2_000  # laid out over the frequent columns
MOST_LOOKED_UP = 1 << 24  # columns are found in a table up to this number, by search beyond


class LandmarkIndex:
    """Posting lists of the landmark rows; dot products with a batch of sparse rows.

    With ``often`` the columns that many landmarks hold are multiplied as a
    matrix, which is faster and rounds a row's last digits by the rows beside it.
    """

    def __init__(self, idx: list[np.ndarray], val: list[np.ndarray], often: bool = False):
        owner = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
        column = np.concatenate(idx) if idx else np.array([], dtype=int)
        weight = np.concatenate(val) if val else np.array([])
        order = np.argsort(column, kind="stable")
        columns, first = np.unique(column[order], return_index=True)
        self._hold(columns, np.append(first, len(order)), owner[order], weight[order], len(idx), OFTEN if often else 0)

    @classmethod
    def ordered(cls, columns, bounds, owner, weight, m: int, often: int = 0) -> LandmarkIndex:
        """From entries that come by column; columns of ``often`` rows or more are frequent, none with 0."""
        index = cls.__new__(cls)
        index._hold(columns, bounds, owner, weight, m, often)
        return index

    def _hold(self, columns, bounds, owner, weight, m: int, often: int) -> None:
        self.columns, self.bounds, self.owner, self.weight, self.m = columns, bounds, owner, weight, m
        self.lookup, self.place, self.table = None, None, np.zeros((0, self.m))
        if often and len(self.columns):
            held = np.diff(self.bounds)
            chosen = np.flatnonzero(held >= often)
            chosen = chosen[np.argsort(-held[chosen], kind="stable")[:MOST_OFTEN]]
            self.place = np.full(len(self.columns), -1)
            self.place[chosen] = np.arange(len(chosen))
            at = np.repeat(self.place, held)
            cell, inside = at * self.m + self.owner, at >= 0
            self.table = np.bincount(cell[inside], self.weight[inside], minlength=len(chosen) * self.m).reshape(-1, self.m)

    def postings(self, col: np.ndarray) -> np.ndarray:
        """How many postings each entry meets, those in frequent columns left out."""
        at = self._found(col)
        lengths = np.where(at >= 0, np.diff(self.bounds)[at], 0) if len(self.columns) else np.zeros(len(col), np.int64)
        return np.where(self.place[at] >= 0, 0, lengths) if len(self.table) else lengths

    def dots(self, idx: list[np.ndarray], val: list[np.ndarray]) -> np.ndarray:
        n = len(idx)
        row = np.repeat(np.arange(n), [len(i) for i in idx])
        return self.products(row, np.concatenate(idx).astype(np.int64), np.concatenate(val), n) if n else np.zeros((0, self.m))

    def products(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Dot products of ``n`` rows given by their entries, in ascending order of the rows."""
        if n == 0 or len(self.columns) == 0:
            return np.zeros((n, self.m))
        at = self._found(col)
        hit = at >= 0
        row, x, at = row[hit], x[hit], at[hit]
        if not len(self.table):
            return self._by_postings(row, at, x, n)
        place = self.place[at]
        often = place >= 0
        out = self._by_postings(row[~often], at[~often], x[~often], n)
        row, x, place, width = row[often], x[often], place[often], len(self.table)
        for low in range(0, n, ROWS_AT_ONCE):
            part, high = slice(*np.searchsorted(row, (low, low + ROWS_AT_ONCE))), min(n, low + ROWS_AT_ONCE)
            cell = (row[part] - low) * width + place[part]
            out[low:high] += np.bincount(cell, x[part], minlength=(high - low) * width).reshape(-1, width) @ self.table
        return out

    def _found(self, col: np.ndarray) -> np.ndarray:
        """Place of each column among the landmarks', -1 where they lack it."""
        last = self.columns[-1]
        if self.columns[0] < 0 or last >= MOST_LOOKED_UP:
            at = np.minimum(np.searchsorted(self.columns, col), len(self.columns) - 1)
            return np.where(self.columns[at] == col, at, -1)
        if self.lookup is None:  # made where it is used, not sent
            self.lookup = np.full(last + 2, -1, np.int32)
            self.lookup[self.columns] = np.arange(len(self.columns))
        return self.lookup[np.where((col >= 0) & (col <= last), col, last + 1)]

    def _by_postings(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        lengths = self.bounds[at + 1] - self.bounds[at]
        total = int(lengths.sum())
        if total == 0:
            return np.zeros((n, self.m))
        post = np.repeat(self.bounds[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        cell = np.repeat(row * self.m, lengths) + self.owner[post]
        return np.bincount(cell, np.repeat(x, lengths) * self.weight[post], minlength=n * self.m).reshape(n, self.m)


class NystroemMap(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", kernel="poly", degree=2, coef0=0.0,
                 gamma=0.0, landmarks=256, seed=42, choice="leverage"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", kernel="poly", degree=2, coef0=0.0,
                         gamma=0.0, landmarks=256, seed=42, choice="leverage")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NystroemModel:
        """Landmarks by ridge leverage, and what their kernel leaves out of the rows' own.

        A pilot of the distinct rows with the smallest seeded hash tells how far
        each row lies outside the pilot's span; rows are then drawn in
        proportion to that, once, with keys from their hash (recursive Nystrom,
        Musco and Musco, 2017). Scores and keys are ranked alone; vectors are
        fetched for the winners only.
        """
        p = {name: self.getOrDefault(getattr(self, name))
             for name in ("kernel", "degree", "coef0", "gamma", "landmarks", "seed")}
        gamma = p["gamma"] or scale_gamma(dataset, self.getInputCol())
        rows = sparse_columns(dataset.select(self.getInputCol()), self.getInputCol())
        hashed = rows.filter(F.size("_idx") > 0).select(
            "_idx", "_val", F.xxhash64(F.lit(p["seed"]), "_idx", "_val").alias("h")
        )
        kernel = (p["kernel"], gamma, p["degree"], p["coef0"])
        chosen = Landmarks(_fetched(hashed, F.col("h"), p["landmarks"]), *kernel)
        error = chosen.left_out(hashed)
        if self.getOrDefault(self.choice) == "leverage" and error > 1e-9 and chosen.m == p["landmarks"]:
            share = chosen.leverage(hashed, error)
            u = ((F.xxhash64(F.lit("draw"), "h").bitwiseAND((1 << 52) - 1)) + 0.5) / float(1 << 52)
            drawn = Landmarks(_fetched(hashed.withColumn("_share", share), -F.log(u) / F.col("_share"), p["landmarks"]), *kernel)
            better = drawn.left_out(hashed)
            if better < error:
                chosen, error = drawn, better
        state = {
            "idx": [i.tolist() for i in chosen.idx], "val": [v.tolist() for v in chosen.val],
            "root": chosen.root.tolist(), "gamma": gamma,
        }
        model = NystroemModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), kernel=p["kernel"],
                              degree=p["degree"], coef0=p["coef0"], gamma=gamma, landmarks=chosen.m, seed=p["seed"],
                              state=json.dumps(state), kernelError=error)
        return model


def _fetched(hashed: DataFrame, key, n: int) -> list:
    """(h, _idx, _val) of the ``n`` distinct rows with the smallest keys."""
    best = hashed.groupBy("h").agg(F.min(key).alias("_key")).orderBy("_key", "h").limit(n).select("h").collect()
    rows = hashed.filter(F.col("h").isin([r["h"] for r in best])).groupBy("h").agg(
        F.first("_idx").alias("_idx"), F.first("_val").alias("_val")).orderBy("h").collect()  # n rows
    if not rows:
        raise ValueError("no row has any feature")
    return rows


class Landmarks:
    """Landmark rows, the kernel among them and the projection to features whose products are the kernel."""

    def __init__(self, rows: list, kernel: str, gamma: float, degree: int, coef0: float):
        self.kernel = (kernel, gamma, degree, coef0)
        self.idx = [np.array(r["_idx"], dtype=np.int64) for r in rows]
        self.val = [np.array(r["_val"]) for r in rows]
        self.m = len(rows)
        self.index = LandmarkIndex(self.idx, self.val, often=True)
        self.norms = np.array([v @ v for v in self.val])
        self.gram = kernel_values(self.index.dots(self.idx, self.val), self.norms, self.norms, *self.kernel)
        eig, vec = np.linalg.eigh(self.gram)
        keep = eig > 1e-10 * max(eig.max(), 1e-300)
        self.eig, self.vec = eig[keep], vec[:, keep]
        self.root = self.vec / np.sqrt(self.eig)

    def _per_row(self, df: DataFrame, weigh, kind: str = "double"):
        """Column of ``weigh(k(x, L), k(x, x))`` for rows with ``_idx`` and ``_val``."""
        sent = df.sparkSession.sparkContext.broadcast((self.index, self.norms))  # ``landmarks`` rows
        settings = self.kernel

        @F.pandas_udf(kind)
        def value(ix: pd.Series, vx: pd.Series) -> pd.Series:
            index, norms = sent.value
            out = []
            for start in range(0, len(ix), 2_000):
                i = [np.asarray(a) for a in ix.iloc[start : start + 2_000]]
                v = [np.asarray(a, dtype=float) for a in vx.iloc[start : start + 2_000]]
                square = np.array([a @ a for a in v])
                out += list(weigh(kernel_values(index.dots(i, v), square, norms, *settings), own_values(square, *settings)))
            return pd.Series(out, dtype=float if kind == "double" else object)

        return value("_idx", "_val")

    def left_out(self, df: DataFrame) -> float:
        """Share of the rows' kernel with themselves that the landmarks' features miss: the audited kernel error."""
        root = self.root
        both = self._per_row(df, lambda k, own: np.stack([np.maximum(own - ((k @ root) ** 2).sum(axis=1), 0.0), own], axis=1),
                             "array<double>")
        row = df.select(both.alias("both")).agg(F.sum(F.col("both")[0]).alias("missing"), F.sum(F.col("both")[1]).alias("whole")).first()
        return float(row["missing"] / row["whole"]) if row["whole"] else 0.0

    def leverage(self, df: DataFrame, error: float):
        """Column of every row's ridge leverage; the ridge is what a landmark leaves out on average."""
        mean = float(np.mean(np.diag(self.gram)))
        ridge = max(error * mean * df.count() / self.m, 1e-12)
        shrunk = self.vec / np.sqrt(self.eig + ridge)
        return self._per_row(df, lambda k, own: np.clip((own - ((k @ shrunk) ** 2).sum(axis=1)) / ridge, 1e-6, 1.0))


class NystroemModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "landmark rows and projection", TypeConverters.toString)
    kernelError = Param(Params._dummy(), "kernelError", "share of the training rows' kernel left out", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, kernel=None, degree=None, coef0=None, gamma=None,
                 landmarks=None, seed=None, state=None, kernelError=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        idx = [np.array(i, dtype=np.int64) for i in state["idx"]]
        val = [np.array(v) for v in state["val"]]
        sq_l = np.array([v @ v for v in val])
        shared = dataset.sparkSession.sparkContext.broadcast(
            (LandmarkIndex(idx, val, often=True), np.array(state["root"]), sq_l)
        )
        kernel, degree = self.getOrDefault(self.kernel), self.getOrDefault(self.degree)
        coef0, gamma = self.getOrDefault(self.coef0), self.getOrDefault(self.gamma)
        chunk = 2_000

        @F.pandas_udf("array<double>")
        def phi(ix: pd.Series, vx: pd.Series) -> pd.Series:
            index, root, sq = shared.value
            out = []
            for start in range(0, len(ix), chunk):
                i = [np.asarray(a) for a in ix.iloc[start : start + chunk]]
                v = [np.asarray(a, dtype=float) for a in vx.iloc[start : start + chunk]]
                sq_x = np.array([a @ a for a in v])
                k = kernel_values(index.dots(i, v), sq_x, sq, kernel, gamma, degree, coef0)
                out.extend(list(k @ root))
            return pd.Series(out)

        mapped = sparse_columns(dataset, self.getInputCol())
        return mapped.withColumn(self.getOutputCol(), array_to_vector(phi("_idx", "_val"))).drop("_idx", "_val")
