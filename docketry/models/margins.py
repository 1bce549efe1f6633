"""Margin classifiers over landmark kernels, many at once: one pass over the rows moves every one of them.

A classifier is f(x) = k(x, L) a + b with L the landmark rows; it minimises
a'Wa / 2 + C sum loss(y f(x)), W the kernel among the landmarks. The loss is the
hinge with its corner rounded over a small width (Chapelle, "Training a support
vector machine in the primal", 2007), so that Newton's method applies: rows give
gradient and curvature, both of a size set by the number of landmarks, and the
rows' dot products with the landmarks serve every kernel, degree, constant and C.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.models.kernel import kernel_values

WIDTHS = (2.0, 0.5, 0.1)  # half widths of the rounded corner, one after the other
TOLERANCE = 1e-4  # of the objective: what a further step could still gain; a hundred times that before the last width
PROGRESS = 2e-3  # of the objective: a step that gained no more ends a width too
MAX_PASSES = 60
GROUP_ROWS = 20_000  # whose products with a fold's landmarks meet in one group; more stay where they are
FLOOR = 1e-6  # of the landmarks' mean kernel with themselves
STEPS = (0.0, 1.0, 4.0, 2.0, 0.5, 0.25, 0.125, 2.0**-4, 2.0**-5, 2.0**-7, 2.0**-9)  # along a direction, tried in one pass


@dataclass
class MarginProblem:
    """One classifier: kernel setting, C, and the fold whose rows are held out (-1: none)."""

    fold: int
    kernel: str
    gamma: float
    degree: int
    coef0: float
    C: float
    gram: np.ndarray  # kernel among the landmarks
    norms: np.ndarray  # squared lengths of the landmarks
    rows: int  # to fit on
    at: int = 0  # which of the dot products of a row this problem reads
    base: np.ndarray = field(default=None)  # where the last direction starts
    direction: np.ndarray = field(default=None)
    step: float = 1.0
    value: float = float("inf")
    searched: bool = False
    narrowed: int = 0
    done: bool = False
    held_out: tuple[float, float] = (0.0, 0.0)  # hits, rows

    def __post_init__(self):
        # products are kept in 32 bits: without a floor under the spectrum, large weights would fit their rounding
        self.gram = self.gram + FLOOR * max(float(np.mean(np.diag(self.gram))), 1e-300) * np.eye(len(self.gram))
        self.base, self.direction = np.zeros(len(self.gram) + 1), np.zeros(len(self.gram) + 1)

    def spec(self) -> tuple:
        return (self.fold, self.at, self.kernel, self.gamma, self.degree, self.coef0, self.norms,
                WIDTHS[self.narrowed], self.base, self.direction, self.step)

    def advance(self, stats: np.ndarray) -> None:
        """Take in the sums at the present step: try the best step first, then set out in a new direction."""
        k = len(self.base)
        losses, rest = stats[2:2 + len(STEPS)], stats[2 + len(STEPS):]
        if self.turn_to_best(losses):
            return
        curve = np.zeros((k, k))
        curve[np.triu_indices(k)] = rest[k:]
        self.set_out(stats[0], stats[1], losses, rest[:k], curve + np.triu(curve, 1).T)

    def _values(self, losses: np.ndarray) -> np.ndarray:
        """Objective at each step along the direction."""
        a, d, steps = self.base[:-1], self.direction[:-1], np.array(STEPS)
        pull_a, pull_d = self.gram @ a, self.gram @ d
        return 0.5 * (a @ pull_a + 2 * steps * (d @ pull_a) + steps**2 * (d @ pull_d)) + self.C * losses

    def turn_to_best(self, losses: np.ndarray) -> bool:
        """Whether another step is better by the losses at all steps; it becomes the present one."""
        values = self._values(losses)
        here, best = STEPS.index(self.step), int(np.argmin(values))
        if not self.searched and values[best] < values[here] - 1e-3 * TOLERANCE * abs(values[here]):
            self.step, self.searched = STEPS[best], True
            return True
        return False

    def set_out(self, hits: float, held: float, losses: np.ndarray, slope: np.ndarray, corner: np.ndarray) -> None:
        """Take the present step, and a new direction from the rows' gradient and curvature there."""
        k, values, here = len(self.base), self._values(losses), STEPS.index(self.step)
        pull_a, pull_d = self.gram @ self.base[:-1], self.gram @ self.direction[:-1]
        self.base = self.base + self.step * self.direction
        self.value, self.held_out = float(values[here]), (float(hits), float(held))
        slow = bool(self.direction.any()) and values[0] - values[here] <= PROGRESS * abs(self.value)
        gradient = self.C * slope
        gradient[:-1] += pull_a + self.step * pull_d
        curve = self.C * corner
        curve[:-1, :-1] += self.gram
        curve[-1, -1] += 1e-3 * self.C * max(self.rows, 1)  # no row may lie in the corner
        self.direction = -np.linalg.solve(curve, gradient)
        gain = -0.5 * gradient @ self.direction
        last = self.narrowed == len(WIDTHS) - 1
        if gain <= TOLERANCE * (1 if last else 100) * max(abs(self.value), 1e-12) or slow:
            self.done, self.narrowed = last, min(self.narrowed + 1, len(WIDTHS) - 1)
            self.direction = np.zeros(k)  # the next pass sees another loss at the same place
        self.step, self.searched = 1.0, False


def _loss(z: np.ndarray, width: float) -> float:
    slack = 1 + width - z
    return np.where(z < 1 - width, 1 - z, np.where(slack > 0, slack**2 / (4 * width), 0.0)).sum()


def _kernel_with_one(dots: np.ndarray, norms: np.ndarray, *kernel) -> np.ndarray:
    """Kernel values of rows given by products with the landmarks and, last, their squared length; a column of ones behind."""
    own = dots.astype(float)
    k = np.ones(own.shape)
    k[:, :-1] = kernel_values(own[:, :-1], own[:, -1], norms, *kernel)
    return k


def _slopes(z: np.ndarray, y: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope of each row's loss, and whether the row lies in the rounded corner."""
    bent = np.abs(1 - z) <= width
    return np.where(z < 1 - width, -1.0, np.where(bent, -(1 + width - z) / (2 * width), 0.0)) * y, bent


def _row_sums(k: np.ndarray, y: np.ndarray, held: np.ndarray, width: float, base, direction, step: float) -> np.ndarray:
    """Hits and held-out rows, loss at each step, gradient, upper triangle of the curvature."""
    return _sums_along(k, y, held, k @ base, k @ direction, width, step)


def _sums_along(k: np.ndarray, y: np.ndarray, held: np.ndarray, start: np.ndarray, along: np.ndarray, width: float, step: float):
    """As ``_row_sums``, given the margins at the base and their change along the direction."""
    inside = ~held
    hits = ((start + step * along > 0) == (y > 0))[held].sum()
    begin, slant = (y * start)[inside], (y * along)[inside]
    losses = [_loss(begin + t * slant, width) for t in STEPS]
    slope, bent = _slopes(y * (start + step * along), y, width)
    corner = k[bent & inside]
    curve = corner.T @ corner / (2 * width)
    return np.concatenate([[hits, held.sum()], losses, (slope * inside) @ k, curve[np.triu_indices(k.shape[1])]])


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return np.where(batch.column("label").to_numpy() > 0.5, 1.0, -1.0)


def _sums(specs: Sequence[tuple[int, tuple]], sets: int, m: int):
    """A task's ``(problem, stats)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by_kernel = {number: 0.0 for number, _ in specs}, defaultdict(list)
        for number, spec in specs:
            by_kernel[spec[1], spec[2:6]].append((number, spec))  # a set of products has one set of landmarks
        for batch in batches:
            if not batch.num_rows:
                continue
            y, folds = _labels(pa.Table.from_batches([batch])), batch.column("fold").to_numpy(zero_copy_only=False)
            dots = np.frombuffer(b"".join(batch.column("dots").to_pylist()), np.float32).reshape(len(y), sets, m + 1)
            for (at, kernel), alike in by_kernel.items():  # kernel values and margins of all classifiers that share them
                k = _kernel_with_one(dots[:, at], alike[0][1][6], *kernel)
                lines = k @ np.stack([v for _, spec in alike for v in spec[8:10]], axis=1)
                for j, (number, spec) in enumerate(alike):
                    sums = _sums_along(k, y, folds == spec[0], lines[:, 2 * j], lines[:, 2 * j + 1], spec[7], spec[10])
                    total[number] = total[number] + sums
        seen = [(n, x) for n, x in total.items() if isinstance(x, np.ndarray)]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in seen], pa.int32()),
                                          pa.array([x for _, x in seen], pa.list_(pa.float64()))], names=["problem", "stats"])

    return run


class _Corner:
    """Products of the rows in the corner with themselves, from what the corner was before, all rows or none."""

    def __init__(self, k: np.ndarray, whole: np.ndarray):
        self.k, self.whole = k, whole
        self.rows, self.sums = np.zeros(len(k), bool), np.zeros_like(whole)

    def at(self, rows: np.ndarray) -> np.ndarray:
        known = [(self.rows, self.sums), (np.zeros(len(rows), bool), 0.0), (np.ones(len(rows), bool), self.whole)]
        before, sums = min(known, key=lambda x: np.count_nonzero(x[0] != rows))  # fewest rows to add or take away
        come, gone = self.k[rows & ~before], self.k[before & ~rows]
        self.rows, self.sums = rows, sums + come.T @ come - gone.T @ gone
        return self.sums


def solve(problem: MarginProblem, k: np.ndarray, y: np.ndarray, inside: int, whole: np.ndarray) -> None:
    """Fit one problem on kernel values in memory, in place; rows from ``inside`` on are held out.

    ``whole`` are the products of the fitted rows with themselves. A pass is one
    set of losses; gradient and curvature are summed only at the step it leads to.
    """
    own, signs, corner, passes = k[:inside], y[:inside], _Corner(k[:inside], whole), 0
    while not problem.done and passes < MAX_PASSES:
        start, along, width = k @ problem.base, k @ problem.direction, WIDTHS[problem.narrowed]
        begin, slant = signs * start[:inside], signs * along[:inside]
        steps = STEPS if problem.direction.any() else (0.0,)
        losses = np.array([_loss(begin + t * slant, width) for t in steps] * (len(STEPS) // len(steps)))
        passes += 1
        if problem.turn_to_best(losses):
            passes += 1
            if passes > MAX_PASSES:
                return
        slope, bent = _slopes(begin + problem.step * slant, signs, width)
        hits = ((start + problem.step * along > 0) == (y > 0))[inside:].sum()
        problem.set_out(hits, len(y) - inside, losses, slope @ own, corner.at(bent) / (2 * width))


def held_out_hits(rows: DataFrame, settings: dict[int, list[tuple]], grams: list, norms: list, sizes: list[int], m: int) -> dict:
    """``{(fold, setting): (hits, rows)}`` on each fold left out, for many settings.

    ``settings`` has, by fold, tuples of kernel, gamma, degree, coef0 and C. The
    products of up to ``GROUP_ROWS`` rows with a fold's landmarks meet in one
    group for the fold, at 4 (m + 1) bytes a row, and all its settings are fitted
    there; groups of all folds, and of other calls at the same time, run beside
    each other. More rows stay in their tasks, and a pass over them moves all
    settings of all folds (``fit_margins``).
    """
    sets = len(grams)
    if max(sizes[f] for f in settings) > GROUP_ROWS:
        kernels = {f: {tuple(x): kernel_values(grams[f], norms[f], norms[f], *x) for x in {tuple(s[:4]) for s in settings[f]}}
                   for f in settings}
        problems = {(f, i): MarginProblem(f, *kernel, c, kernels[f][tuple(kernel)], norms[f], sizes[f], at=f)
                    for f in settings for i, (*kernel, c) in enumerate(settings[f])}
        fit_margins(rows, list(problems.values()), sets, m)
        return {key: p.held_out for key, p in problems.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.frombuffer(x, np.float32).reshape(sets, m + 1) for x in b.column("dots").to_pylist()]
            for f in settings:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, f, np.int32)), b.column("label"), b.column("fold"),
                     pa.array([x[f].tobytes() for x in whole], pa.binary())], names=["out", "label", "fold", "dots"])

    def fit(table: pa.Table) -> pa.Table:
        out = table.column("out")[0].as_py()
        dots = np.frombuffer(b"".join(table.column("dots").to_pylist()), np.float32).reshape(table.num_rows, m + 1)
        held = table.column("fold").to_numpy() == out
        order, inside = np.argsort(held, kind="stable"), int((~held).sum())
        dots, y, found = dots[order], _labels(table)[order], []
        by_kernel = defaultdict(list)
        for number, (*kernel, c) in enumerate(settings[out]):
            by_kernel[tuple(kernel)].append((number, c))
        for kernel, members in by_kernel.items():
            k = _kernel_with_one(dots, norms[out], *kernel)
            whole = k[:inside].T @ k[:inside]
            gram = kernel_values(grams[out], norms[out], norms[out], *kernel)
            for number, c in members:
                problem = MarginProblem(out, *kernel, c, gram, norms[out], sizes[out])
                solve(problem, k, y, inside, whole)
                found.append((out, number, *problem.held_out, problem.done))
        return pa.Table.from_pylist([dict(zip(("out", "setting", "hits", "held", "done"), x)) for x in found], pa.schema([
            ("out", pa.int32()), ("setting", pa.int32()), ("hits", pa.float64()), ("held", pa.float64()), ("done", pa.bool_())]))

    dealt = rows.select("label", "fold", "dots").mapInArrow(cut, "out int, label double, fold int, dots binary")
    got = dealt.groupBy("out").applyInArrow(fit, "out int, setting int, hits double, held double, done boolean").collect()
    late = sum(not r["done"] for r in got)
    if late:
        warnings.warn(f"{late} of {len(got)} classifiers stopped after {MAX_PASSES} passes", stacklevel=2)
    return {(r["out"], r["setting"]): (r["hits"], r["held"]) for r in got}


def fit_margins(rows: DataFrame, problems: Sequence[MarginProblem], sets: int, landmarks: int) -> None:
    """Fit all ``problems`` over ``rows`` (label, fold, dots), in place.

    ``dots`` holds 32-bit floats: for each of ``sets`` landmark sets the row's
    dot products with its ``landmarks`` landmarks, then the row's squared
    length. A pass is one aggregate, summed in the tasks first; the driver gets
    (landmarks + 1)(landmarks + 2) / 2 numbers for each problem still moving.
    """
    for _ in range(MAX_PASSES):
        moving = [(n, p) for n, p in enumerate(problems) if not p.done]
        if not moving:
            return
        sums = rows.select("label", "fold", "dots").mapInArrow(
            _sums([(n, p.spec()) for n, p in moving], sets, landmarks), "problem int, stats array<double>")
        summed = sums.select("problem", array_to_vector("stats").alias("v")).groupBy("problem").agg(
            Summarizer.sum(F.col("v")).alias("v"))
        for row in summed.collect():
            problems[row["problem"]].advance(row["v"].toArray())
    late = sum(not p.done for p in problems)
    if late:
        warnings.warn(f"{late} of {len(problems)} classifiers stopped after {MAX_PASSES} passes", stacklevel=2)
