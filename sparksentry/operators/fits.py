"""Several linear fits at once: every pass over the rows serves all of them.

Each task adds up values and gradients of its rows for all columns; what reaches the driver
is one sum for each of a few tasks, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Sums that are added up by a further stage before they reach the driver, if there are more.
SUMS = 64
#: Steps that L-BFGS remembers.
MEMORY = 8


def minimise(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, passes: int, tolerance: float = 1e-3) -> np.ndarray:
    """The columns that minimise a convex function each, by L-BFGS with backtracking.

    evaluate: from points, one a column, to their values and gradients.  Columns go their own
    way: one that has to try a shorter step doesn't hold up the others.  Ends when all gradients
    are below the tolerance times their first length, or after so many passes.
    """
    x, n = start.astype(float), start.shape[1]
    f, g = evaluate(x)
    first = np.linalg.norm(g, axis=0)
    done = first == 0
    steps: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    way, length = -g, 1 / np.maximum(first, 1e-300)
    for _ in range(passes - 1):
        if done.all():
            break
        tried = x + np.where(done, 0, length) * way
        ft, gt = evaluate(tried)
        for k in np.flatnonzero(~done).tolist():
            if not ft[k] <= f[k] + 1e-4 * length[k] * float(g[:, k] @ way[:, k]):
                length[k] /= 2
                done[k] = length[k] < 1e-12
                continue
            s, y = tried[:, k] - x[:, k], gt[:, k] - g[:, k]
            if s @ y > 1e-12 * (y @ y):
                steps[k] = [*steps[k], (s, y)][-MEMORY:]
            x[:, k], f[k], g[:, k] = tried[:, k], ft[k], gt[:, k]
            done[k] = np.linalg.norm(g[:, k]) <= tolerance * first[k]
            way[:, k], length[k] = -_scaled(g[:, k], steps[k]), 1.0
    return x


def _scaled(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse Hessian as the steps show it."""
    q, used = g.copy(), []
    for s, y in reversed(steps):
        a = float(s @ q) / float(s @ y)
        q -= a * y
        used.append(a)
    if steps:
        s, y = steps[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(steps, reversed(used)):
        q += (a - float(y @ q) / float(s @ y)) * s
    return q


def summed(rows: DataFrame, of_batches: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of what a function makes of each partition's batches: float arrays of one shape, flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([of_batches(batches).astype("<f8").tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                own = np.frombuffer(part.as_py(), "<f8")
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.mapInArrow(run, "part binary")
    if len(rows.inputFiles()) > SUMS:
        parts = parts.repartition(SUMS // 8).mapInArrow(add, "part binary")
    return sum(np.frombuffer(r["part"], "<f8") for r in parts.collect())


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and weight of all entries of (indices, weights)."""
    sizes = pc.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False)
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "weights")]
    return np.repeat(np.arange(batch.num_rows), sizes), *flat


def margins(row: np.ndarray, number: np.ndarray, weight: np.ndarray, rows: int, points: np.ndarray) -> np.ndarray:
    """Every row's margin for every column; the points' last line are the offsets."""
    out = np.zeros((rows, points.shape[1]))
    if len(row):
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[begins]] = np.add.reduceat(points[number] * weight[:, None], begins, axis=0)
    return out + points[-1]


def squared_hinge(rows: DataFrame, terms: int, labels: int, folds: np.ndarray, c: float, counts: np.ndarray, passes: int) -> np.ndarray:
    """Weights and, in the last line, offsets of one-vs-rest SVMs for all folds: column fold * labels + label.

    rows: indices, weights, label (a number), _fold.  A column minimises half its squared
    weights and c times its squared hinge losses, over the rows of the other folds (of its own,
    if there is one only), divided by c times their number; offsets are free.
    """
    spark, k = rows.sparkSession, len(folds) * labels
    fold, label = np.repeat(folds, labels), np.tile(np.arange(labels), len(folds))
    n = np.repeat(counts.sum() - counts if len(folds) > 1 else counts, labels)
    alone = len(folds) == 1

    def evaluate(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(points)

        def of_batches(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            at = shared.value
            value, slope = np.zeros(k), np.zeros_like(at)
            for batch in batches:
                row, number, weight = entries(batch)
                own = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                mine = batch.column("_fold").to_numpy(zero_copy_only=False)[:, None] != fold
                side = np.where(own[:, None] == label, 1.0, -1.0)
                lack = np.maximum(1 - side * margins(row, number, weight, batch.num_rows, at), 0) * (mine | alone)
                value += (lack * lack).sum(axis=0)
                force = -2 * lack * side
                slope[-1] += force.sum(axis=0)
                for j in np.flatnonzero(force.any(axis=0)).tolist():
                    pull = force[row, j]
                    some = np.flatnonzero(pull)
                    slope[:-1, j] += np.bincount(number[some], weight[some] * pull[some], terms)
            return np.concatenate([value, slope.ravel()])

        total = summed(rows, of_batches)
        shared.unpersist()
        w = points[:-1]
        value = (0.5 * (w * w).sum(axis=0) + c * total[:k]) / (c * n)
        slope = c * total[k:].reshape(points.shape)
        slope[:-1] += w
        return value, slope / (c * n)

    return minimise(evaluate, np.zeros((terms + 1, k)), passes)


def sigmoids(rows: DataFrame, points: np.ndarray, labels: int, folds: np.ndarray, passes: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Slope and shift of each column's margin on its own fold, so that the sigmoid says how likely its label is.

    By least log loss against Platt's targets, which keep away from 0 and 1 by the number of rows.
    """
    spark, k = rows.sparkSession, len(folds) * labels
    fold, label = np.repeat(folds, labels), np.tile(np.arange(labels), len(folds))
    whole = spark.sparkContext.broadcast(points)

    def scan(at: np.ndarray | None, targets: np.ndarray | None) -> np.ndarray:
        """Loss, gradient and Hessian of every column; without a place the rows with and without its label."""

        def of_batches(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((6, k))
            for batch in batches:
                own = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                mine = batch.column("_fold").to_numpy(zero_copy_only=False)[:, None] == fold
                hit = own[:, None] == label
                if at is None:
                    out[:2] += np.stack([(mine & hit).sum(axis=0), (mine & ~hit).sum(axis=0)])
                    continue
                margin = margins(*entries(batch), batch.num_rows, whole.value)
                z, t = at[0] * margin + at[1], np.where(hit, targets[0], targets[1])
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                # log(1 + e^z) - t z, without overflow
                loss, off, bend = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - t * z, p - t, p * (1 - p)
                out += np.stack([(x * mine).sum(axis=0) for x in (loss, off * margin, off, bend * margin * margin, bend * margin, bend)])
            return out.ravel()

        return summed(rows, of_batches).reshape(6, k)

    positive, negative = scan(None, None)[:2]
    targets = np.stack([(positive + 1) / (positive + 2), 1 / (negative + 2)])
    at, best = np.stack([np.zeros(k), np.log((positive + 1) / (negative + 1))]), None
    way, length = np.zeros((2, k)), np.ones(k)
    for _ in range(passes):
        tried = at + length * way
        found = scan(tried, targets)
        better = np.ones(k, bool) if best is None else found[0] <= best[0]
        at, best = np.where(better, tried, at), found if best is None else np.where(better, found, best)
        # Newton's step, or half the last one where it didn't help
        _, first, second, aa, ab, bb = best
        size = aa * bb + 1e-12 * (aa + bb) - ab * ab
        step = np.stack([bb * first - ab * second, aa * second - ab * first]) / np.maximum(size, 1e-300)
        way, length = np.where(better, -step, way), np.where(better, 1.0, length / 2)
        if (np.abs(length * way) <= 1e-6 * (1 + np.abs(at))).all():
            break
    whole.unpersist()
    return at[0], at[1]
