"""Full-batch training of Spark ML's feed-forward classifier, with gradients worked out in arrays.

Spark deals the rows out in blocks and keeps them; a step sends the weights to every task and gets one gradient for each task back. Start weights, layer
layout, loss and steps (limited-memory BFGS with a strong Wolfe search) are those of ``MultilayerPerceptronClassifier``, and so is the model that comes out.
Every row counts the same here, whereas Spark's own trainer weights the last block of a partition by its number of blocks, not of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

#: Rows of a task, of a block on its way to Python, and of the arrays that a task works on at a time.
TASK_ROWS, BLOCK_ROWS, ARRAY_ROWS = 1 << 17, 1 << 11, 1 << 8


def fit_network(rows: DataFrame, net: MultilayerPerceptronClassifier, order: list[str], task_rows: int = TASK_ROWS) -> MultilayerPerceptronClassificationModel:
    """The model that ``net`` describes, fitted on all rows; ``order`` names the rows, so that sums do not depend on how they arrive."""
    layers, few = list(net.getLayers()), rows.limit(1)
    model = lambda extra: net.copy({net.maxIter: 0, **extra}).fit(few)  # noqa: E731  without steps: start weights, or those given
    blocks = _blocks(rows, net, order, task_rows).persist()
    try:
        loss = lambda w: _loss(blocks, layers, w)
        start = net.getInitialWeights() if net.isSet(net.initialWeights) else model({}).weights
        found = minimized(loss, np.array(start.toArray()), net.getMaxIter(), net.getTol())
    finally:
        blocks.unpersist()
    return model({net.initialWeights: Vectors.dense(found)})


def _blocks(rows: DataFrame, net: MultilayerPerceptronClassifier, order: list[str], task_rows: int) -> DataFrame:
    """Label, features and a one for up to BLOCK_ROWS rows as the bytes of a matrix of doubles."""
    width = net.getLayers()[0] + 2
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    values = F.concat(F.array(F.col(net.getLabelCol()).cast("double")), vector_to_array(net.getFeaturesCol()), F.array(F.lit(1.0))).alias("x")
    dealt = rows.select(*order, values).repartition(parts, *order).sortWithinPartitions(*order).select("x")

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            n += len(held[-1])
            if n >= BLOCK_ROWS:
                whole = np.concatenate(held)
                edge = n - n % BLOCK_ROWS
                yield from (_sent([whole[i : i + BLOCK_ROWS].tobytes()]) for i in range(0, edge, BLOCK_ROWS))
                held, n = [whole[edge:]], n - edge
        if n:
            yield _sent([np.concatenate(held).tobytes()])

    return dealt.mapInArrow(stacked, "x binary")


def _sent(blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["x"])


def _loss(blocks: DataFrame, layers: list[int], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy of all rows and its gradient: one row for each task is added up, in the order of the tasks."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 2)
        for batch in batches:
            for blob in batch.column(0):
                _add_gradient(total, layers, w, np.frombuffer(blob.as_buffer()).reshape(-1, layers[0] + 2))
        yield _sent([total.tobytes()])

    total = sum(np.frombuffer(r[0]) for r in blocks.mapInArrow(summed, "x binary").collect())
    return float(total[1] / total[0]), total[2:] / total[0]


def _pieces(w: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """Views of the weights of each layer, inputs by outputs, with the intercepts as the last row."""
    edges = np.cumsum([0, *((a + 1) * b for a, b in zip(layers, layers[1:]))])
    return [w[i:j].reshape(-1, b) for i, j, b in zip(edges, edges[1:], layers[1:])]


def _add_gradient(total: np.ndarray, layers: list[int], w: np.ndarray, block: np.ndarray) -> None:
    """Add number of rows, sum of losses and sum of gradients of a block (label, features, one); sigmoid layers, softmax on top."""
    pieces, sums, minus = _pieces(w, layers), _pieces(total[2:], layers), _pieces(-w, layers)
    values = [np.ones((n + 1, ARRAY_ROWS)) for n in layers[1:-1]]  # columns stand for rows; the last row of ones meets the intercept
    slopes = [np.empty((n, ARRAY_ROWS)) for n in layers[1:-1]]
    classes = np.arange(layers[-1])[:, None]
    for i in range(0, len(block), ARRAY_ROWS):
        part = block[i : i + ARRAY_ROWS]
        n = len(part)
        held = [part[:, 1:].T, *(v[:, :n] for v in values)]
        with np.errstate(over="ignore"):
            for before, a, after in zip(held, minus, held[1:]):
                z = after[:-1]
                np.matmul(a.T, before, out=z)
                np.exp(z, out=z)
                z += 1.0
                np.reciprocal(z, out=z)
        p = pieces[-1].T @ held[-1]
        p -= p.max(axis=0)
        own = classes == part[:, 0]
        total[1] -= p[own].sum()
        np.exp(p, out=p)
        whole = p.sum(axis=0)
        total[0] += n
        total[1] += np.log(whole).sum()
        p /= whole
        p -= own
        for k in range(len(pieces) - 1, -1, -1):
            sums[k] += held[k] @ p.T
            if k:
                z, slope = held[k][:-1], slopes[k - 1][:, :n]
                np.matmul(pieces[k][:-1], p, out=slope)
                slope *= z
                np.subtract(1.0, z, out=z)
                slope *= z
                p = slope


class SearchFailed(ArithmeticError):
    """No step along the direction meets the conditions."""


def minimized(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tol: float, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS: ends after ``steps``, on a small gradient, or when 20 values in a row lie within ``tol`` of the first."""
    value, grad = f(x)
    first, past, pairs, failed = value, [np.inf], [], False
    for step in range(steps):
        while True:
            try:
                direction = -_inverse_hessian(pairs, grad)
                t, value_at, grad_at = _strong_wolfe(f, x, value, grad, direction, 1.0 / np.linalg.norm(direction) if step == 0 else 1.0)
                break
            except SearchFailed:  # once more without memory, then the point is as good as it gets
                if failed:
                    return x
                failed, pairs = True, []
        failed, moved = False, t * direction
        pairs = [(moved, grad_at - grad), *pairs][:memory]
        x, value, grad = x + moved, value_at, grad_at
        past = [*past, value][-20:]
        if abs(value - max(past)) <= tol * first or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            return x
    return x


def _inverse_hessian(pairs: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    out, shares = grad.copy(), []
    for s, y in pairs:
        shares.append((s @ out) / (s @ y))
        out -= shares[-1] * y
    if pairs:
        s, y = pairs[0]
        if not s @ y >= 0:
            raise SearchFailed
        out *= (s @ y) / (y @ y)
    for (s, y), share in reversed(list(zip(pairs, shares))):
        out += (share - (y @ out) / (s @ y)) * s
    return out


def _strong_wolfe(f, x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, t: float) -> tuple[float, float, np.ndarray]:
    """A step that lowers the value enough and flattens the slope; its value and gradient come with it."""
    slope = float(grad @ direction)
    if not slope <= 0:
        raise SearchFailed

    def at(t: float):
        value, grad = f(x + t * direction)
        return t, float(grad @ direction), value, grad

    accepted = lambda c: (c[0], c[2], c[3])
    high = lambda c: c[2] > value + 1e-4 * c[0] * slope
    flat = lambda c: abs(c[1]) <= 0.9 * abs(slope)

    def zoom(low, end):
        for _ in range(10):
            c = at(_between(*sorted((low, end), key=lambda b: b[0])))
            if high(c) or c[2] >= low[2]:
                end = c
                continue
            if flat(c):
                return accepted(c)
            if c[1] * (end[0] - low[0]) >= 0:
                end = low
            low = c
        raise SearchFailed

    low = (0.0, slope, value, grad)
    for i in range(10):
        c = at(t)
        if not np.isfinite(c[2]):
            t /= 2.0
            continue
        if high(c) or (c[2] >= low[2] and i > 0):
            return zoom(low, c)
        if flat(c):
            return accepted(c)
        if c[1] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed


def _between(left, right) -> float:
    """The lowest point of the cubic through both ends, kept off the outer tenths."""
    (l, dl, fl, _), (r, dr, fr, _) = left, right
    d = dl + dr - 3 * (fl - fr) / (l - r)
    root = np.sqrt(max(d * d - dl * dr, 0.0))
    best = r - (r - l) * (dr + root - d) / (dr - dl + 2 * root)
    return float(np.clip(best, l + 0.1 * (r - l), l + 0.9 * (r - l)))
