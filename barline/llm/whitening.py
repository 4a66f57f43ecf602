"""Whitening of embeddings: centred covariance, its leading components, and the projection on them.

Entries become whole numbers, so that the counts, the sums and the centred cross products that tasks add up are exact: no order of tasks and no
retry changes a digit. Three passes over the vectors do the work on Spark: sums, then products of the vectors less the rounded mean, then the
projection. Between them the driver holds a matrix of dimension by dimension, whatever the number of rows: Householder reflections make it
tridiagonal, bisection on Sturm counts finds the leading eigenvalues, and inverse iteration, with vectors of close eigenvalues made orthogonal to
each other, the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import keep

SCALE, SHIFT = 64, 1_000_000
#: The driver holds matrices of this many rows and columns at most (128 MB each).
MAX_DIMS = 4096
#: Partial matrices are added up in so many places before the last sum.
SALTS = 32
#: Eigenvalues below this share of the largest are zero up to rounding and have no component.
RANK_EPS = 1e-12
LIMB = 40
PARTIAL = "salt int, r int, high array<long>, low array<long>"


def entries(vector: str) -> Column:
    """floor(64 * c) + 1000000 of each entry; null where the vector is null, empty, or holds a null or non-finite entry."""
    numbers = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    usable = (F.size(vector) > 0) & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return F.when(usable, numbers)


def matrix_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def exact_products(v: np.ndarray) -> np.ndarray:
    """v^T v of whole numbers as Python integers: in floating point while every sum stays below 2^53, else integer by integer."""
    largest = int(np.abs(v).max(initial=0))
    if largest * largest >= 1 << 53:
        own = v.astype(object)
        return own.T @ own
    rows = max(1, (1 << 53) // max(1, largest * largest) - 1)
    total = np.zeros((v.shape[1], v.shape[1]), dtype=object)
    for i in range(0, len(v), rows):
        part = v[i : i + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def added_up(rows: DataFrame, dims: int, block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``block(vectors)``, a small matrix of Python integers, over all vectors, exactly. Every task sends its own sum once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = block(matrix_of(batch, dims))
                total = own if total is None else total + own
        if total is not None:
            yield limbs(total, TaskContext.get().partitionId() % SALTS)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                high, low = np.array(r["high"], np.int64), np.array(r["low"], np.int64)
                own = sums.setdefault((r["salt"], r["r"]), [np.zeros_like(high), np.zeros_like(low)])
                own[0] += high + ((own[1] + low) >> LIMB)
                own[1] = (own[1] + low) & ((1 << LIMB) - 1)
        if sums:
            yield pa.RecordBatch.from_pydict({"salt": [0] * len(sums), "r": [r for _, r in sums], "high": [h.tolist() for h, _ in sums.values()], "low": [x.tolist() for _, x in sums.values()]}, schema=SCHEMA)

    SCHEMA = pa.schema([("salt", pa.int32()), ("r", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])

    def limbs(total: np.ndarray, salt: int) -> pa.RecordBatch:
        flat = [[int(x) for x in row] for row in total]
        return pa.RecordBatch.from_pydict(
            {"salt": [salt] * len(flat), "r": list(range(len(flat))), "high": [[x >> LIMB for x in row] for row in flat], "low": [[x & ((1 << LIMB) - 1) for x in row] for row in flat]}, schema=SCHEMA
        )

    parts = rows.select("x").mapInArrow(partial, PARTIAL)
    parts = parts.repartition("salt", "r").mapInArrow(combine, PARTIAL).repartition("r").mapInArrow(combine, PARTIAL)
    found = {r.r: [(h << LIMB) + x for h, x in zip(r.high, r.low)] for r in parts.collect()}  # dims rows of dims numbers
    return np.array([found[i] for i in range(len(found))], dtype=object)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflections (row i: unit vector of step i, or zeros) of the symmetric matrix."""
    a = matrix.copy()
    size = len(a)
    mirrors = np.zeros((max(0, size - 2), size))
    for i in range(size - 2):
        x = a[i + 1 :, i].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).any():
            continue
        x /= scale
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        u = np.zeros(size)
        u[i + 1 :] = x / np.linalg.norm(x)
        p = a @ u
        w = 2 * (p - (u @ p) * u)
        a -= np.outer(u, w) + np.outer(w, u)
        mirrors[i] = u
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each number of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    floor = np.maximum(tiny, np.finfo(float).eps * np.concatenate([[0.0], np.abs(e)]).max() * np.finfo(float).eps)
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < floor, -floor, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of the tridiagonal matrix, falling, by bisection for all of them at once."""
    size = len(d)
    edge = np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])
    least, most = (d - edge).min(), (d + edge).max()
    room = max(abs(least), abs(most)) * 1e-12 + np.finfo(float).tiny
    low, high = np.full(k, least - room), np.full(k, most + room)
    wanted = size - 1 - np.arange(k)  # number of eigenvalues below the wanted one
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        over = below(d, e, middle) > wanted
        low, high = np.where(over | (middle <= low), low, middle), np.where(over, middle, high)


def solved(d: np.ndarray, e: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve (T - at_j) x_j = right_j for all columns j at once, with row exchanges."""
    size, k = right.shape
    eps = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    first, second, third = np.zeros((size, k)), np.zeros((size, k)), np.zeros((size, k))
    y = right.copy()
    a, b, c = d[0] - at, np.full(k, e[0] if size > 1 else 0.0), np.zeros(k)  # the row that is being reduced
    for i in range(size - 1):
        na, nb, nc = np.full(k, e[i]), d[i + 1] - at, np.full(k, e[i + 1] if i + 2 < size else 0.0)
        swap = np.abs(na) > np.abs(a)
        pa_, pb, pc = np.where(swap, na, a), np.where(swap, nb, b), np.where(swap, nc, c)
        oa, ob, oc = np.where(swap, a, na), np.where(swap, b, nb), np.where(swap, c, nc)
        pa_ = np.where(np.abs(pa_) < eps, eps, pa_)
        top, rest = np.where(swap, y[i + 1], y[i]), np.where(swap, y[i], y[i + 1])
        factor = oa / pa_
        first[i], second[i], third[i], y[i] = pa_, pb, pc, top
        a, b, c, y[i + 1] = ob - factor * pb, oc - factor * pc, np.zeros(k), rest - factor * top
    first[size - 1] = np.where(np.abs(a) < eps, eps, a)
    for i in range(size - 1, -1, -1):
        if i + 1 < size:
            y[i] -= second[i] * y[i + 1]
        if i + 2 < size:
            y[i] -= third[i] * y[i + 2]
        y[i] /= first[i]
    return y


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those whose eigenvalues lie close together are made orthogonal in every round."""
    size, k = len(d), len(values)
    norm = max(np.abs(values).max(initial=0.0), np.abs(d).max(), np.finfo(float).tiny)
    apart = values.copy()
    for j in range(1, k):  # equal eigenvalues get shifts of their own
        apart[j] = min(apart[j], apart[j - 1] - 4 * np.finfo(float).eps * norm)
    near = np.concatenate([[False], (values[:-1] - values[1:]) < 1e-3 * norm])
    y = np.random.default_rng(0).uniform(0.5, 1.0, (size, k)) * np.where(np.random.default_rng(1).random((size, k)) < 0.5, -1, 1)
    for _ in range(rounds):
        y = solved(d, e, apart, y / np.abs(y).max(axis=0))
        y /= np.linalg.norm(y, axis=0)
        for j in range(k):
            start = j
            while near[start]:
                start -= 1
            if start < j:
                for _twice in range(2):
                    y[:, j] -= y[:, start:j] @ (y[:, start:j].T @ y[:, j])
                    y[:, j] /= np.linalg.norm(y[:, j])
    return y


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k leading eigenvalues, falling, and unit eigenvectors (columns), the entry of largest size positive; no component for eigenvalue zero."""
    d, e, mirrors = tridiagonal(covariance)
    values = leading_values(d, e, min(k, len(d)))
    values = values[values > RANK_EPS * max(values.max(initial=0.0), 0.0)]
    values = values[values > 0]
    if not len(values):
        return values, np.zeros((len(d), 0))
    vectors = leading_vectors(d, e, values)
    for u in mirrors[::-1]:
        vectors -= 2 * np.outer(u, u @ vectors)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * sign


def deviations(v: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * v + rest)^2 of each row; none where it does not fit in a long."""
    bound = n * int(np.abs(v).max(initial=0)) + max(map(abs, rest))
    if v.shape[1] * bound * bound < 1 << 63:
        own = v * n + np.array(rest, np.int64)
        return (own * own).sum(axis=1).tolist()
    own = v.astype(object) * n + np.array(rest, dtype=object)
    return [int(x) if x < 1 << 63 else None for x in (own * own).sum(axis=1)]


def whiten(vectors: DataFrame, k: int = 32, vector: str = "embedding") -> DataFrame:
    """Return vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every vector and each of its k leading components.

    Rows whose vector is null or empty, or holds a null or non-finite entry, are dropped. Where vectors have several lengths, those of the most
    frequent one (of equally frequent, the longest) take part. Every remaining row counts, also one that repeats another or has no vec_id. There are
    as many components as dimensions at most, and none for an eigenvalue that is zero up to rounding: vectors that are all alike, or just one, give
    no rows. A deviation that does not fit in a long is null. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries(vector).alias("x")).where("x IS NOT NULL")
    rows = keep(rows, "whitening-vectors", spark)
    shape = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    out = "vec_id long, deviation long, w array<double>"
    if shape is None:
        return spark.createDataFrame([], out).selectExpr("vec_id", "0 AS component", "0L AS n", "deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    dims, n = shape.dims, shape.n
    if dims > MAX_DIMS:
        raise ValueError(f"vectors have {dims} dimensions; the matrices on the driver are bounded by {MAX_DIMS}")
    rows = rows.where(F.size("x") == dims)
    sums = added_up(rows, dims, lambda x: x.sum(axis=0, keepdims=True).astype(object) if int(np.abs(x).max(initial=0)) < 1 << 40 else x.astype(object).sum(axis=0, keepdims=True))[0]
    middle = [(2 * int(s) + n) // (2 * n) for s in sums]  # rounded means
    rest = [n * m - int(s) for m, s in zip(middle, sums)]  # n times what is left of the mean
    centre = np.array(middle, np.int64)
    products = added_up(rows, dims, lambda x: exact_products(x - centre))
    # n^2 times the covariance is a whole number, so that one division gives each entry.
    covariance = np.array([[float(Fraction(n * int(products[i][j]) - rest[i] * rest[j], n * n)) for j in range(dims)] for i in range(dims)])
    values, axes = components(covariance, k)
    weights = axes / np.sqrt(values)
    offset = np.array([r / n for r in rest]) @ weights

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix_of(batch, dims) - centre
                w = v.astype(np.float64) @ weights + offset
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32) if w.size else np.zeros(len(w) + 1, np.int32), w.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(v, n, rest), pa.int64()), lists], ["vec_id", "deviation", "w"])

    projected = keep(rows.mapInArrow(project, out), "whitened", spark)
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)]) if len(values) else F.array(F.lit(0.0))
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(projected, len(values), n)).alias("identity_error"),
    )


def identity_error(projected: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors (centred at their own mean) minus the identity."""
    if not k:
        return 0.0

    def total(block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``block(vectors)``, at most k * k numbers, over all vectors."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [block(b.column(0).flatten().to_numpy().reshape(-1, k)) for b in batches if b.num_rows]
            if own:
                values = sum(own).ravel()
                yield pa.RecordBatch.from_pydict({"i": list(range(len(values))), "v": values.tolist()})

        found = projected.select("w").mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(found)])

    mean = total(lambda w: w.sum(axis=0)) / n
    covariance = total(lambda w: (w - mean).T @ (w - mean)).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())
