"""Rolling values in arrays: the rows of :func:`barline.plans.blocks.in_blocks`, worked out many blocks at a time instead of a window frame per row.

Spark deals the blocks out and sorts them; a task gets them batch by batch. A :class:`Series` is a column of such a batch with its nulls. Values
past the first or last row of a block are null, so blocks that lie one after the other in a batch never mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.plans.blocks import BLOCK
from barline.plans.ranks import groups, whole_groups


class Series:
    """Doubles with nulls; ``at`` and ``left`` count the rows of the block before and after a row."""

    def __init__(self, v: np.ndarray, ok: np.ndarray, at: np.ndarray, left: np.ndarray):
        self.v, self.ok, self.at, self.left = v, ok, at, left

    def like(self, v: np.ndarray, ok: np.ndarray | None = None) -> "Series":
        return Series(v, self.ok if ok is None else ok, self.at, self.left)

    def _with(self, other, fn) -> "Series":
        return self.like(fn(self.v, other.v), self.ok & other.ok) if isinstance(other, Series) else self.like(fn(self.v, other))

    def __add__(self, other) -> "Series":
        return self._with(other, np.add)

    def __sub__(self, other) -> "Series":
        return self._with(other, np.subtract)

    def __mul__(self, other) -> "Series":
        return self._with(other, np.multiply)

    def __neg__(self) -> "Series":
        return self.like(-self.v)

    def or_else(self, value: float) -> "Series":
        return self.like(np.where(self.ok, self.v, value), np.ones(len(self.ok), bool))

    def ratio(self, other: "Series") -> "Series":
        """Floating-point division, like :func:`barline.functions.scalar.ratio`."""
        return self._with(other, lambda a, b: np.where(b == 0, a * np.inf, a / b))

    def safe_div(self, other: "Series") -> "Series":
        return self.like(self.v / other.v, self.ok & other.ok & ~(np.abs(other.v) <= 1e-12))

    def lag(self, n: int = 1) -> "Series":
        v, ok = _behind(self.v, n, 0.0)[0], _behind(self.ok, n, False)[0]
        return self.like(v, ok & (self.at >= n))

    def lead(self, n: int = 1) -> "Series":
        v, ok = np.concatenate([self.v, np.zeros(n)])[n:], np.concatenate([self.ok, np.zeros(n, bool)])[n:]
        return self.like(v, ok & (self.left >= n))

    def full(self, n: int) -> np.ndarray:
        """Whether the last ``n`` rows are in the block and not null."""
        row = np.arange(len(self.v))
        return row - np.maximum.accumulate(np.maximum(row - self.at - 1, np.where(self.ok, -1, row))) >= n

    def _frames(self, n: int) -> list[np.ndarray]:
        """The values n - 1, .., 0 rows back; only for use where the frame is full."""
        return _behind(self.v, n - 1, 0.0)

    def sum(self, n: int) -> "Series":
        return self.like(sum(self._frames(n)), self.full(n))

    def mean(self, n: int) -> "Series":
        return self.like(self.sum(n).v / n, self.full(n))

    def min(self, n: int) -> "Series":
        return self.like(_fold(np.fmin, self._frames(n)), self.full(n))

    def max(self, n: int) -> "Series":
        return self.like(_fold(np.maximum, self._frames(n)), self.full(n))

    def std(self, n: int, ddof: int = 1) -> "Series":
        return self.like(np.sqrt(self.cov(self, n, ddof).v), self.full(n))

    def cov(self, other: "Series", n: int, ddof: int = 1) -> "Series":
        """Covariance over the frame; deviations are taken from its oldest value first, so that a constant frame gives zero."""
        both = self.like(self.v, self.ok & other.ok)
        x, y = self._frames(n), other._frames(n)
        mx, my = sum(a - x[0] for a in x) / n, sum(b - y[0] for b in y) / n
        return self.like(sum((a - x[0] - mx) * (b - y[0] - my) for a, b in zip(x, y)) / (n - ddof), both.full(n))

    def moves(self, n: int) -> np.ndarray:
        low, high = self.min(n).v, self.max(n).v
        return (low < high) | (np.isnan(high) & ~np.isnan(low))

    def corr(self, other: "Series", n: int) -> "Series":
        """Null where either side does not move inside the frame."""
        spread = self.std(n, 0).v * other.std(n, 0).v
        cov = self.cov(other, n, 0)
        return self.like(cov.v / spread, cov.ok & self.moves(n) & other.moves(n) & (spread != 0))

    def _present(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The values n - 1, .., 0 rows back and whether they are in the block and not null."""
        ok = _behind(self.ok, n - 1, False)
        return [(v, o & (self.at >= back)) for v, o, back in zip(self._frames(n), ok, range(n - 1, -1, -1))]

    def held(self, n: int) -> np.ndarray:
        return sum(o.astype(np.int64) for _, o in self._present(n))

    def some_mean(self, n: int) -> "Series":
        """Mean of the values there are in the frame."""
        held = self.held(n)
        return self.like(sum(np.where(o, v, 0.0) for v, o in self._present(n)) / np.maximum(held, 1), held > 0)

    def some_std(self, n: int) -> "Series":
        """Population standard deviation of the values there are in the frame."""
        mean = self.some_mean(n)
        squares = sum(np.where(o, (v - mean.v) ** 2, 0.0) for v, o in self._present(n))
        return self.like(np.sqrt(squares / np.maximum(self.held(n), 1)), mean.ok)

    def some_max(self, n: int) -> "Series":
        return self.like(_fold(np.maximum, [np.where(o, v, -np.inf) for v, o in self._present(n)]), self.held(n) > 0)

    def some_min(self, n: int) -> "Series":
        return self.like(_fold(np.fmin, [np.where(o, v, np.nan) for v, o in self._present(n)]), self.held(n) > 0)

    def above(self, other) -> np.ndarray:
        """Whether both are there and this one is larger; a NaN is larger than any number."""
        a, b, ok = (self.v, other.v, self.ok & other.ok) if isinstance(other, Series) else (self.v, other, self.ok)
        return ok & ((a > b) | (np.isnan(a) & ~np.isnan(b)))

    def gap(self, reference: "Series", both: bool = False) -> "Series":
        """This over the reference less one; 0 where the reference (or, with ``both``, one of them) is not positive."""
        there = reference.above(0.0) & (self.above(0.0) if both else True)
        return self.like(np.where(there, self.v / reference.v - 1, 0.0), self.ok | ~there)

    def decay(self, n: int) -> "Series":
        total = n * (n + 1) / 2
        return self.like(sum(v * ((k + 1) / total) for k, v in reversed(list(enumerate(self._frames(n))))), self.full(n))

    def percentile(self, n: int, min_periods: int) -> "Series":
        """Tie-averaged rank of the value among the non-null values of the frame, as a share of them; NaN is the largest."""
        codes = np.full(len(self.v), np.iinfo(np.int64).max)  # a null is neither below nor equal to any value
        codes[self.ok] = np.unique(self.v[self.ok], return_inverse=True)[1]
        less, same, held = (np.zeros(len(codes), np.int64) for _ in range(3))
        for back, (code, ok) in enumerate(reversed(list(zip(_behind(codes, n - 1, 0), _behind(self.ok, n - 1, False))))):
            inside = self.at >= back
            less += (code < codes) & inside
            same += (code == codes) & inside
            held += ok & inside
        return self.like((less + (same + 1) / 2) / np.maximum(held, 1), self.ok & (held >= min_periods))

    def abs(self) -> "Series":
        return self.like(np.abs(self.v))

    def where(self, keep: np.ndarray) -> "Series":
        return self.like(self.v, self.ok & keep)

    def round(self, digits: int) -> "Series":
        """Half away from zero; values too large to have such digits stay as they are."""
        scaled = self.v * 10.0**digits
        near = np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**digits
        return self.like(np.where(np.abs(scaled) < 2.0**52, near, self.v))


def _behind(x: np.ndarray, n: int, fill) -> list[np.ndarray]:
    """The array n, .., 0 places back."""
    padded = np.concatenate([np.full(n, fill, x.dtype), x])
    return [padded[i : i + len(x)] for i in range(n + 1)]


def _fold(fn, frames: list[np.ndarray]) -> np.ndarray:
    out = frames[0]
    for frame in frames[1:]:
        out = fn(out, frame)
    return out


def in_arrays(
    df: DataFrame,
    fn: Callable[[dict[str, Series]], dict[str, Series]],
    inputs: Sequence[str],
    names: Sequence[str],
    back: int = 0,
    fwd: int = 0,
    keys: Sequence[str] = ("symbol",),
    pos: str = "pos",
    block: int = BLOCK,
) -> DataFrame:
    """The rows with the columns ``names`` (doubles) that ``fn`` makes of the columns ``inputs``; it looks at most ``back`` rows back and ``fwd`` ahead."""
    keys, columns = [*keys, "_blk"], df.columns
    first = F.floor(F.greatest(F.col(pos) - F.lit(fwd), F.lit(0)) / F.lit(block))
    last = F.floor((F.col(pos) + F.lit(back)) / F.lit(block))
    spread = df.withColumn("_blk", F.explode(F.sequence(first, last)))
    spread = spread.withColumn("_own", F.col("_blk") == F.floor(F.col(pos) / F.lit(block)))
    held = {c: c if kind == "double" else f"_in_{c}" for c, kind in df.select(*inputs).dtypes}
    spread = spread.withColumns({n: F.col(c).cast("double") for c, n in held.items() if n != c})
    # As many tasks as the session says: left to Spark, shuffles are joined into one more than there are cores, and that one takes a second round.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, *keys).sortWithinPartitions(*keys, pos)

    def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, row = groups(table, keys), np.arange(table.num_rows)
        size = np.bincount(group)
        begin = (np.cumsum(size) - size)[group]
        at = row - begin
        left = size[group] - 1 - at
        series = {}
        for c in inputs:
            values = table.column(held[c]).combine_chunks()
            ok = values.is_valid().to_numpy(zero_copy_only=False)
            series[c] = Series(np.where(ok, values.to_numpy(zero_copy_only=False), 0.0), ok, at, left)
        with np.errstate(all="ignore"):
            made = fn(series)
        out = [*(table.column(c) for c in columns), *(pa.array(made[n].v, pa.float64(), mask=~made[n].ok) for n in names)]
        kept = pa.Table.from_arrays(out, [*columns, *names]).filter(table.column("_own"))
        yield from kept.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from worked(table)

    schema = df.select(*columns, *[F.lit(None).cast("double").alias(n) for n in names]).schema
    return dealt.mapInArrow(run, schema)
