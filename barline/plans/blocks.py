"""Ordered computation per key without putting a whole key into one task.

A plain ``Window.partitionBy(symbol)`` sends every row of a symbol to one task. Here a series is cut into
blocks, and three plans cover everything the package needs:

``number_rows``  exact position of each row in its series, from sampled ranges of the order and their measured rows;
``in_blocks``    windows of bounded reach: each block also receives the few rows before and after it;
``running``      unbounded running aggregates: running value inside the block, combined with the carry of
                 the earlier blocks, which comes from one summary row per block.

No step holds more than one block of rows per group; the per-key windows only see one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.session import written

BLOCK = 4096
#: Rows of a range, and the most ranges; a range is sorted on disk where it does not fit in memory.
RANGE_ROWS, MOST_RANGES = 1 << 17, 20_000


def _names(df: DataFrame, *extra: str) -> list[str]:
    return [c for c in df.columns if c not in extra]


def ranged(df: DataFrame, by: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """The rows written in ranges of ``by``, in order; ``_at`` rises along the order and holds the number of the range above its 33rd bit.

    The borders of the ranges come from a sample that Spark draws from the rows themselves, more of it where more rows are, and the number of ranges
    from the measured rows. A key with a third of all rows has a third of the ranges, and one with few rows shares a range with others.
    """
    df = written(df, "to-range")
    parts = max(1, min(MOST_RANGES, -(-df.count() // rows)))
    return written(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranged")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos", rows: int = RANGE_ROWS) -> DataFrame:
    """Add the 0-based position of each row in its series.

    Rows lie in ranges of (keys, order); a row's position is its place in its range, less that of the first row of its key there, plus the rows of
    the key in earlier ranges. The carry has one row for each key and range that meet.
    """
    keys = list(keys)
    placed = ranged(df, [*keys, *order], rows).withColumn("_rng", F.shiftrightunsigned("_at", 33))
    met = placed.groupBy(*keys, "_rng").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    carry = met.select(*keys, "_rng", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return placed.join(carry, [*keys, "_rng"]).select(*df.columns, (F.col("_at") + F.col("_off")).cast("long").alias(pos))


def in_blocks(
    df: DataFrame,
    fn: Callable[[DataFrame, "Window"], DataFrame],
    back: int = 0,
    fwd: int = 0,
    keys: Sequence[str] = ("symbol",),
    pos: str = "pos",
    block: int = BLOCK,
) -> DataFrame:
    """Run window expressions that look at most ``back`` rows back and ``fwd`` rows ahead.

    ``fn(rows, w)`` gets the rows with their neighbours and the ordered window of one block; it may chain
    several windows as long as their reaches add up to no more than ``back`` and ``fwd``.
    """
    keys = list(keys)
    first = F.floor(F.greatest(F.col(pos) - F.lit(fwd), F.lit(0)) / F.lit(block))
    last = F.floor((F.col(pos) + F.lit(back)) / F.lit(block))
    spread = df.withColumn("_blk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    out = fn(spread, w)
    return out.where(F.col("_blk") == F.floor(F.col(pos) / F.lit(block))).drop("_blk")


_AGG = {
    "sum": lambda c, p: F.sum(c),
    "count": lambda c, p: F.count(c),
    "product": lambda c, p: F.product(c),
    "max": lambda c, p: F.max(c),
    "min": lambda c, p: F.min(c),
    "last": lambda c, p: F.max_by(c, F.when(c.isNotNull(), F.col(p))),
    "next": lambda c, p: F.min_by(c, F.when(c.isNotNull(), F.col(p))),
}
_WIN = {
    "sum": F.sum,
    "count": F.count,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "next": lambda c: F.first(c, ignorenulls=True),
}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "product":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry * local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    keys: Sequence[str] = ("symbol",),
    pos: str = "pos",
    block: int = BLOCK,
    bucket: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates from the start of the series, e.g. ``{"equity": ("product", 1 + r)}``.

    Kinds: sum, count, product, max, min, last (latest non-null so far) and next (first non-null from here
    on, i.e. it runs backwards). ``inclusive=False`` leaves the current row out. The block is ``pos // block``
    or any ``bucket`` that does not decrease along ``pos``.
    """
    keys = list(keys)
    blk = bucket if bucket is not None else F.floor(F.col(pos) / F.lit(block))
    rows = df.withColumn("_blk", blk)
    inputs = {name: f"_in_{name}" for name in specs}
    rows = rows.select("*", *[specs[n][1].alias(inputs[n]) for n in specs])
    edge = 0 if inclusive else 1
    order = Window.partitionBy(*keys, "_blk").orderBy(pos)
    past = order.rowsBetween(Window.unboundedPreceding, -edge)
    ahead = order.rowsBetween(edge, Window.unboundedFollowing)
    totals = rows.groupBy(*keys, "_blk").agg(
        *[_AGG[specs[n][0]](F.col(inputs[n]), pos).alias(f"_t_{n}") for n in specs]
    )
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    later = by_block.rowsBetween(1, Window.unboundedFollowing)
    carries = totals.select(
        *keys,
        "_blk",
        *[
            _WIN[k if k != "count" else "sum"](F.col(f"_t_{n}")).over(later if k == "next" else earlier).alias(f"_c_{n}")
            for n, (k, _) in specs.items()
        ],
    )
    local = rows.select(
        "*",
        *[
            _WIN[k](F.col(inputs[n])).over(ahead if k == "next" else past).alias(f"_l_{n}")
            for n, (k, _) in specs.items()
        ],
    )
    joined = local.join(carries, [*keys, "_blk"])
    return joined.select(
        *df.columns,
        *[_combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in specs.items()],
    )


def islands(
    df: DataFrame,
    flag: Column,
    keys: Sequence[str] = ("symbol",),
    pos: str = "pos",
    name: str = "run_id",
    block: int = BLOCK,
) -> DataFrame:
    """Number the runs of equal ``flag``: a new run starts wherever the flag differs from the row before."""

    def changes(rows: DataFrame, w) -> DataFrame:
        before = F.lag("_flag").over(w)
        return rows.withColumn("_chg", F.when(before.eqNullSafe(F.col("_flag")), 0).otherwise(1))

    marked = in_blocks(df.withColumn("_flag", flag), changes, back=1, keys=keys, pos=pos, block=block)
    out = running(marked, {name: ("sum", F.col("_chg"))}, keys=keys, pos=pos, block=block)
    return out.drop("_flag", "_chg")
