"""Exact ranks and quantiles inside groups that may be too big for one task.

Rows are reduced to distinct (key, value) pairs with a count and dealt out in ranges of (key, value) whose number follows the measured rows, so that
a large group has as many ranges as it needs and small groups share one. Ranks inside a range plus the rows of the key in lower ranges are exact
ranks, whatever the borders. Ranks of several columns of a table are found together: every key is ranked wide, in one shuffle of the rows, but for
the keys whose own rows are too many for a task, which go by ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barline.plans.blocks import RANGE_ROWS, ranged
from barline.session import written

#: Rows of one key that a task ranks in a window; keys with more go by ranges.
KEY_ROWS = 1 << 20


def value_positions(df: DataFrame, keys: Sequence[str], x: str, rows: int = RANGE_ROWS) -> DataFrame:
    """One row per (keys, value): ``cnt`` copies, ``below`` rows strictly less, ``total`` rows of the key."""
    keys = list(keys)
    distinct = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("cnt"))
    placed = ranged(distinct, [*keys, x], rows).withColumn("_rng", F.shiftrightunsigned("_at", 33))
    sizes = placed.groupBy(*keys, "_rng").agg(F.sum("cnt").alias("_size"))
    per_key = Window.partitionBy(*keys)
    lower = per_key.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_rng", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_off"), F.sum("_size").over(per_key).alias("total"))
    inside = Window.partitionBy(*keys, "_rng").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("_lower", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return counted.join(offsets, [*keys, "_rng"]).select(*keys, x, "cnt", (F.col("_off") + F.col("_lower")).alias("below"), "total")


def average_rank(df: DataFrame, keys: Sequence[str], x: str, name: str, pct: bool = True, rows: int = RANGE_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Tie-averaged rank of ``x`` within ``keys`` (as a share of the group when ``pct``); null stays null."""
    return average_ranks(df, keys, {name: x}, pct, rows, key_rows)


def average_ranks(
    df: DataFrame, keys: Sequence[str], names: dict[str, str | tuple[str, str]], pct: bool = True, rows: int = RANGE_ROWS, key_rows: int = KEY_ROWS, cheap: bool = False, sizes: dict[str, str] | None = None
) -> DataFrame:
    """Like :func:`average_rank` for several columns of one table: ``names`` maps result column to input column, or to a pair
    of columns: the first is then ranked over the rows on which the second is not null either.

    The table is read more than once, so it is written out first unless the caller knows that it is ``cheap`` to read again (a filter or projection
    of a table already written). ``sizes`` maps further result columns to input columns whose non-null values in the group are counted.
    """
    keys, sizes = list(keys), sizes or {}
    df = df if cheap else written(df, "to-rank")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else df.agg(F.count("*").alias("_n"))
    large = counts.where(F.col("_n") > key_rows).select(*keys)  # few: each stands for more than key_rows rows
    some = not large.isEmpty()
    if not some:
        return _wide_ranks(df, keys, names, pct, sizes)
    split = df.join(large, keys, "left_semi") if keys else df
    out, counted = split, {}
    for name, x in names.items():
        if isinstance(x, tuple):
            own, (x, other) = f"_own_{name}", x
            split, out = (t.withColumn(own, F.when(F.col(other).isNotNull(), F.col(x))) for t in (split, out))
            x = own
        rank = F.col("below") + (F.col("cnt") + 1) / 2
        positions = value_positions(split, keys, x, rows)
        out = out.join(positions.select(*keys, x, (rank / F.col("total") if pct else rank).alias(name)), [*keys, x], "left")
    for name, x in sizes.items():
        counted[name] = split.groupBy(*keys).agg(F.count(x).alias(name)) if keys else split.agg(F.count(x).alias(name))
        out = out.join(counted[name], keys) if keys else out.withColumn(name, counted[name].scalar())
    out = out.select(*df.columns, *names, *sizes)
    return out.unionByName(_wide_ranks(df.join(large, keys, "left_anti"), keys, names, pct, sizes)) if keys else out


def _wide_ranks(df: DataFrame, keys: list[str], names: dict[str, str | tuple[str, str]], pct: bool, sizes: dict[str, str]) -> DataFrame:
    """All columns in one shuffle on the keys. A task holds the rows of one key at a time, and all of its columns are ranked in arrays."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys) if keys else df.repartition(1)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from _ranked(table, keys, names, pct, sizes)

    schema = df.select(*columns, *[F.lit(None).cast("double").alias(n) for n in names], *[F.lit(None).cast("long").alias(n) for n in sizes]).schema
    return dealt.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``keys`` as tables that hold all rows of their keys."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        edge = 0
        group = groups(pa.Table.from_batches([batch]), keys)
        if group[0] != group[-1]:  # every key but the last one is complete
            table = pa.Table.from_batches(waiting)
            edge = table.num_rows - int((group == group[-1]).sum())
        elif len(waiting) > 1 and groups(pa.Table.from_batches([waiting[-2].slice(waiting[-2].num_rows - 1), batch.slice(0, 1)]), keys)[-1]:
            table = pa.Table.from_batches(waiting)  # a batch of one key begins a new one
            edge = table.num_rows - batch.num_rows
        if edge:
            yield table.slice(0, edge)
            waiting = table.slice(edge).to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row that rises where a key begins; rows of one key lie together."""
    changed = np.zeros(table.num_rows, bool)
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def _ranked(table: pa.Table, keys: list[str], names: dict[str, str | tuple[str, str]], pct: bool, sizes: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The rows with tie-averaged ranks within their keys; all rows of a key are there."""
    group = groups(table, keys)
    out = list(table.columns)
    valid = lambda x: table.column(x).is_valid().combine_chunks().to_numpy(zero_copy_only=False)
    known = {x: valid(x[0]) & valid(x[1]) if isinstance(x, tuple) else valid(x) for x in {*names.values(), *sizes.values()}}
    count = {x: np.bincount(group, weights=ok, minlength=group[-1] + 1 if len(group) else 0) for x, ok in known.items()}
    for x in names.values():
        rows = np.flatnonzero(known[x])
        value = table.column(x[0] if isinstance(x, tuple) else x).combine_chunks().to_numpy(zero_copy_only=False)[rows]
        order = np.lexsort((value, group[rows]))
        own, value = group[rows][order], value[order]
        same = (value[1:] == value[:-1]) | ((value[1:] != value[1:]) & (value[:-1] != value[:-1]))  # a NaN ties with a NaN
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | ~same])) if len(own) else np.zeros(0, np.int64)
        ties = np.diff(np.concatenate([first, [len(own)]]))
        begin = np.cumsum(count[x]) - count[x]
        rank = np.empty(len(own))
        rank[order] = np.repeat(first + (ties + 1) / 2, ties) - begin[own]
        filled = np.zeros(len(group))
        filled[rows] = rank / count[x][group[rows]] if pct else rank
        out.append(pa.array(filled, mask=~known[x]))
    out += [pa.array(count[x][group].astype(np.int64)) for x in sizes.values()]
    yield from pa.Table.from_arrays(out, [*table.column_names, *names, *sizes]).to_batches(max_chunksize=10_000)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    qs: dict[str, float],
    rows: int = RANGE_ROWS,
    order_stat: bool = False,
) -> DataFrame:
    """Exact quantiles per key: linear interpolation, or the order statistic at ``floor(q * (n - 1))``; one plan for groups of any size."""
    keys = list(keys)
    positions = value_positions(df.select(*keys, x), keys, x, rows)
    last = F.col("below") + F.col("cnt") - 1
    aggs = []
    for name, q in qs.items():
        spot = F.lit(q) * (F.col("total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        at_low = F.max(F.when((F.col("below") <= low) & (low <= last), F.col(x)))
        if order_stat:
            aggs.append(at_low.alias(name))
            continue
        at_high = F.max(F.when((F.col("below") <= high) & (high <= last), F.col(x)))
        at, below, above = F.max(spot), F.max(low), F.max(high)
        between = (above - at) * at_low + (at - below) * at_high
        aggs.append(F.when(below == above, at_low).otherwise(between).alias(name))
    grouped = positions.groupBy(*keys) if keys else positions.groupBy()
    return grouped.agg(*aggs, F.max("total").alias("n_values"))


def order_statistics(df: DataFrame, keys: Sequence[str], x: str, qs: dict[str, float], rows: int = RANGE_ROWS, width: float = 1e-3) -> DataFrame:
    """The value at ``floor(q * (n - 1))`` of each key, exact, in two passes without sorting the values; for few large keys of a table that is cheap to read again.

    The first pass finds an approximate quantile on either side of each wanted one; the second counts the values below that bracket and keeps those inside,
    about 2 ``width`` of the key each. Whether the wanted place lies inside is checked by the counts; a key where it does not is sorted as a whole.
    """
    keys, names = list(keys), list(qs)
    values = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"))
    shares = [min(max(qs[n] + side, 0.0), 1.0) for n in names for side in (-width, width)]
    bounds = written(values.groupBy(*keys).agg(F.percentile_approx("_x", shares, round(2 / width) if width else 10_000).alias("_b"), F.count("*").alias("_n")), "bounds")
    held = values.join(bounds, keys)
    low, high = ([F.get("_b", F.lit(2 * i + side)) for i in range(len(names))] for side in (0, 1))
    spots = [F.when((F.col("_x") >= a) & (F.col("_x") <= b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high))]
    lower = held.groupBy(*keys).agg(*[F.count(F.when(F.col("_x") < a, 1)).alias(f"_l{i}") for i, a in enumerate(low)])
    inside = held.select(*keys, "_x", F.explode(F.array_compact(F.array(*spots))).alias("_q")).groupBy(*keys, "_q", "_x").agg(F.count("*").alias("_c"))
    upto = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_x")))
    known = bounds.select(*keys, "_n").join(lower, keys)
    placed = upto.join(known, keys)
    found = []
    for i, (name, q) in enumerate(qs.items()):
        left = F.floor(F.lit(q) * (F.col("_n") - 1)) - F.col(f"_l{i}")  # values of the bracket before the wanted one
        here = (F.col("_q") == i) & (F.col("_upto") - F.col("_c") <= left) & (left < F.col("_upto"))
        found += [F.max(F.when(here, F.col("_x"))).alias(name), F.max(here).alias(f"_ok{i}")]
    out = written(known.select(*keys, F.col("_n").alias("n_values")).join(placed.groupBy(*keys).agg(*found), keys, "left"), "found")
    sure = F.lit(True)
    for i in range(len(names)):
        sure = sure & F.coalesce(F.col(f"_ok{i}"), F.lit(False))
    exact, open_ = out.where(sure).select(*keys, *names, "n_values"), out.where(~sure).select(*keys)
    if open_.isEmpty():
        return exact
    rest = value_positions(df.select(*keys, x).join(open_, keys, "left_semi"), keys, x, rows)
    last, place = F.col("below") + F.col("cnt") - 1, {n: F.floor(F.lit(q) * (F.col("total") - 1)) for n, q in qs.items()}
    slow = rest.groupBy(*keys).agg(*[F.max(F.when((F.col("below") <= p) & (p <= last), F.col(x))).alias(n) for n, p in place.items()], F.max("total").alias("n_values"))
    return exact.unionByName(slow)


def _past_statistics(table: pa.Table, q: float, min_n: int) -> pa.Table:
    """Both order statistics around the quantile of all earlier rows, for each row of a block; the counts of values are kept in a binary indexed tree."""
    at, x, n, lower = (table[c].to_numpy(zero_copy_only=False) for c in ("_pos", "_x", "_n", "_lower"))
    old = table["_pos"].is_null().to_numpy()
    values, code = np.unique(x, return_inverse=True)
    size, skipped = len(values), int(lower[old].max()) if old.any() else 0
    counts = np.zeros(size, np.int64)
    np.add.at(counts, code[old], n[old])
    sums = np.concatenate([[0], np.cumsum(counts)])
    ends = np.arange(1, size + 1)
    tree, held = [0, *(sums[ends] - sums[ends - (ends & -ends)]).tolist()], counts.tolist()
    top = 1 << (size.bit_length() - 1)

    def select(k: int) -> tuple[int, int]:
        i, step = 0, top
        while step:
            j = i + step
            if j <= size and tree[j] <= k:
                i, k = j, k - tree[j]
            step >>= 1
        return i, k

    order = np.flatnonzero(~old)[np.argsort(at[~old], kind="stable")]
    asked, lows, highs = [], [], []
    for p, c in zip(at[order].astype(np.int64).tolist(), code[order].tolist()):
        if p >= min_n:
            spot = q * (p - 1)
            low = math.floor(spot)
            i, left = select(low - skipped)
            j = i if math.ceil(spot) == low or left + 1 < held[i] else select(low + 1 - skipped)[0]
            asked.append(p)
            lows.append(i)
            highs.append(j)
        held[c] += 1
        c += 1
        while c <= size:
            tree[c] += 1
            c += c & -c
    pick = lambda rows: pa.array(values[np.array(rows, np.int64)])
    return pa.table({"_pos": pa.array(asked, pa.int64()), "_lo": pick(lows), "_hi": pick(highs)})


def expanding_quantile(
    df: DataFrame,
    x: str,
    q: float,
    pos: str = "pos",
    min_n: int = 200,
    name: str = "threshold",
    fan: int = 8,
    block: int = 1 << 17,
) -> DataFrame:
    """Interpolated quantile of all values on earlier rows (``pos`` = 0, 1, 2, ..), null before ``min_n`` of them.

    Rows are cut into blocks of ``block`` positions. Inside a block the wanted order statistic moves by no more places than the block has rows, so a block
    needs, of all earlier rows, only the values around the statistic at its start: about twice its rows. Counts for each block and bucket of ranks
    (``block`` / ``fan`` ranks each) tell which buckets hold them; equal values are sent as one with their count.
    """
    ranked = written(df.join(value_positions(df, [], x).select(x, F.col("below").alias("_rank")), x).select(
        F.col(pos).alias("_pos"), F.col(x).cast("double").alias("_x"),
        F.floor(F.col(pos) / F.lit(block)).alias("_b"), F.floor(F.col("_rank") / F.lit(max(1, block // fan))).alias("_u"),
    ), "ranked")
    blocks, buckets = (m or 0 for m in ranked.agg(F.max("_b") + 1, F.max("_u") + 1).first())
    cells = df.sparkSession.range(blocks * buckets).select(F.floor(F.col("id") / max(1, buckets)).alias("_b"), (F.col("id") % max(1, buckets)).alias("_u"))
    held = cells.join(ranked.groupBy("_b", "_u").agg(F.count("*").alias("_n")), ["_b", "_u"], "left")
    past = held.withColumn("_n", F.coalesce(F.sum("_n").over(Window.partitionBy("_u").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = past.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_b").orderBy("_u")))
    start = F.col("_b") * block
    near = (F.col("_n") > 0) & (F.col("_upto") > q * start - block - 3) & (F.col("_upto") - F.col("_n") <= q * (start + block) + 3)
    needed = upto.where(near).select("_u", F.col("_b").alias("_for"), (F.col("_upto") - F.col("_n")).alias("_lower"))
    skipped = needed.groupBy("_for").agg(F.min("_lower").alias("_lower"))
    earlier = needed.drop("_lower").join(ranked.groupBy("_u", "_b", "_x").agg(F.count("*").alias("_n")), "_u").where(F.col("_b") < F.col("_for"))
    around = earlier.groupBy("_for", "_x").agg(F.sum("_n").alias("_n")).join(skipped, "_for")
    sent = around.select(F.col("_for").alias("_b"), F.lit(None).cast("long").alias("_pos"), "_x", "_n", "_lower").unionByName(
        ranked.select("_b", F.col("_pos").cast("long").alias("_pos"), "_x", F.lit(1).cast("long").alias("_n"), F.lit(0).cast("long").alias("_lower")))
    walk = lambda table: _past_statistics(table, q, min_n)
    found = sent.groupBy("_b").applyInArrow(walk, "_pos long, _lo double, _hi double")
    share = F.lit(q) * (F.col(pos) - 1) - F.floor(F.lit(q) * (F.col(pos) - 1))
    return df.join(found.withColumnRenamed("_pos", pos), pos, "left").select(
        *df.columns, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias(name)
    )
