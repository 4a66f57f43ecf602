"""Price bars with their positions from single prices, in one shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barline.plans.blocks import MOST_RANGES, RANGE_ROWS
from barline.plans.ranks import groups
from barline.session import written


def numbered_bars(prices: DataFrame, order: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """key, ts, open, high, low, close, volume, pos: the bars of the prices (key, ts, px, volume), first and last price by ``order``, which rises with ts.

    Prices are dealt out in sampled ranges of (key, ts) and sorted there, so that a bar lies in one range and is added up as its prices pass by.
    A bar's position is its place among the bars of its key in the range, plus the bars of the key in earlier ranges; only a key that is cut by a
    border has any, at most one for each border.
    """
    parts = max(1, min(MOST_RANGES, -(-prices.count() // rows)))
    dealt = prices.repartitionByRange(parts, "key", "ts").sortWithinPartitions("key", *order).select("key", "ts", "px", "volume")
    doubles = ", ".join(f"{c} double" for c in _BAR)
    made = dealt.mapInArrow(_bars, f"key {prices.schema['key'].dataType.simpleString()}, ts timestamp, {doubles}, pos long")
    made = written(made.withColumn("_rng", F.spark_partition_id()), "bars")
    met = made.groupBy("key", "_rng").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("key").orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    cut_keys = met.withColumn("_off", F.sum("_n").over(earlier)).where("_off IS NOT NULL")
    carry = written(cut_keys.select(F.col("key").alias("_key"), F.col("_rng").alias("_in"), "_off"), "carry")
    placed = made.join(carry, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_rng") == F.col("_in")), "left")
    return placed.select("key", "ts", *_BAR, (F.col("pos") + F.coalesce("_off", F.lit(0))).alias("pos"))


_BAR = ("open", "high", "low", "close", "volume")


def _bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bars of sorted prices. The last bar of a batch waits for the next one, which may go on with it."""
    last, pos = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        made = _added_up(pa.Table.from_batches([batch]))
        if last is not None:
            made = _joined(last, made)
        key = groups(made, ["key"])
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(made.num_rows) - begin[key]
        place[key == 0] += pos if last is not None else 0  # the waiting bar is the first row
        last, pos = made.slice(made.num_rows - 1), int(place[-1])
        yield from made.slice(0, made.num_rows - 1).append_column("pos", pa.array(place[:-1], pa.int64())).to_batches()
    if last is not None:
        yield from last.append_column("pos", pa.array([pos], pa.int64())).to_batches()


def _added_up(table: pa.Table) -> pa.Table:
    """One row per run of equal (key, ts): nulls are left out but for the first and last price; a NaN is the largest price."""
    group = groups(table, ["key", "ts"])
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.concatenate([begin[1:], [table.num_rows]]) - 1
    px, volume = (table.column(c).combine_chunks() for c in ("px", "volume"))
    ok, x = px.is_valid().to_numpy(zero_copy_only=False), px.to_numpy(zero_copy_only=False)
    sold, v = volume.is_valid().to_numpy(zero_copy_only=False), volume.to_numpy(zero_copy_only=False)
    any_px, any_volume = np.logical_or.reduceat(ok, begin), np.logical_or.reduceat(sold, begin)
    high, low = np.maximum.reduceat(np.where(ok, x, -np.inf), begin), np.fmin.reduceat(np.where(ok, x, np.nan), begin)
    total = np.add.reduceat(np.where(sold, v, 0.0), begin)
    columns = [px.take(pa.array(begin)), pa.array(high, mask=~any_px), pa.array(low, mask=~any_px), px.take(pa.array(end)), pa.array(total, mask=~any_volume)]
    return pa.Table.from_arrays([*(table.column(c).combine_chunks().take(pa.array(begin)) for c in ("key", "ts")), *columns], ["key", "ts", *_BAR])


def _joined(last: pa.Table, made: pa.Table) -> pa.Table:
    """The waiting bar in front of the others, as one with the first of them if it is the same bar."""
    a, b = last.to_pylist()[0], made.slice(0, 1).to_pylist()[0]
    if (a["key"], a["ts"]) != (b["key"], b["ts"]):
        return pa.concat_tables([last, made])
    pair = lambda c, fn: fn([x[c] for x in (a, b) if x[c] is not None] or [None])
    highest = lambda x: None if x[0] is None else float(np.max(x))
    lowest = lambda x: None if x[0] is None else float(np.fmin.reduce(x))
    one = {"key": a["key"], "ts": a["ts"], "open": a["open"], "high": pair("high", highest), "low": pair("low", lowest), "close": b["close"]}
    one["volume"] = pair("volume", lambda x: None if x[0] is None else sum(x))
    return pa.concat_tables([pa.Table.from_pylist([one], schema=made.schema), made.slice(1)])
