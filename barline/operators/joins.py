"""Joins: equi joins with defaults, point-in-time joins, event windows, parameter grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators.calendar import next_trading_day_map, on_calendar
from barline.plans.asof import asof


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with a default for every joined column that finds no partner."""
    joined = df.join(other.select(*keys, *defaults), list(keys), "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def next_bar(articles: DataFrame, bars: DataFrame, ts: str = "created_at") -> DataFrame:
    """First bar at or after each article; articles after the last bar are dropped."""
    found = asof(articles, bars.select("symbol", "ts"), ["symbol"], ts, "ts", [], "forward")
    return found.where(F.col("matched_ts").isNotNull()).withColumnRenamed("matched_ts", "bar_ts")


def asof_backward(bars: DataFrame, preds: DataFrame, values: Sequence[str]) -> DataFrame:
    """Latest prediction at or before each bar."""
    return asof(bars, preds, ["symbol"], "ts", "ts", values, "backward")


def snap_events(events: DataFrame, cal: DataFrame, day: str = "day") -> DataFrame:
    """Move event dates to the first trading day on or after them; events past the calendar are dropped."""
    days = next_trading_day_map(cal).withColumnRenamed("date", "_date")
    return events.withColumn("_date", on_calendar(F.to_date(day), cal)).join(days, "_date").drop("_date")


def outer_series(frames: dict[str, DataFrame]) -> DataFrame:
    """Several (ts, value) series side by side: one union and one aggregate instead of a chain of outer joins."""
    stacked = None
    for name, df in frames.items():
        part = df.select("ts", F.lit(name).alias("_n"), "value")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("ts").agg(*[F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n) for n in frames])


def missing_scores(bundles: DataFrame, scores: DataFrame, keys=("symbol", "trading_day", "prompt_hash")) -> DataFrame:
    """Bundles without a cached score."""
    return bundles.join(scores.select(*keys), list(keys), "left_anti")


def event_windows(returns: DataFrame, events: DataFrame, pre: int, post: int) -> DataFrame:
    """Returns at offsets -pre..+post around each event; the whole window must exist.

    ``returns`` (symbol, ts, pos, ret) is numbered per symbol; ``events`` (symbol, ts) are bar times.
    """
    last = returns.groupBy("symbol").agg(F.max("pos").alias("_last"))
    anchors = events.join(returns.select("symbol", "ts", F.col("pos").alias("_p")), ["symbol", "ts"]).join(last, "symbol")
    whole = anchors.where((F.col("_p") >= pre) & (F.col("_p") + post <= F.col("_last")))
    spread = whole.select(
        "symbol", F.col("ts").alias("event_ts"), "_p", F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("offset")
    ).withColumn("pos", F.col("_p") + F.col("offset"))
    return spread.join(returns.select("symbol", "pos", "ret"), ["symbol", "pos"]).select("symbol", "event_ts", "offset", "ret")


def with_params(df: DataFrame, grid: Sequence[dict[str, object]]) -> DataFrame:
    """Every row once per parameter set. The grid is a literal of the plan, so its size is known and fixed."""
    names = list(grid[0])
    sets = F.array(*[F.struct(*[F.lit(p[n]).alias(n) for n in names]) for p in grid])
    return df.select("*", F.explode(sets).alias("_p")).select(*df.columns, *[F.col(f"_p.{n}") for n in names])


def delta(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two result sets side by side with their differences (b - a)."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    joined = left.join(right, list(keys))
    return joined.select("*", *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta") for m in metrics])


def restrict(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``, each once however often it occurs there."""
    return df.join(keys.select(*on), list(on), "left_semi")


def common_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def only_in(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks; null is a key value like any other."""
    return a.select(*on).subtract(b.select(*on))


def date_of(ts: str) -> Column:
    return F.to_date(F.col(ts))
