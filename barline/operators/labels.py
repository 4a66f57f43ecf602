"""Labels, features and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions import ts
from barline.functions.scalar import choose
from barline.plans.arrays import Series, in_arrays
from barline.plans.blocks import in_blocks
from barline.plans.ranks import order_statistics


def period_of(cal: DataFrame, ci: str = "ci", train: float = 0.6, validation: float = 0.2, name: str = "period") -> DataFrame:
    """Chronological split of a numbered calendar: the first 60 % of days train, then 20 %, then the rest."""
    days = cal.withColumn("_n", cal.agg(F.count("*")).scalar())
    label = (
        F.when(F.col(ci) < F.floor(F.lit(train) * F.col("_n")), "train")
        .when(F.col(ci) < F.floor(F.lit(train + validation) * F.col("_n")), "validation")
        .otherwise("test")
    )
    return days.withColumn(name, label).drop("_n")


def embargo(splits: DataFrame, k: int, ci: str = "ci", name: str = "period") -> DataFrame:
    """Mark the last ``k`` days of train and validation as embargoed."""
    ends = splits.groupBy(name).agg(F.max(ci).alias("_end"))  # three rows
    near = (F.col(name) != "test") & (F.col(ci) > F.col("_end") - k)
    return splits.join(ends, name).select(
        *[F.when(near, "embargo").otherwise(F.col(c)).alias(c) if c == name else F.col(c) for c in splits.columns]
    )


def direction(ret: Column, threshold: Column, names=("bullish", "bearish", "neutral")) -> Column:
    return F.when(ret >= threshold, names[0]).when(ret <= -threshold, names[1]).otherwise(names[2])


def strength(ret: Column, threshold: Column) -> Column:
    size = F.abs(ret)
    return F.when(size >= threshold * 2.5, "high").when(size >= threshold * 1.5, "medium").otherwise("low")


def _label_inputs(h: int, minimum: float, multiplier: float):
    def add(rows: DataFrame, w) -> DataFrame:
        # The first bar of a series has return 0 and rows before bar 20 are dropped, so frames are full.
        rows = rows.withColumn("_r", F.coalesce(ts.simple_return("close", w), F.lit(0.0)))
        vol = F.stddev_pop("_r").over(w.rowsBetween(-19, 0))
        return rows.withColumns(
            {
                "fwd": ts.forward_return("close", h, w),
                "end_ts": F.lead("ts", h).over(w),
                "vol20": vol,
                "threshold": F.greatest(F.lit(minimum), vol * math.sqrt(h) * multiplier),
            }
        )

    return add


def band_labels(
    bars: DataFrame, bench: DataFrame | None = None, h: int = 5, minimum: float = 0.01, multiplier: float = 0.5
) -> DataFrame:
    """Volatility-scaled labels: direction and strength of the forward return, relative label of its excess."""
    rows = in_blocks(bars, _label_inputs(h, minimum, multiplier), back=21, fwd=h)
    rows = rows.where((F.col("pos") >= 20) & F.col("fwd").isNotNull())
    if bench is None:
        rows = rows.withColumn("bench_ret", F.lit(0.0))
    else:
        start = bench.select("ts", F.col("close").alias("_b0"))
        end = bench.select(F.col("ts").alias("end_ts"), F.col("close").alias("_b1"))
        rows = rows.join(start, "ts", "left").join(end, "end_ts", "left").withColumn(
            "bench_ret", F.coalesce(F.col("_b1") / F.col("_b0") - 1, F.lit(0.0))
        )
    excess = F.col("fwd") - F.col("bench_ret")
    return rows.select(
        "symbol", "ts", "fwd", excess.alias("excess"), "vol20", "threshold",
        direction(F.col("fwd"), F.col("threshold")).alias("direction"),
        strength(F.col("fwd"), F.col("threshold")).alias("strength"),
        direction(excess, F.col("threshold"), ("outperform", "underperform", "inline")).alias("relative"),
    )


def triple_barrier(bars: DataFrame, h: int = 5, minimum: float = 0.01, multiplier: float = 0.5) -> DataFrame:
    """First barrier touched within ``h`` bars; both in one bar: sign of its close against the entry."""

    def add(rows: DataFrame, w) -> DataFrame:
        rows = _label_inputs(h, minimum, multiplier)(rows, w)
        up, down = F.col("close") * (1 + F.col("threshold")), F.col("close") * (1 - F.col("threshold"))
        touches = []
        for i in range(1, h + 1):
            hi, lo = F.lead("high", i).over(w) >= up, F.lead("low", i).over(w) <= down
            both = F.when(F.lead("close", i).over(w) >= F.col("close"), "bullish").otherwise("bearish")
            touches.append(F.when(hi & lo, both).when(hi, "bullish").when(lo, "bearish"))
        return rows.withColumn("barrier", F.coalesce(*touches, F.lit("neutral")))

    rows = in_blocks(bars, add, back=21, fwd=h)
    return rows.where((F.col("pos") >= 20) & F.col("fwd").isNotNull()).select("symbol", "ts", "threshold", "barrier")


def _gap(current: Column, reference: Column) -> Column:
    return F.when(reference > 0, current / reference - 1).otherwise(0.0)


def _ratio(current: Column, reference: Column) -> Column:
    return F.when((current > 0) & (reference > 0), current / reference - 1).otherwise(0.0)


# Feature names in their fixed order.
TECHNICAL = [
    "ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "sma_gap_5", "sma_gap_10", "sma_gap_20", "vol_5", "vol_10",
    "range_1", "range_5_avg", "close_vs_high_20", "close_vs_low_20", "volume_ratio_5", "volume_ratio_20",
]


def _technical(s: dict[str, Series]) -> dict[str, Series]:
    """The 16 technical features and the next-bar-up label; looks 21 rows back and one ahead."""
    c, v = s["close"], s["volume"]
    r, span, after = c.ratio(c.lag()) - 1, s["high"].gap(s["low"]), c.lead()
    return {
        **{f"ret_{n}": c.gap(c.lag(n)) for n in (1, 3, 5, 10, 20)},
        **{f"sma_gap_{n}": c.gap(c.some_mean(n)) for n in (5, 10, 20)},
        **{f"vol_{n}": r.some_std(n) for n in (5, 10)},
        "range_1": span,
        "range_5_avg": span.some_mean(5),
        "close_vs_high_20": c.gap(s["high"].some_max(20)),
        "close_vs_low_20": c.gap(s["low"].some_min(20)),
        "volume_ratio_5": v.gap(v.some_mean(5), both=True),
        "volume_ratio_20": v.gap(v.some_mean(20), both=True),
        "label": after.like(after.above(c).astype(float), after.ok & c.ok),
    }


def add_technical(bars: DataFrame, digits: int | None = None) -> DataFrame:
    made = _technical if digits is None else lambda s: {n: x.round(digits) for n, x in _technical(s).items()}
    out = in_arrays(bars, made, ["high", "low", "close", "volume"], [*TECHNICAL, "label"], back=21, fwd=1)
    return out.withColumn("label", F.col("label").cast("int"))


def technical_features(bars: DataFrame, digits: int | None = None) -> DataFrame:
    return add_technical(bars, digits).where((F.col("pos") >= 20) & F.col("label").isNotNull()).select("symbol", "ts", "pos", *TECHNICAL, "label")


def sequence_windows(bars: DataFrame, length: int = 24) -> DataFrame:
    """The last ``length`` feature vectors per bar as one nested array."""

    def add(rows: DataFrame, w) -> DataFrame:
        ready = (F.col("pos") >= 20) & F.col("label").isNotNull()
        rows = rows.withColumn("_vec", F.when(ready, F.array(*TECHNICAL)))
        return rows.withColumn("sequence", F.collect_list("_vec").over(w.rowsBetween(-(length - 1), 0)))

    rows = in_blocks(add_technical(bars), add, back=length)
    return rows.where((F.size("sequence") == length) & F.col("label").isNotNull()).select("symbol", "ts", "sequence", "label")


def news_price_features(
    bars: DataFrame, bench: DataFrame, outputs: DataFrame, h: int = 5, target: float = 0.01, symbols: Sequence[str] = ()
) -> DataFrame:
    """Price features plus one-hot news features and the excess-return target, rows 20 .. n-h."""

    prices = ["ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "dist_sma_10", "dist_sma_20", "vol_20", "volume_z"]

    def made(s: dict[str, Series]) -> dict[str, Series]:
        c, v = s["close"], s["volume"]
        r = (c.ratio(c.lag()) - 1).or_else(0.0)
        moves = v.some_max(20).above(v.some_min(20))
        score = (v.v - v.some_mean(20).v) / v.some_std(20).v
        return {
            **{f"ret_{n}": c.gap(c.lag(n)) for n in (1, 3, 5, 10, 20)},
            **{f"dist_sma_{n}": c.gap(c.some_mean(n)) for n in (10, 20)},
            "vol_20": r.some_std(20),
            "volume_z": v.like(np.where(moves, score, 0.0), v.ok | ~moves),
            "fwd": c.lead(h).ratio(c) - 1,
            "_end": s["_time"].lead(h),  # microseconds, whole numbers as doubles
        }

    rows = in_arrays(bars.withColumn("_time", F.unix_micros("ts").cast("double")), made, ["close", "volume", "_time"], [*prices, "fwd", "_end"], back=21, fwd=h)
    rows = rows.withColumn("end_ts", F.timestamp_micros(F.col("_end").cast("long"))).where((F.col("pos") >= 20) & F.col("fwd").isNotNull())
    start = bench.select("ts", F.col("close").alias("_b0"))
    end = bench.select(F.col("ts").alias("end_ts"), F.col("close").alias("_b1"))
    rows = rows.join(start, "ts", "left").join(end, "end_ts", "left").join(outputs, ["symbol", "ts"], "left")
    excess = F.col("fwd") - F.coalesce(F.col("_b1") / F.col("_b0") - 1, F.lit(0.0))
    label = F.coalesce(choose(F.col("direction"), {"bullish": 1.0, "bearish": -1.0}, 0.0), F.lit(0.0))
    power = F.coalesce(choose(F.col("strength"), {"low": 1.0, "medium": 2.0, "high": 3.0}, 1.0), F.lit(1.0))
    event = F.coalesce(F.col("event_type"), F.lit("other"))
    session = F.coalesce(F.col("session"), F.lit("mixed"))
    events = ["earnings", "guidance", "analyst", "mna", "regulatory", "litigation", "product", "macro", "other"]
    sessions = ["pre_market", "intraday", "post_close", "mixed"]
    hot = lambda x, v: (x == v).cast("double")
    return rows.select(
        "symbol", "ts", *prices, label.alias("label_score"), power.alias("strength_score"),
        (label * power).alias("signed_strength"),
        *[hot(F.col("symbol"), s).alias(f"symbol_{s.lower()}") for s in symbols],
        *[hot(event, e).alias(f"event_{e}") for e in events],
        *[hot(session, s).alias(f"session_{s}") for s in sessions],
        excess.alias("excess"), (excess >= target).cast("int").alias("target_long"),
    )


def forward_returns(horizons: Sequence[int]):
    """Close that many bars ahead over the close less one, for :func:`barline.plans.arrays.in_arrays`."""

    def made(s: dict[str, Series]) -> dict[str, Series]:
        return {f"f{h}": s["close"].lead(h).ratio(s["close"]) - 1 for h in horizons}

    return made


def balanced_sample(rows: DataFrame, label: str, order: Sequence[str], limit: int, classes: int = 3) -> DataFrame:
    """Up to ``limit`` rows with equal shares per class, filled up in order from what is left."""
    from barline.operators.news import first_k

    per_class = max(1, limit // classes)
    head = first_k(rows, [label], list(order), per_class).drop("_r")
    rest = rows.join(head.select(*order), list(order), "left_anti")
    need = head.count()  # at most ``limit`` rows
    fill = rest.orderBy(*order).limit(max(0, limit - need))
    return head.unionByName(fill)


def sector_thresholds(rows: DataFrame, value: str, keys: Sequence[str], band: float, default: float = 0.01, min_n: int = 10) -> DataFrame:
    """Lower and upper order statistics of the train rows per key; +-default below ``min_n`` rows."""
    low = (1.0 - band) / 2.0
    found = order_statistics(rows, list(keys), value, {"lower": low, "upper": 1.0 - low})
    few = F.col("n_values") < min_n
    return found.select(
        *keys,
        F.when(few, -default).otherwise(F.col("lower")).alias("lower"),
        F.when(few, default).otherwise(F.col("upper")).alias("upper"),
    )


def walk_forward(rows: DataFrame, train: int, step: int, pos: str = "pos") -> DataFrame:
    """Fold of each row in an expanding walk-forward: rows before ``train`` only train (fold null)."""
    fold = F.when(F.col(pos) >= train, F.floor((F.col(pos) - train) / step))
    return rows.withColumn("fold", fold).withColumn("train_end", F.when(F.col(pos) >= train, F.lit(train) + F.floor((F.col(pos) - train) / step) * step))


def tile_windows(cal: DataFrame, n: int, recent: int = 252, ci: str = "ci") -> DataFrame:
    """Complete non-overlapping windows of ``n`` days, the last ``recent`` days and the full span."""
    days = cal.withColumn("_n", cal.agg(F.count("*")).scalar())
    tile = F.floor(F.col(ci) / n)
    names = F.array(
        F.when(tile < F.floor(F.col("_n") / n), F.concat(F.lit("w"), F.lpad((tile + 1).cast("string"), 2, "0"))),
        F.when((F.col("_n") >= recent) & (F.col(ci) >= F.col("_n") - recent), F.lit(f"recent_{recent}")),
        F.lit("full"),
    )
    tagged = days.select(*cal.columns, F.explode(F.array_compact(names)).alias("window"))
    return tagged


def top_rows_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)
