"""Event batteries: each returns (symbol, name, ts, value) rows ready for ``effect_test``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions import ts
from barline.operators import calendar as cal_ops
from barline.operators.joins import snap_events
from barline.operators.sleeves import run_returns
from barline.plans.blocks import in_blocks, number_rows
from barline.plans.ranks import expanding_quantile


def _rows(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return df.select("symbol", F.lit(name).alias("name"), "ts", value.alias("value")).where("value IS NOT NULL")


def on_days(returns: DataFrame, days: DataFrame, name: str, day: str = "day") -> DataFrame:
    """Single-day returns on the given trading days."""
    picked = returns.withColumn("_d", F.to_date("ts")).join(days.select(F.col(day).alias("_d")).distinct(), "_d", "left_semi")
    return _rows(picked, name, "ret")


def announcement_returns(returns: DataFrame, announcements: DataFrame, cal: DataFrame) -> DataFrame:
    """Return of the announcement day, or of the first trading day after it."""
    snapped = snap_events(announcements, cal).select(F.col("trading_day").alias("day"))
    return on_days(returns, snapped, "announcement")


def turn_of_month_returns(returns: DataFrame, cal: DataFrame, last_n: int = 4, first_n: int = 3) -> DataFrame:
    flags = cal_ops.turn_of_month(cal, last_n, first_n).select(F.col("day").alias("_d"), "turn")
    flagged = returns.withColumn("_d", F.to_date("ts")).join(flags, "_d").drop("_d")
    return _rows(run_returns(flagged, "turn"), "turn_of_month", "run_ret")


def opex_week_returns(returns: DataFrame, cal: DataFrame) -> DataFrame:
    flags = cal_ops.opex_week(cal).select(F.col("day").alias("_d"), "in_opex_week")
    flagged = returns.withColumn("_d", F.to_date("ts")).join(flags, "_d").drop("_d")
    return _rows(run_returns(flagged, "in_opex_week"), "opex_week", "run_ret")


def opex_day_returns(returns: DataFrame, cal: DataFrame) -> DataFrame:
    return on_days(returns, cal_ops.opex_dates(cal), "opex_day", "expiry")


def quarter_end_returns(returns: DataFrame, cal: DataFrame) -> DataFrame:
    return on_days(returns, cal_ops.quarter_ends(cal), "quarter_end")


def legs(bars: DataFrame) -> DataFrame:
    """Overnight (close to open) and intraday (open to close) returns."""
    return in_blocks(
        bars, lambda r, w: r.withColumns({"overnight": F.col("open") / F.lag("close").over(w) - 1, "intraday": F.col("close") / F.col("open") - 1}), back=1
    )


def overnight_intraday(rows: DataFrame, keys: list[str], periods: float = 252.0) -> DataFrame:
    """Means in bps, compounded totals, Sharpe (sample std) and the overnight share of both totals."""
    out = {}
    for leg in ("overnight", "intraday"):
        x = F.col(leg)
        out[f"{leg}_mean_bps"] = F.avg(x) * 10000
        out[f"{leg}_total"] = F.product(1 + x) - 1
        out[f"{leg}_sharpe"] = F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(periods))
    table = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])
    both = F.col("overnight_total") + F.col("intraday_total")
    return table.withColumn("overnight_share", F.when(both != 0, F.col("overnight_total") / both))


def gap_drift(bars: DataFrame, horizons=(5, 20), q: float = 0.9, min_n: int = 200, announced: DataFrame | None = None) -> DataFrame:
    """Forward returns after gaps in the top decile of all earlier gaps (expanding, prior events only).

    ``announced`` (symbol, ts) restricts the gaps to reaction days; without it every gap counts as an event.
    """

    def add(rows: DataFrame, w) -> DataFrame:
        made = {"gap": F.col("open") / F.lag("close").over(w) - 1}
        return rows.withColumns(made | {f"fwd_{h}": ts.forward_return("close", h, w) for h in horizons})

    rows = in_blocks(bars, add, back=1, fwd=max(horizons)).where("gap IS NOT NULL")
    if announced is not None:
        rows = rows.join(announced.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    events = number_rows(rows, [], ["ts", "symbol"], pos="seq")
    judged = expanding_quantile(events, "gap", q, pos="seq", min_n=min_n)
    return judged.where(F.col("threshold").isNotNull() & (F.col("gap") >= F.col("threshold")))


def vol_spikes(panel: DataFrame, level: float, n: int = 504, min_periods: int = 120, fill: int = 3, h: int = 5, index: str = "vix", asset: str = "asset") -> DataFrame:
    """Forward return of the asset after the index crosses a rolling percentile level from below."""

    def add(rows: DataFrame, w) -> DataFrame:
        rows = rows.withColumn("_v", ts.ffill(index, fill, w))
        rows = rows.withColumn("percentile", ts.rolling_percentile("_v", n, w, min_periods))
        return rows.withColumns({"_hit": ts.crossing("percentile", level, w), "fwd": ts.forward_return(asset, h, w)})

    rows = in_blocks(panel, add, back=n + fill + 1, fwd=h, keys=[])
    return rows.where(F.col("_hit") & F.col("fwd").isNotNull()).select("ts", "percentile", "fwd")
