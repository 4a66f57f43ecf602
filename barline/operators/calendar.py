"""Calendars: alignment, expiry, month and quarter logic, sessions (all on tables, no driver loops)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.plans.blocks import in_blocks, number_rows, running

NEW_YORK = "America/New_York"


def local_time(ts: str | Column, zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone)


def align_calendar(bars: DataFrame, start=None, end=None) -> DataFrame:
    """One row per (symbol, calendar time): missing bars appear with null prices.

    Each bar fills the gap up to the next bar of its symbol, so no cross join is needed: the first bar also
    fills from the start of the calendar and the last one to its end.
    """
    days = bars.select("ts").distinct()
    if start is not None:
        days = days.where(F.col("ts") >= F.lit(start).cast("timestamp"))
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        days = days.where(F.col("ts") <= F.lit(end).cast("timestamp"))
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    cal = number_rows(days, [], ["ts"], pos="ci")
    values = [c for c in bars.columns if c not in ("symbol", "ts", "pos")]
    placed = bars.join(cal, "ts").drop("pos")
    placed = number_rows(placed, ["symbol"], ["ts"])
    placed = placed.withColumn("_top", cal.agg(F.max("ci")).scalar())

    def fill(rows: DataFrame, w) -> DataFrame:
        until = F.coalesce(F.lead("ci").over(w) - 1, F.col("_top"))
        since = F.when(F.lag("ci").over(w).isNull(), F.lit(0).cast("long")).otherwise(F.col("ci"))
        return rows.withColumn("_since", since).withColumn("_until", until)

    spans = in_blocks(placed, fill, back=1, fwd=1)
    dense = spans.withColumn("_ci", F.explode(F.sequence("_since", "_until")))
    own = F.col("_ci") == F.col("ci")
    filled = dense.select("symbol", F.col("_ci").alias("ci"), *[F.when(own, F.col(c)).alias(c) for c in values])
    return filled.join(cal, "ci").select("symbol", "ts", "ci", *values)


def min_history(bars: DataFrame, n: int) -> DataFrame:
    """Bars of symbols with at least ``n`` rows; the count is a map-side aggregate, not a window."""
    enough = bars.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= n)
    return bars.join(enough.select("symbol"), "symbol", "left_semi")


def regular_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where(F.hour(local_time(ts)).between(9, 15))


def session_label(ts: Column, day: Column) -> Column:
    """pre_market before 9:30, post_close from 16:00 or when dated before its effective day."""
    local = local_time(ts)
    minute = F.hour(local) * 60 + F.minute(local)
    return (
        F.when(F.to_date(local) < day, "post_close")
        .when(minute < 570, "pre_market")
        .when(minute >= 960, "post_close")
        .otherwise("intraday")
    )


def opex_dates(cal: DataFrame) -> DataFrame:
    """Third listed Friday of each month, else the last day on or before the calendar's third Friday."""
    month = F.trunc("day", "month")
    third = F.date_add(F.next_day(F.date_sub(month, 1), "FR"), 14)
    friday = F.when(F.dayofweek("day") == 6, F.col("day"))
    per_month = (
        cal.groupBy(month.alias("month"))
        .agg(
            F.sort_array(F.collect_list(friday)).alias("fridays"),  # at most five days
            F.max(F.when(F.col("day") <= third, F.col("day"))).alias("fallback"),
        )
        .select("month", F.coalesce(F.get("fridays", F.lit(2)), F.col("fallback")).alias("expiry"))
    )
    return per_month.where(F.col("expiry").isNotNull())


def opex_week(cal: DataFrame) -> DataFrame:
    """Flag the days from Monday to expiry of each expiry week."""
    expiries = opex_dates(cal).select(F.trunc("expiry", "week").alias("_wk"), "expiry")
    flagged = cal.withColumn("_wk", F.trunc("day", "week")).join(expiries, "_wk", "left")
    return flagged.select(*cal.columns, F.coalesce(F.col("day") <= F.col("expiry"), F.lit(False)).alias("in_opex_week"))


def turn_of_month(cal: DataFrame, last_n: int = 4, first_n: int = 3) -> DataFrame:
    w = Window.partitionBy(F.trunc("day", "month"))  # at most 31 days per group
    head = F.row_number().over(w.orderBy("day"))
    tail = F.row_number().over(w.orderBy(F.desc("day")))
    return cal.select(*cal.columns, ((head <= first_n) | (tail <= last_n)).alias("turn"))


def quarter_ends(cal: DataFrame) -> DataFrame:
    return cal.groupBy(F.year("day").alias("year"), F.quarter("day").alias("quarter")).agg(F.max("day").alias("day"))


def reaction_day(announced: Column, close_hour: int = 16) -> Column:
    """Announcements at or after the close belong to the next calendar day."""
    return F.when(F.hour(announced) >= close_hour, F.date_add(F.to_date(announced), 1)).otherwise(F.to_date(announced))


def reaction_trading_day(announced: DataFrame, cal: DataFrame, ts: str = "ts", close_hour: int = 16) -> DataFrame:
    """:func:`reaction_day` moved on to the first trading day from there on, as ``reaction``; null behind the last one and without a time."""
    dated = announced.withColumn("_date", F.when(F.col(ts).isNotNull(), on_calendar(reaction_day(F.col(ts), close_hour), cal)))
    days = next_trading_day_map(cal).select(F.col("date").alias("_date"), F.col("trading_day").alias("reaction"))
    return dated.join(days, "_date", "left").drop("_date")


def scale_volume(bars: DataFrame, scale: float) -> DataFrame:
    """Bars with their volume times ``scale``, a missing one as zero; a scale of 1 leaves the bars as they are."""
    return bars if scale == 1.0 else bars.withColumn("volume", F.coalesce("volume", F.lit(0.0)) * scale)


def on_calendar(date: Column, cal: DataFrame) -> Column:
    """The date to look up in the map of ``cal``: a date before the first trading day looks that day up, however early it is."""
    return F.greatest(date, cal.agg(F.min("day")).scalar())


def next_trading_day_map(cal: DataFrame) -> DataFrame:
    """Dense map from the first to the last trading day: calendar date -> first trading day on or after it."""
    seen = running(
        cal, {"_prev": ("last", F.col("day"))}, keys=[], pos="ci", inclusive=False
    )
    first = F.coalesce(F.date_add("_prev", 1), F.col("day"))
    return seen.select(F.explode(F.sequence(first, F.col("day"))).alias("date"), F.col("day").alias("trading_day"))


def periods_per_year(bars: DataFrame) -> DataFrame:
    """252 x bars per distinct day, at least 252; days are made distinct before the shuffle by key."""
    per_day = bars.groupBy("symbol", F.to_date("ts").alias("_d")).agg(F.count("*").alias("_n"))
    return per_day.groupBy("symbol").agg(
        F.greatest(F.lit(252.0), 252.0 * F.sum("_n") / F.count("*")).alias("periods")
    )


# Bars per named window.
WINDOW_BARS = {"1m": 21, "3m": 63, "6m": 126, "9m": 189, "1y": 252, "2y": 504, "3y": 756, "15y": 3780}


def window_bars(name: str, timeframe: str = "day", regular_hours: bool = False) -> int:
    """Bars of a named window; an hourly series has 24 bars a day, or 7 in regular hours."""
    return WINDOW_BARS[name] * ((7 if regular_hours else 24) if timeframe == "hour" else 1)
