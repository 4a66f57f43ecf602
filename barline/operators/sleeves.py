"""Sleeves and books on return series: flags, two-leg weights, runs, stress, virtual books, order decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.plans.blocks import BLOCK, in_blocks, islands, running
from barline.session import written


def flag_sleeve(df: DataFrame, flag: str, bps: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Hold while yesterday's flag is on; every change of position costs ``bps``."""

    def add(rows: DataFrame, w) -> DataFrame:
        held = F.coalesce(F.lag(F.col(flag).cast("int")).over(w), F.lit(0)).cast("double")
        rows = rows.withColumn("position", held)
        change = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
        return rows.withColumns(
            {"gross": F.col("ret") * F.col("position"), "net": F.col("ret") * F.col("position") - change * (bps / 10000.0), "change": change}
        )

    return in_blocks(df, add, back=2, keys=keys)


def weights_sleeve(panel: DataFrame, keys: Sequence[str], lag: int, bps: float) -> DataFrame:
    """Two legs from slope, premium and trend of ``lag`` rows ago; cash earns on the rest.

    ``panel`` (keys, pos, slope, vrp, trend, short_ret, long_ret, cash_ret, slope_min, vrp_gate, long_leg, last_pos).
    The weight decided on a row earns from the next row on; the last row does not trade.
    """

    def add(rows: DataFrame, w) -> DataFrame:
        def at(c: str) -> Column:
            return F.lag(c, lag - 1).over(w) if lag > 1 else F.col(c)

        rows = rows.withColumns({"_slope": at("slope"), "_vrp": at("vrp"), "_trend": at("trend")})
        gate = ~F.col("vrp_gate") | F.coalesce(F.col("_vrp") > 0, F.lit(False))
        short = F.when((F.col("_slope") > F.col("slope_min")) & gate, 1.0).otherwise(0.0)
        long = F.when(
            ~F.coalesce(F.col("_slope") > F.col("slope_min"), F.lit(False)) & F.col("long_leg") & (F.col("_slope") < 0) & (F.col("_trend") > 0), 1.0
        ).otherwise(0.0)
        rows = rows.withColumns({"_ts": short, "_tl": long})
        held = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
        rows = rows.withColumns({"short_w": held("_ts"), "long_w": held("_tl")})
        trades = F.col("pos") < F.col("last_pos")
        turnover = F.when(
            trades, F.abs(F.col("_ts") - F.col("short_w")) + F.abs(F.col("_tl") - F.col("long_w"))
        ).otherwise(0.0)
        zero = F.lit(0.0)
        gross = (
            F.col("short_w") * F.coalesce("short_ret", zero) + F.col("long_w") * F.coalesce("long_ret", zero)
            + F.greatest(zero, 1 - F.col("short_w") - F.col("long_w")) * F.coalesce("cash_ret", zero)
        )
        return rows.withColumns({"turnover": turnover, "gross": gross, "net": gross - turnover * (bps / 10000.0)})

    return in_blocks(panel, add, back=lag + 1, keys=keys)


def run_returns(df: DataFrame, flag: str, keys: Sequence[str] = ("symbol",), ret: str = "ret") -> DataFrame:
    """Compounded return of each run of flagged rows, stamped at its first row."""
    runs = islands(df, F.col(flag), keys=keys).where(F.col(flag))
    return runs.groupBy(*keys, "run_id").agg(
        F.min("ts").alias("ts"), (F.product(1 + F.coalesce(ret, F.lit(0.0))) - 1).alias("run_ret"), F.count("*").alias("days")
    ).drop("run_id")


def gap_stress(df: DataFrame, keys: Sequence[str], shock: float = -0.6, ret: str = "ret") -> DataFrame:
    """Replace the worst row of each key by ``shock`` (earliest on ties)."""
    worst = df.groupBy(*keys).agg(F.min_by("pos", F.struct(ret, "pos")).alias("_worst"))
    return df.join(worst, list(keys)).withColumn(
        ret, F.when(F.col("pos") == F.col("_worst"), F.lit(shock)).otherwise(F.col(ret))
    ).drop("_worst")


def book_trades(signals: DataFrame, notional: Column, keys: Sequence[str] = ("symbol",), block: int = BLOCK) -> DataFrame:
    """Virtual book trades: buy at the first bar of each long run, sell at the first flat bar after it.

    The rows are dealt out once: a block adds its rows up to pieces of runs, and only the pieces are numbered and joined across blocks.
    """
    keys = list(keys)

    def add(rows: DataFrame, w) -> DataFrame:
        flag = F.col("signal") == 1
        rows = rows.withColumns({
            "_exit": F.lead("close").over(w), "_exit_ts": F.lead("ts").over(w), "_in": F.col("_blk"),
            "_new": F.when(F.lag(flag).over(w).eqNullSafe(flag), 0).otherwise(1),
        })
        return rows.withColumn("_piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    rows = in_blocks(signals.select(*keys, "pos", "ts", "close", "signal"), add, back=1, fwd=1, keys=keys, block=block).where(F.col("signal") == 1)
    first, last = (lambda c, by="pos": F.min_by(c, by)), (lambda c, by="pos": F.max_by(c, by))
    pieces = rows.groupBy(*keys, "_in", "_piece").agg(
        first("_new").alias("_new"), first("ts").alias("entry_ts"), first("close").alias("entry_price"),
        last("_exit_ts").alias("exit_ts"), last("_exit").alias("exit_price"), last("close").alias("last_price"), F.min("pos").alias("pos"),
    )
    runs = running(written(pieces.drop("_in", "_piece"), "run-pieces"), {"run_id": ("sum", F.col("_new"))}, keys=keys, block=block)
    trades = runs.groupBy(*keys, "run_id").agg(*[fn(c).alias(c) for fn, c in (
        (first, "entry_ts"), (first, "entry_price"), (last, "exit_ts"), (last, "exit_price"), (last, "last_price"),
    )])
    return trades.withColumn("qty", notional / F.col("entry_price")).drop("run_id")


def virtual_books(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Realised, unrealised and total profit per key from its trades; an open trade is marked at the last close."""
    closed = F.col("exit_price").isNotNull()
    realised = F.when(closed, (F.col("exit_price") - F.col("entry_price")) * F.col("qty")).otherwise(0.0)
    floating = F.when(~closed, (F.col("last_price") - F.col("entry_price")) * F.col("qty")).otherwise(0.0)
    return trades.groupBy(*keys).agg(
        F.sum(realised).alias("realized_pnl"), F.sum(floating).alias("unrealized_pnl"),
        F.sum(F.when(~closed, F.col("qty")).otherwise(0.0)).alias("position_qty"),
        F.count("*").alias("buys"), F.count_if(closed).alias("sells"), F.min("entry_ts").alias("first_seen"),
    ).withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl"))


def book_leaderboard(books: DataFrame, snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Books with the number of their snapshots and the first one."""
    seen = snapshots.groupBy(*keys).agg(F.count("*").alias("snapshots"), F.min("created_at").alias("first_seen"))
    return books.join(seen, list(keys), "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0)))


def stop_decisions(positions: DataFrame, stop_loss: float, trailing: float) -> DataFrame:
    """Stop check on position snapshots: qty, avg_entry, price, high_water."""
    live = (F.col("qty") > 0) & F.col("price").isNotNull()
    high = F.greatest("high_water", "avg_entry", "price")
    fixed, trail = F.col("avg_entry") * (1 - stop_loss), high * (1 - trailing)
    reason = F.when(live & (F.col("price") <= fixed), "stop_loss").when(live & (F.col("price") <= trail), "trailing_stop")
    return positions.withColumns(
        {
            "new_high_water": F.when(live, high).otherwise(F.col("high_water")),
            "effective_stop": F.when(live, F.greatest(fixed, trail)),
            "reason": reason,
        }
    )


def limit_checks(orders: DataFrame, max_position: float, max_gross: float, max_positions: int, max_daily_loss_bps: float) -> DataFrame:
    """Entry limits of buy orders as a list of violations: side, notional, quantity, equity, gross, n_open, held, reference."""
    buy = F.lower("side") == "buy"
    ratio = F.col("notional") / F.col("equity")
    sized = (F.coalesce(F.col("quantity"), F.lit(0)) > 0) | (F.coalesce(F.col("notional"), F.lit(0)) > 0)
    funded = F.col("equity") > 0
    known = F.col("reference").isNotNull() & (F.col("reference") > 0) & funded
    loss = F.when(known, (F.col("reference") - F.col("equity")) / F.col("reference") * 10000)
    checks = [
        F.when(~sized, "no_size"),
        F.when(buy & ~funded, "no_equity"),
        F.when(buy & funded & (ratio > max_position), "position_size"),
        F.when(buy & funded & (F.col("gross") + ratio > max_gross), "gross_exposure"),
        F.when(buy & (F.col("held") <= 0) & (F.col("n_open") >= max_positions), "open_positions"),
        F.when(loss > max_daily_loss_bps, "daily_loss"),
    ]
    return orders.withColumn("violations", F.array_compact(F.array(*checks)))


def wanted_orders(signals: DataFrame, positions: DataFrame) -> DataFrame:
    """Order per symbol: a stop first, then sell when flat and held, buy when long and not held."""
    joined = signals.join(positions.select("symbol", "qty", "stop_reason"), "symbol", "left")
    held = F.coalesce("qty", F.lit(0.0)) > 0
    side = F.when(held & (F.col("stop_reason").isNotNull() | (F.col("signal") == 0)), "sell").when(~held & (F.col("signal") == 1), "buy")
    reason = (
        F.when(held & F.col("stop_reason").isNotNull(), F.col("stop_reason"))
        .when(held & (F.col("signal") == 0), "signal_exit")
        .when(~held & (F.col("signal") == 1), "signal_entry")
    )
    return joined.select("symbol", side.alias("side"), reason.alias("reason")).where("side IS NOT NULL")


def is_long(direction: Column, strength: Column, relative: Column, minimum: str = "medium", need_relative=False, momentum: Column | None = None) -> Column:
    """Bullish, strong enough and, when asked for, not expected to lag and confirmed by momentum."""
    order = {"low": 1, "medium": 2, "high": 3}
    rank = F.when(strength == "low", 1).when(strength == "medium", 2).when(strength == "high", 3).otherwise(0)
    ok = (direction == "bullish") & (rank >= order[minimum])
    if need_relative:
        ok = ok & (relative != "underperform")
    return ok if momentum is None else ok & momentum


def conviction(strength: Column) -> Column:
    """Share of equity by conviction."""
    return F.when(strength == "low", 0.25).when(strength == "high", 1.0).otherwise(0.5)


def cap_view(metrics: DataFrame, cap: float) -> DataFrame:
    """Sleeve metrics scaled to a weight cap."""
    return metrics.select(
        "symbol", F.lit(cap).alias("weight"), (F.col("ann_vol") * cap).alias("vol_part"),
        (F.col("max_drawdown") * cap).alias("drawdown_part"), (F.col("cagr") * cap).alias("cagr_part"),
    )
