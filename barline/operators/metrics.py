"""Return metrics, trade metrics, leaderboards and other report aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.scalar import beta_of
from barline.plans.blocks import running
from barline.plans.ranks import quantiles
from barline.session import cut
from barline.sources.readers import latest_per

PERIODS = 252.0


def equity_curve(df: DataFrame, keys: Sequence[str] = ("symbol",), pos: str = "pos", ret: str = "ret", start_peak: bool = False) -> DataFrame:
    """Running product of 1 + return, its peak and the drawdown; ``start_peak`` counts the start value 1 as a peak."""
    grown = running(df.where(F.col(ret).isNotNull()), {"equity": ("product", 1 + F.col(ret))}, keys=keys, pos=pos)
    peaked = running(grown, {"peak": ("max", F.col("equity"))}, keys=keys, pos=pos)
    peak = F.greatest(F.col("peak"), F.lit(1.0)) if start_peak else F.col("peak")
    return peaked.withColumn("peak", peak).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def annualised(total: Column, n: Column, periods: float = PERIODS) -> Column:
    return F.when(total > -1, F.pow(1 + total, F.lit(periods) / n) - 1).otherwise(-1.0)


def return_metrics(df: DataFrame, keys: Sequence[str], pos: str = "pos", ret: str = "ret", periods: float = PERIODS) -> DataFrame:
    """Total return, CAGR, volatility (population), Sharpe, worst drawdown, Calmar and days per key."""
    keys = list(keys)
    curve = equity_curve(df, keys, pos, ret)
    stats = curve.groupBy(*keys).agg(
        (F.product(1 + F.col(ret)) - 1).alias("total_return"),
        F.avg(ret).alias("_mean"),
        F.stddev_pop(ret).alias("_sd"),
        F.min("drawdown").alias("max_drawdown"),
        F.count("*").alias("days"),
    )
    cagr = annualised(F.col("total_return"), F.col("days"), periods)
    root = math.sqrt(periods)
    return stats.withColumn("cagr", cagr).select(
        *keys,
        "total_return",
        "cagr",
        (F.col("_sd") * root).alias("ann_vol"),
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root).otherwise(0.0).alias("sharpe"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
        "days",
    )


def volatilities(df: DataFrame, keys: Sequence[str], ret: str = "ret", periods: float = PERIODS) -> DataFrame:
    """Three annualised volatilities under their own names: root mean square, population and sample std."""
    root = math.sqrt(periods)
    x = F.col(ret)
    return df.groupBy(*keys).agg(
        (F.sqrt(F.avg(x * x)) * root).alias("rms_vol"),
        (F.stddev_pop(x) * root).alias("pop_vol"),
        (F.stddev_samp(x) * root).alias("samp_vol"),
    )


def beta_alpha(df: DataFrame, keys: Sequence[str], ret: str = "ret", bench: str = "mkt", min_rows: int = 31, periods: float = PERIODS) -> DataFrame:
    """Beta and annualised alpha against a benchmark; null below ``min_rows`` rows or without benchmark variance."""
    pairs = df.where(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    fit = pairs.groupBy(*keys).agg(
        beta_of(F.col(ret), F.col(bench)).alias("_b"), F.avg(ret).alias("_r"), F.avg(bench).alias("_m"), F.count("*").alias("days")
    )
    beta = F.when(F.col("days") >= min_rows, F.col("_b"))
    return fit.select(*keys, beta.alias("beta"), ((F.col("_r") - beta * F.col("_m")) * periods).alias("alpha"), "days")


def profit_factor(ret: Column) -> Column:
    gains, losses = F.sum(F.when(ret > 0, ret)), F.sum(F.when(ret < 0, ret))
    wins = F.count(F.when(ret > 0, 1)).cast("double")
    return F.when(F.abs(losses) > 0, F.coalesce(gains, F.lit(0.0)) / F.abs(losses)).otherwise(wins)


def composite_score(total: Column, drawdown: Column, win_rate: Column, factor: Column) -> Column:
    return total + drawdown * 0.5 + win_rate * 0.1 + F.least(factor, F.lit(3.0)) * 0.02


def trade_metrics(trades: DataFrame, keys: Sequence[str], ret: str = "trade_ret") -> DataFrame:
    """Count, win rate, profit factor and compounded return of closed trades."""
    r = F.col(ret)
    return trades.where(r.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        profit_factor(r).alias("profit_factor"),
        (F.product(1 + r) - 1).alias("total_return"),
    )


def exit_reasons(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exit reasons as counts per key."""
    return trades.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def window_aggregates(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per strategy and cost profile over all windows but the full one: means, median, worst drawdown, profitable share."""
    keys = list(keys)
    tiled = cut(runs.where(~F.col("window_name").startswith("full")))
    stats = tiled.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.avg("total_return").alias("mean_total_return"), F.avg("sharpe").alias("mean_sharpe"),
        F.min("max_drawdown").alias("worst_max_drawdown"), F.avg((F.col("total_return") > 0).cast("double")).alias("profitable_fraction"),
    )
    middle = quantiles(tiled, keys, "total_return", {"median_total_return": 0.5}).drop("n_values")
    return stats.join(middle, keys)


RUN_KEY = ["market", "symbol", "strategy", "window_name"]


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest_per(runs, RUN_KEY, ["created_at", "run_id"])


def leaderboard(runs: DataFrame) -> DataFrame:
    """Latest run per window, averaged per (market, symbol, strategy); composite = mean score + 0.1 x profitable share."""
    profit = F.count_if(F.col("total_return") > 0)
    return latest_runs(runs).groupBy("market", "symbol", "strategy").agg(
        F.array_join(F.sort_array(F.collect_set("window_name")), ",").alias("windows"),
        profit.alias("profitable_windows"),
        F.avg("total_return").alias("avg_total_return"),
        F.avg("max_drawdown").alias("avg_max_drawdown"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg(F.coalesce("profit_factor", F.lit(0.0))).alias("avg_profit_factor"),
        F.avg(F.coalesce("annualized_return", F.lit(0.0))).alias("avg_annualized_return"),
        F.avg("score").alias("avg_score"),
        (F.avg("score") + profit / F.count("*") * 0.1).alias("composite_score"),
        F.max("total_return").alias("best_window_return"),
        F.min("total_return").alias("worst_window_return"),
    )


def param_marginals(runs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean metrics per value of each parameter, all parameters in one pass over the runs (grouping sets)."""
    values = runs.select(*[F.col(p).cast("string").alias(p) for p in params], "total_return", "max_drawdown", "score")
    grouped = values.groupingSets([[F.col(p)] for p in params], *[F.col(p) for p in params]).agg(
        F.grouping_id().alias("_g"),
        F.avg("total_return").alias("avg_total_return"), F.avg("max_drawdown").alias("avg_max_drawdown"),
        F.avg("score").alias("avg_score"), F.count("*").alias("runs"),
    )
    full = (1 << len(params)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, p in enumerate(params):
        mine = F.col("_g") == full - (1 << (len(params) - 1 - i))
        name, value = F.when(mine, F.lit(p)).otherwise(name), F.when(mine, F.col(p)).otherwise(value)
    return grouped.select(name.alias("param"), value.alias("value"), "avg_total_return", "avg_max_drawdown", "avg_score", "runs")


def best_per(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """Best row per key under a full ordering (largest wins)."""
    return latest_per(df, keys, by)


def report_score(board: DataFrame) -> DataFrame:
    """Report score of leaderboard rows: return, half the drawdown, profitable share, capped profit factor."""
    share = F.col("profitable_windows") / F.greatest(F.lit(1), F.col("total_windows"))
    score = F.col("avg_total_return") + F.col("avg_max_drawdown") * 0.5 + share * 0.1 + F.least("avg_profit_factor", F.lit(3.0)) * 0.02
    return board.withColumn("report_score", score)


def compare_means(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Means of two result columns, their difference and how often a beats b."""
    return rows.agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), (F.avg(a) - F.avg(b)).alias("delta"),
        F.count_if(F.col(a) > F.col(b)).alias("a_wins"), F.count("*").alias("n"),
    )


def nearest_group(runs: DataFrame, keys: Sequence[str], group: Sequence[str], target: DataFrame) -> DataFrame:
    """Per key the parameter group whose mean return is nearest to a published mean (first in order on ties)."""
    means = runs.groupBy(*keys, *group).agg(F.avg("total_return").alias("group_mean"))
    joined = means.join(target, list(keys))
    gap = F.round(F.abs(F.col("group_mean") - F.col("target_mean")), 12)
    best = joined.groupBy(*keys).agg(F.min_by(F.struct(*group, "group_mean", "target_mean"), F.struct(gap, *group)).alias("_r"))
    return best.select(*keys, "_r.*")


def split_summary(df: DataFrame, split: str = "period", day: str = "day") -> DataFrame:
    return df.groupBy(split).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"))


def entry_expectancy(df: DataFrame, fwd: str, entry: Column, keys: Sequence[str]) -> DataFrame:
    """Mean and hit rate of the forward return on entries against all bars."""
    on = df.where(F.col(fwd).isNotNull())
    up = (F.col(fwd) > 0).cast("double")
    return on.groupBy(*keys).agg(
        F.count_if(entry).alias("entries"), F.count("*").alias("bars"), F.avg(F.when(entry, F.col(fwd))).alias("mean_on_entry"),
        F.avg(fwd).alias("mean_all"), (F.avg(F.when(entry, F.col(fwd))) - F.avg(fwd)).alias("edge"),
        F.avg(F.when(entry, up)).alias("hit_on_entry"), F.avg(up).alias("hit_all"),
    )


def gross_exposure(positions: DataFrame, accounts: DataFrame, keys: Sequence[str]) -> DataFrame:
    held = positions.groupBy(*keys).agg(F.sum(F.abs("market_value")).alias("gross"))
    ratio = F.when(F.col("equity") > 0, F.coalesce("gross", F.lit(0.0)) / F.col("equity")).otherwise(0.0)
    return accounts.join(held, list(keys), "left").select(*keys, ratio.alias("gross_exposure"))


def equity_change(snapshots: DataFrame, now: Column, keys: Sequence[str]) -> DataFrame:
    """Equity now against a week ago, the start and the first snapshot of today."""
    order = F.struct("created_at", "snapshot_id")
    old = F.col("created_at") <= now - F.expr("INTERVAL 7 DAYS")
    today = F.to_date("created_at") == F.to_date(now)
    found = snapshots.groupBy(*keys).agg(
        F.max_by("equity", order).alias("current"), F.min_by("equity", order).alias("start"),
        F.max_by("equity", F.when(old, order)).alias("week_ago"), F.min_by("equity", F.when(today, order)).alias("day_start"),
    )
    change = lambda ref: F.when(ref > 0, F.col("current") / ref - 1).otherwise(0.0)
    return found.select(
        *keys, "current", change(F.coalesce("week_ago", "start")).alias("week_change"), change(F.col("start")).alias("total_change"),
        (F.when(F.col("day_start") > 0, (F.col("day_start") - F.col("current")) / F.col("day_start") * 10000)).alias("day_loss_bps"),
    )


def slice_rows(df: DataFrame, slices: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """Rows tagged with every named date range they fall into; the ranges are literals, so there is no range join."""
    known = F.array(
        *[F.struct(F.lit(n).alias("slice"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in slices.items()]
    )
    day = F.to_date(F.col(ts))
    hits = F.filter(known, lambda s: (s["a"] <= day) & (day <= s["b"]))
    return df.select("*", F.explode(hits).alias("_s")).select(*df.columns, "_s.slice")
