"""Cross-sectional books and momentum lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barline.functions import ts
from barline.plans.blocks import in_blocks, running


def tail_bars(bars: DataFrame, n: int) -> DataFrame:
    """Last ``n`` bars per symbol, from the position and one count per symbol (no per-symbol sort)."""
    last = bars.groupBy("symbol").agg(F.max("pos").alias("_last"))
    return bars.join(last, "symbol").where(F.col("pos") > F.col("_last") - n).drop("_last")


def momentum_rank(bars: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` symbols with the best positive return over their last ``n`` bars."""
    gain = F.max_by("close", "pos") / F.min_by("close", "pos") - 1
    per_symbol = (
        tail_bars(bars, n).groupBy("symbol").agg(gain.alias("momentum"), F.count("*").alias("_n"))
        .where((F.col("_n") == n) & (F.col("momentum") > 0))
    )
    best = per_symbol.orderBy(F.desc("momentum"), "symbol").limit(k)
    return best.select("symbol", "momentum", F.row_number().over(Window.orderBy(F.desc("momentum"), "symbol")).alias("rank"))


def market_return(returns: DataFrame, ret: str = "ret") -> DataFrame:
    return returns.groupBy("ts").agg(F.avg(ret).alias("mkt"))


def with_simple_return(bars: DataFrame) -> DataFrame:
    return in_blocks(bars, lambda r, w: r.withColumn("ret", ts.simple_return("close", w)), back=1)


def residual_momentum(bars: DataFrame, n: int) -> DataFrame:
    """Rolling sum of returns left over after the rolling beta to the equal-weight market."""
    returns = with_simple_return(bars)
    joined = returns.join(market_return(returns), "ts")

    def residual(rows: DataFrame, w) -> DataFrame:
        var = ts._full(F.var_samp, F.col("mkt"), w, n)
        beta = ts.ts_cov("ret", "mkt", n, w) / F.when(var > 0, var)
        return rows.withColumn("resid", F.col("ret") - beta * F.col("mkt")).withColumn(
            "resid_mom", ts.ts_sum("resid", n, w)
        )

    return in_blocks(joined, residual, back=2 * n)


def topn_book(scores: DataFrame, returns: DataFrame, cal: DataFrame, n: int, every: int, bps: float) -> DataFrame:
    """Equal-weight book of the ``n`` best scores, chosen every ``every`` sessions and earned from the next one.

    ``scores`` (symbol, ts, x), ``returns`` (symbol, ts, ret), ``cal`` (ts, ci). One row per session with the gross
    return, the turnover of that session's rebalance and the net return. No rebalance on the last session.
    """
    book_days = cal.where((F.col("ci") % every == 0) & (F.col("ci") < cal.agg(F.max("ci")).scalar()))
    ranked = scores.where(F.col("x").isNotNull()).join(book_days.select("ts", "ci"), "ts")
    # Two-step top-n: per salt first, so a session with very many symbols is cut down in parallel.
    salted = Window.partitionBy("ci", F.pmod(F.xxhash64("symbol"), F.lit(16))).orderBy(F.desc("x"), "symbol")
    near = ranked.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n)
    full = ranked.groupBy("ci").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("ci")
    picks = (
        near.withColumn("_r", F.row_number().over(Window.partitionBy("ci").orderBy(F.desc("x"), "symbol")))
        .where(F.col("_r") <= n)
        .join(full, "ci", "left_semi")
        .select("ci", "symbol")
    )
    # Held from the session after the rebalance up to and including the next rebalance session.
    held = picks.withColumn("ci", F.explode(F.sequence(F.col("ci") + 1, F.col("ci") + every)))
    days = cal.select("ci", "ts")
    gross = (
        held.join(days, "ci")
        .join(returns.select("symbol", "ts", "ret"), ["symbol", "ts"], "left")
        .groupBy("ci")
        .agg((F.sum(F.coalesce("ret", F.lit(0.0))) / F.lit(n)).alias("gross"))
    )
    change = picks.select("ci", "symbol", F.lit(1.0 / n).alias("w")).unionByName(
        picks.select((F.col("ci") + every).alias("ci"), "symbol", F.lit(-1.0 / n).alias("w"))
    )
    turnover = (
        change.groupBy("ci", "symbol").agg(F.sum("w").alias("w")).groupBy("ci").agg(F.sum(F.abs("w")).alias("turnover"))
    )
    joined = days.join(gross, "ci", "left").join(book_days.select("ci").join(turnover, "ci", "left").select("ci", "turnover"), "ci", "left")
    return joined.select(
        "ts",
        "ci",
        F.coalesce("gross", F.lit(0.0)).alias("gross"),
        F.coalesce("turnover", F.lit(0.0)).alias("turnover"),
        (F.coalesce("gross", F.lit(0.0)) - F.coalesce("turnover", F.lit(0.0)) * F.lit(bps / 10000.0)).alias("net"),
    )


def event_sleeve(events: DataFrame, returns: DataFrame, cal: DataFrame, hold: int, bps: float) -> DataFrame:
    """Hold each event name for ``hold`` sessions after its event, equal weights among the names held."""
    starts = events.join(cal.select("ts", "ci"), "ts")
    active = (
        starts.withColumn("ci", F.explode(F.sequence(F.col("ci") + 1, F.col("ci") + hold)))
        .where(F.col("ci") <= cal.agg(F.max("ci")).scalar())
        .select("symbol", "ci")
        .distinct()
    )
    counts = active.groupBy("ci").agg(F.count("*").alias("n_held"))
    weights = active.join(counts, "ci").select("symbol", "ci", (1.0 / F.col("n_held")).alias("w"))
    days = cal.select("ci", "ts")
    gross = (
        weights.join(days, "ci")
        .join(returns.select("symbol", "ts", "ret"), ["symbol", "ts"], "left")
        .groupBy("ci")
        .agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    )
    moves = weights.unionByName(weights.select("symbol", (F.col("ci") + 1).alias("ci"), (-F.col("w")).alias("w")))
    turnover = (
        moves.groupBy("ci", "symbol").agg(F.sum("w").alias("w")).groupBy("ci").agg(F.sum(F.abs("w")).alias("turnover"))
    )
    joined = days.join(gross, "ci", "left").join(turnover, "ci", "left").join(counts, "ci", "left")
    zero = F.lit(0.0)
    return joined.select(
        "ts",
        "ci",
        F.coalesce("n_held", F.lit(0)).alias("n_held"),
        F.coalesce("gross", zero).alias("gross"),
        F.coalesce("turnover", zero).alias("turnover"),
        (F.coalesce("gross", zero) - F.coalesce("turnover", zero) * F.lit(bps / 10000.0)).alias("net"),
    )


def rebalance(targets: DataFrame, positions: DataFrame) -> DataFrame:
    """Sell held names that are no target, buy targets that are not held."""
    sells = positions.select("symbol").join(targets.select("symbol"), "symbol", "left_anti")
    buys = targets.select("symbol").join(positions.select("symbol"), "symbol", "left_anti")
    return sells.withColumn("side", F.lit("sell")).unionByName(buys.withColumn("side", F.lit("buy")))
