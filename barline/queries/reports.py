"""Metrics, leaderboards, sorts and set operations (G and K family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import ts
from barline.operators import books, metrics, sleeves
from barline.operators.joins import common_keys, only_in, restrict
from barline.operators.news import first_k
from barline.plans.blocks import in_blocks
from barline.plans.ranks import quantiles
from barline.queries import fixtures as fx
from barline.queries.registry import query, view
from barline.queries.tables import r6, r12
from barline.queries.timeseries import momentum_signal
from barline.session import cut

view("mkt_r", "bars_r", "SELECT b.*, m.mkt FROM bars_r b JOIN (SELECT ts, avg(ret) AS mkt FROM bars_r GROUP BY ts) m USING (ts)")
view("curve", "bars_r", """
SELECT symbol, ts, pos, ret, equity, peak, equity / peak - 1 AS drawdown FROM (
  SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY pos) AS peak FROM (
    SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY pos) AS equity FROM bars_r WHERE ret IS NOT NULL))""")

_METRICS_SQL = """SELECT symbol, round(tot, 6) AS total_return, round(cagr, 6) AS cagr, round(sd * sqrt(252), 6) AS ann_vol,
  round(CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END, 4) AS sharpe, round(dd, 6) AS max_drawdown, round(CASE WHEN dd < 0 THEN cagr / abs(dd) ELSE 0 END, 4) AS calmar, days
FROM (SELECT *, CASE WHEN tot > -1 THEN pow(1 + tot, 252.0::DOUBLE / days) - 1 ELSE -1 END AS cagr FROM (
  SELECT symbol, product(1 + ret) - 1 AS tot, stddev_pop(ret) AS sd, avg(ret) AS m, min(drawdown) AS dd, count(*) AS days FROM curve GROUP BY symbol))"""


def metric_columns(df, *keys):
    six, four = ("total_return", "cagr", "ann_vol", "max_drawdown"), ("sharpe", "calmar")
    return df.select(*keys, *r6(*six), *[F.round(c, 4).alias(c) for c in four], "days")


@query("return_metrics", "curve", _METRICS_SQL)
def return_metrics(spark, d):
    rows = cut(books.with_simple_return(fx.bars(spark, d)))
    return metric_columns(metrics.return_metrics(rows, ["symbol"]), "symbol")


@query("equity_drawdown", "curve", "SELECT symbol, ts, round(equity, 6) AS equity, round(peak, 6) AS peak, round(drawdown, 6) AS drawdown FROM curve")
def equity_drawdown(spark, d):
    out = metrics.equity_curve(books.with_simple_return(fx.bars(spark, d)))
    return out.select("symbol", "ts", *r6("equity", "peak", "drawdown"))


@query("volatilities", "bars_r", """
SELECT symbol, round(sqrt(avg(ret * ret)) * sqrt(252), 6) AS rms_vol, round(stddev_pop(ret) * sqrt(252), 6) AS pop_vol, round(stddev_samp(ret) * sqrt(252), 6) AS samp_vol
FROM bars_r GROUP BY symbol""")
def volatilities(spark, d):
    out = metrics.volatilities(books.with_simple_return(fx.bars(spark, d)), ["symbol"])
    return out.select("symbol", *r6("rms_vol", "pop_vol", "samp_vol"))


@query("beta_alpha", "mkt_r", """
SELECT symbol, round(CASE WHEN n > 30 THEN b END, 6) AS beta, round(CASE WHEN n > 30 THEN (r - b * m) * 252 END, 6) AS alpha, n AS days FROM (
  SELECT symbol, covar_samp(ret, mkt) / var_samp(mkt) AS b, avg(ret) AS r, avg(mkt) AS m, count(*) AS n FROM mkt_r WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY symbol)""")
def beta_alpha(spark, d):
    rows = cut(books.with_simple_return(fx.bars(spark, d)))
    out = metrics.beta_alpha(rows.join(books.market_return(rows), "ts"), ["symbol"])
    return out.select("symbol", *r6("beta", "alpha"), "days")


# Trades of the momentum rule: islands of signal = 1.
view("book_tr", "sig", """
SELECT symbol, min(ts) AS entry_ts, arg_min(close, pos) AS entry_price, arg_max(nts, pos) AS exit_ts, arg_max(nx, pos) AS exit_price,
  CASE WHEN max(CASE WHEN nx IS NULL THEN pos END) = max(pos) THEN NULL ELSE arg_max(nx, pos) END AS closed_price, arg_max(close, pos) AS last_price, 500.0::DOUBLE / arg_min(close, pos) AS qty FROM (
  SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY pos) AS island FROM (
    SELECT *, CASE WHEN signal IS DISTINCT FROM lag(signal) OVER (PARTITION BY symbol ORDER BY pos) THEN 1 ELSE 0 END AS chg,
      lead(close) OVER (PARTITION BY symbol ORDER BY pos) AS nx, lead(ts) OVER (PARTITION BY symbol ORDER BY pos) AS nts FROM sig))
WHERE signal = 1 GROUP BY symbol, island""")


def book_trades(spark, d):
    return sleeves.book_trades(cut(momentum_signal(spark, d)), F.lit(500.0))


@query("trade_metrics", "book_tr", """
SELECT symbol, trades, round(win_rate, 6) AS win_rate, round(pf, 6) AS profit_factor, round(tot, 6) AS total_return,
  round(tot + win_rate * 0.1 + least(pf, 3) * 0.02, 6) AS score FROM (
  SELECT symbol, count(*) AS trades, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, product(1 + r) - 1 AS tot,
    CASE WHEN abs(sum(r) FILTER (r < 0)) > 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / abs(sum(r) FILTER (r < 0)) ELSE count(*) FILTER (r > 0) END AS pf
  FROM (SELECT symbol, closed_price / entry_price - 1 AS r FROM book_tr WHERE closed_price IS NOT NULL) GROUP BY symbol)""")
def trade_metrics(spark, d):
    trades = book_trades(spark, d).withColumn("trade_ret", F.col("exit_price") / F.col("entry_price") - 1)
    out = metrics.trade_metrics(trades, ["symbol"])
    score = metrics.composite_score(F.col("total_return"), F.lit(0.0), F.col("win_rate"), F.col("profit_factor"))
    return out.withColumn("score", score).select("symbol", "trades", *r6("win_rate", "profit_factor", "total_return", "score"))


@query("window_aggs", "runs", """
SELECT strategy, cost_profile, count(*) AS windows, round(avg(total_return), 12) AS mean_total_return, round(median(total_return), 12) AS median_total_return, round(avg(sharpe), 12) AS mean_sharpe,
  round(min(max_drawdown), 12) AS worst_max_drawdown, round(avg(CASE WHEN total_return > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS profitable_fraction
FROM runs WHERE NOT starts_with(window_name, 'full') GROUP BY 1, 2""")
def window_aggs(spark, d):
    out = metrics.window_aggregates(fx.runs(spark, d), ["strategy", "cost_profile"])
    return out.select(
        "strategy", "cost_profile", "windows", *r12("mean_total_return", "median_total_return", "worst_max_drawdown"),
        F.round("mean_sharpe", 12).alias("mean_sharpe"), F.round("profitable_fraction", 4).alias("profitable_fraction"),
    )


view("latest", "runs", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol, strategy, window_name ORDER BY created_at DESC, run_id DESC) AS lr FROM runs) WHERE lr = 1")
view("board", "latest", """
SELECT market, symbol, strategy, string_agg(DISTINCT window_name, ',' ORDER BY window_name) AS windows, count(*) AS nw, count(*) FILTER (total_return > 0) AS profitable_windows, avg(total_return) AS avg_total_return, avg(max_drawdown) AS avg_max_drawdown,
  avg(win_rate) AS avg_win_rate, avg(coalesce(profit_factor, 0)) AS avg_profit_factor, avg(coalesce(annualized_return, 0)) AS avg_annualized_return, avg(score) AS avg_score, avg(score) + count(*) FILTER (total_return > 0) / count(*) * 0.1 AS composite_score, max(total_return) AS best_window_return, min(total_return) AS worst_window_return
FROM latest GROUP BY 1, 2, 3""")
_BOARD = ("avg_total_return", "avg_max_drawdown", "avg_win_rate", "avg_profit_factor", "avg_annualized_return", "avg_score", "composite_score", "best_window_return", "worst_window_return")


@query("leaderboard", "board", "SELECT market, symbol, strategy, windows, profitable_windows, " + ", ".join(f"round({c}, 12) AS {c}" for c in _BOARD) + " FROM board")
def leaderboard(spark, d):
    out = metrics.leaderboard(fx.runs(spark, d)).orderBy(F.desc("composite_score"), "market", "symbol", "strategy")
    return out.select("market", "symbol", "strategy", "windows", "profitable_windows", *r12(*_BOARD))


_PARAMS = ["strategy", "window_name", "market", "cost_profile"]


@query("param_marginals", "runs", " UNION ALL ".join(
    f"SELECT '{p}' AS param, {p} AS value, round(avg(total_return), 12) AS avg_total_return, round(avg(max_drawdown), 12) AS avg_max_drawdown, round(avg(score), 12) AS avg_score, count(*) AS runs FROM runs GROUP BY {p}"
    for p in _PARAMS))
def param_marginals(spark, d):
    out = metrics.param_marginals(fx.runs(spark, d), _PARAMS)
    return out.select("param", "value", *r12("avg_total_return", "avg_max_drawdown", "avg_score"), "runs")


@query("best_variant", "runs", """
SELECT symbol, strategy, round(avg_score, 12) AS avg_score, round(avg_total_return, 12) AS avg_total_return FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(avg_score, 12) DESC, strategy DESC) AS r FROM (
    SELECT symbol, strategy, avg(score) AS avg_score, avg(total_return) AS avg_total_return FROM runs GROUP BY 1, 2)) WHERE r = 1""")
def best_variant(spark, d):
    means = fx.runs(spark, d).groupBy("symbol", "strategy").agg(F.avg("score").alias("avg_score"), F.avg("total_return").alias("avg_total_return"))
    out = metrics.best_per(means, ["symbol"], [F.round("avg_score", 12), "strategy"])
    return out.select("symbol", "strategy", *r12("avg_score", "avg_total_return"))


@query("report_score", "board", """
WITH s AS (SELECT *, round(avg_total_return + avg_max_drawdown * 0.5 + profitable_windows / nw * 0.1 + least(avg_profit_factor, 3) * 0.02, 12) AS report_score FROM board)
SELECT market, symbol, strategy, report_score FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY report_score DESC, symbol DESC, strategy DESC) AS r FROM s) WHERE r = 1""")
def report_score(spark, d):
    """Report score per leaderboard row and the leader of each branch (here: market)."""
    board = metrics.leaderboard(fx.runs(spark, d)).withColumn("total_windows", F.size(F.split("windows", ",")))
    scored = metrics.report_score(board).withColumn("report_score", F.round("report_score", 12))
    return metrics.best_per(scored, ["market"], ["report_score", "symbol", "strategy"]).select("market", "symbol", "strategy", "report_score")


@query("compare_means", "runs", """
WITH s AS (SELECT symbol, avg(total_return) FILTER (cost_profile = 'F') AS a, avg(total_return) FILTER (cost_profile = 'O') AS b FROM runs GROUP BY symbol)
SELECT round(avg(a), 12) AS mean_a, round(avg(b), 12) AS mean_b, round(avg(a) - avg(b), 12) AS delta, count(*) FILTER (a > b) AS a_wins, count(*) AS n FROM s""")
def compare_means(spark, d):
    side = lambda p: F.avg(F.when(F.col("cost_profile") == p, F.col("total_return")))
    rows = fx.runs(spark, d).groupBy("symbol").agg(side("F").alias("a"), side("O").alias("b"))
    out = metrics.compare_means(rows, "a", "b")
    return out.select(*r12("mean_a", "mean_b", "delta"), "a_wins", "n")


@query("nearest_group", "runs", """
WITH t AS (SELECT symbol, round(avg(total_return), 9) AS target FROM runs GROUP BY symbol),
g AS (SELECT symbol, strategy, cost_profile, avg(total_return) AS m FROM runs GROUP BY 1, 2, 3)
SELECT symbol, strategy, cost_profile, round(m, 6) AS group_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(m - target), 12), strategy, cost_profile) AS r FROM g JOIN t USING (symbol)) WHERE r = 1""")
def nearest_group(spark, d):
    runs = fx.runs(spark, d)
    target = runs.groupBy("symbol").agg(F.round(F.avg("total_return"), 9).alias("target_mean"))
    out = metrics.nearest_group(runs, ["symbol"], ["strategy", "cost_profile"], target)
    return out.select("symbol", "strategy", "cost_profile", F.round("group_mean", 6).alias("group_mean"))


view("splits", "cal", """SELECT day, ci, CASE WHEN ci < floor(0.6::DOUBLE * n) THEN 'train' WHEN ci < floor(0.8::DOUBLE * n) THEN 'validation' ELSE 'test' END AS period FROM cal, (SELECT count(*) AS n FROM cal)""")


def splits(spark, d):
    from barline.operators.labels import period_of

    return period_of(fx.cal(spark, d))


@query("split_summary", "splits", "SELECT period, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM splits GROUP BY period")
def split_summary(spark, d):
    return metrics.split_summary(splits(spark, d))


@query("entry_rate", "preds", """SELECT symbol, round(avg(CASE WHEN direction = 'bullish' AND strength IN ('medium', 'high') THEN 1.0::DOUBLE ELSE 0 END), 6) AS entry_rate FROM preds GROUP BY symbol""")
def entry_rate(spark, d):
    go = sleeves.is_long(F.col("direction"), F.col("strength"), F.col("relative"))
    return fx.preds(spark, d).groupBy("symbol").agg(F.round(F.avg(go.cast("double")), 6).alias("entry_rate"))


@query("entry_expectancy", "bars_h preds", """
WITH f AS (SELECT b.symbol, lead(close, 5) OVER (PARTITION BY b.symbol ORDER BY pos) / close - 1 AS fwd, direction = 'bullish' AND strength IN ('medium', 'high') AS go
  FROM bars_h b JOIN preds p USING (symbol, ts))
SELECT symbol, count(*) FILTER (go) AS entries, count(*) AS bars, round(avg(fwd) FILTER (go), 6) AS mean_on_entry, round(avg(fwd), 6) AS mean_all, round(avg(fwd) FILTER (go) - avg(fwd), 6) AS edge,
  round(avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (go), 6) AS hit_on_entry, round(avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_all
FROM f WHERE fwd IS NOT NULL GROUP BY symbol""")
def entry_expectancy(spark, d):
    bars = in_blocks(fx.bars_h(spark, d), lambda r, w: r.withColumn("fwd", ts.forward_return("close", 5, w)), fwd=5)
    # The prediction of a bar comes from the bar itself here, so no join is needed.
    rows = fx.preds_of(bars.select("*")).select("symbol", "ts", "direction", "strength", "relative")
    joined = bars.select("symbol", "ts", "fwd").join(rows, ["symbol", "ts"])
    out = metrics.entry_expectancy(joined, "fwd", sleeves.is_long(F.col("direction"), F.col("strength"), F.col("relative")), ["symbol"])
    return out.select("symbol", "entries", "bars", *r6("mean_on_entry", "mean_all", "edge", "hit_on_entry", "hit_all"))


@query("median_dollar_vol", "bars", "SELECT symbol, round(median(close * volume), 4) AS median_dollar_volume FROM bars GROUP BY symbol")
def median_dollar_vol(spark, d):
    rows = fx.bars(spark, d).select("symbol", (F.col("close") * F.col("volume")).alias("dv"))
    return quantiles(rows, ["symbol"], "dv", {"m": 0.5}).select("symbol", F.round("m", 4).alias("median_dollar_volume"))


@query("gross_exposure", "", """
SELECT c_custkey AS account, round(CASE WHEN c_acctbal > 0 THEN coalesce(g, 0) / c_acctbal ELSE 0 END, 4) AS gross_exposure
FROM customer LEFT JOIN (SELECT o_custkey, sum(abs(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END)) AS g FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def gross_exposure(spark, d):
    """Orders as positions of a customer account: filled ones are short."""
    value = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    positions = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("account"), value.alias("market_value"))
    accounts = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("equity"))
    out = metrics.gross_exposure(positions, accounts, ["account"])
    return out.select("account", F.round("gross_exposure", 4).alias("gross_exposure"))


@query("equity_change", "", """
WITH n AS (SELECT max(ts) AS now FROM events),
c AS (SELECT 'U' || user_id AS symbol, arg_max(value, (ts, event_id)) AS cur, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) FILTER (ts <= now - INTERVAL 7 DAY) AS week,
  arg_min(value, (ts, event_id)) FILTER (ts::DATE = now::DATE) AS day FROM events, n GROUP BY 1)
SELECT symbol, round(cur, 6) AS current, round(CASE WHEN coalesce(week, first) > 0 THEN cur / coalesce(week, first) - 1 ELSE 0 END, 6) AS week_change,
  round(CASE WHEN first > 0 THEN cur / first - 1 ELSE 0 END, 6) AS total_change, round(CASE WHEN day > 0 THEN (day - cur) / day * 10000 END, 4) AS day_loss_bps FROM c""")
def equity_change(spark, d):
    events = fx.table(spark, d, "events")
    snaps = events.withColumn("now", events.agg(F.max("ts")).scalar()).select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("ts").alias("created_at"), F.col("event_id").alias("snapshot_id"),
        F.col("value").alias("equity"), "now",
    )
    out = metrics.equity_change(snaps, F.col("now"), ["symbol"])
    return out.select("symbol", *r6("current", "week_change", "total_change"), F.round("day_loss_bps", 4).alias("day_loss_bps"))


# ---- sorts, limits, set operations


@query("latest_per_key", "latest", "SELECT market, symbol, strategy, window_name, run_id, round(score, 6) AS score FROM latest")
def latest_per_key(spark, d):
    return metrics.latest_runs(fx.runs(spark, d)).select("market", "symbol", "strategy", "window_name", "run_id", F.round("score", 6).alias("score"))


@query("newest_runs", "runs", "SELECT run_id, created_at, round(score, 6) AS score FROM runs WHERE market = 'BUILDING' ORDER BY created_at DESC, run_id DESC LIMIT 200")
def newest_runs(spark, d):
    """The newest 200 runs of a market; the limit is the feature."""
    out = fx.runs(spark, d).where("market = 'BUILDING'").orderBy(F.desc("created_at"), F.desc("run_id")).limit(200)
    return out.select("run_id", "created_at", F.round("score", 6).alias("score"))


@query("topk", "bars_r", "SELECT ts, symbol, round(ret, 6) AS ret, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol) AS r FROM bars_r WHERE ret IS NOT NULL) WHERE r <= 5")
def topk(spark, d):
    """Five best returns of every week."""
    rows = books.with_simple_return(fx.bars(spark, d)).where("ret IS NOT NULL").withColumn("_down", -F.col("ret"))
    out = first_k(rows, ["ts"], ["_down", "symbol"], 5)
    return out.select("ts", "symbol", F.round("ret", 6).alias("ret"), F.col("_r").alias("rank"))


@query("union_runs", "runs", """
SELECT run_id, strategy, 'filled' AS branch, round(score, 6) AS score, NULL::DOUBLE AS sharpe FROM runs WHERE cost_profile = 'F'
UNION ALL SELECT run_id, strategy, 'open', round(score, 6), round(sharpe, 6) FROM runs WHERE cost_profile <> 'F'""")
def union_runs(spark, d):
    runs = fx.runs(spark, d)
    filled = runs.where("cost_profile = 'F'").select("run_id", "strategy", F.lit("filled").alias("branch"), F.round("score", 6).alias("score"))
    other = runs.where("cost_profile <> 'F'").select("run_id", "strategy", F.lit("open").alias("branch"), *r6("score", "sharpe"))
    return filled.unionByName(other, allowMissingColumns=True)


@query("common_keys", "bars idx", """
SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts FROM idx
INTERSECT SELECT r_name, ts FROM bars JOIN supplier ON symbol = 'S' || s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def common(spark, d):
    """Weeks of every region in which its index and a bar of one of its suppliers exist."""
    index = fx.idx(spark, d).select("symbol", F.date_trunc("week", "ts").alias("ts"))
    regions = fx.suppliers(spark, d).select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("supplier"), "r_name")
    weeks = fx.bars(spark, d).join(regions, F.col("symbol") == F.col("supplier")).select(F.col("r_name").alias("symbol"), "ts")
    return common_keys(index, weeks, ["symbol", "ts"])


@query("new_keys", "bars idx", """
SELECT 'S' || s_suppkey AS symbol, date_trunc('week', i.ts)::TIMESTAMP AS ts FROM idx i JOIN region ON i.symbol = r_name JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
EXCEPT SELECT symbol, ts FROM bars""")
def new_keys(spark, d):
    """Weeks in which the index of a supplier's region has a value and the supplier has no bar."""
    weeks = fx.idx(spark, d).select(F.col("symbol").alias("r_name"), F.date_trunc("week", "ts").alias("ts")).distinct()
    due = fx.suppliers(spark, d).select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), "r_name").join(weeks, "r_name")
    return only_in(due, fx.bars(spark, d), ["symbol", "ts"])


@query("restricted_runs", "runs", "SELECT run_id, symbol, strategy, round(score, 6) AS score FROM runs WHERE (symbol, strategy) IN (SELECT symbol, strategy FROM runs GROUP BY 1, 2 HAVING sum(trades) % 2 = 0)")
def restricted_runs(spark, d):
    """Runs of the (symbol, strategy) pairs that hold an even number of trades."""
    runs = fx.runs(spark, d)
    even = runs.groupBy("symbol", "strategy").agg(F.sum("trades").alias("n")).where("n % 2 = 0")
    return restrict(runs, even, ["symbol", "strategy"]).select("run_id", "symbol", "strategy", F.round("score", 6).alias("score"))
