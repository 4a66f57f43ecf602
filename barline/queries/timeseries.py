"""Rolling operators per symbol (T family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import ts
from barline.plans.arrays import in_arrays
from barline.plans.blocks import in_blocks, running
from barline.plans.ranks import expanding_quantile
from barline.queries import fixtures as fx
from barline.queries.registry import query, view

view(
    "bars_r",
    "bars",
    """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS ret, (high + low + close) / 3 AS vwap,
  lead(close, 1) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS fwd1,
  lead(close, 5) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS fwd5 FROM bars""",
)


def with_returns(rows: DataFrame, w) -> DataFrame:
    """Typical price and simple return; needs one row of reach back."""
    return rows.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn(
        "ret", ts.simple_return("close", w)
    )


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY pos ROWS {n - 1} PRECEDING)"


def _full(agg: str, x: str, n: int, y: str | None = None) -> str:
    f = _frame(n)
    counted = x if y is None else f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    call = f"{agg}({x})" if y is None else f"{agg}({x}, {y})"
    return f"CASE WHEN count({counted}) OVER {f} = {n} THEN {call} OVER {f} END"


def _rank_sql(x: str, n: int, need: int) -> str:
    a = f"list({x}) FILTER ({x} IS NOT NULL) OVER {_frame(n)}"
    return f"""SELECT symbol, ts, round(CASE WHEN v IS NOT NULL AND len(a) >= {need} THEN
  (len(list_filter(a, lambda e: e < v)) + (len(list_filter(a, lambda e: e = v)) + 1) / 2.0) / len(a) END, 6) AS value
FROM (SELECT symbol, ts, {x} AS v, {a} AS a FROM bars_r)"""


_PREV = "OVER (PARTITION BY symbol ORDER BY pos)"
_DECAY = " + ".join(f"lag(ret, {i}) {_PREV} * {10 - i}" for i in range(1, 10))

# name -> (Spark expression of the block window, rows of reach back, SQL expression)
ROLLING = {
    "ts_mean": (lambda w: ts.ts_mean("ret", 20, w), 20, _full("avg", "ret", 20)),
    "ts_std": (lambda w: ts.ts_std("ret", 20, w), 20, _full("stddev_samp", "ret", 20)),
    "ts_min": (lambda w: ts.ts_min("low", 20, w), 20, _full("min", "low", 20)),
    "ts_max": (lambda w: ts.ts_max("high", 20, w), 20, _full("max", "high", 20)),
    "ts_sum": (lambda w: ts.ts_sum("ret", 5, w), 6, _full("sum", "ret", 5)),
    "ts_delta": (lambda w: ts.delta("close", 5, w), 5, f"close - lag(close, 5) {_PREV}"),
    "ts_delay": (lambda w: ts.delay("close", 5, w), 5, f"lag(close, 5) {_PREV}"),
    "decay_linear": (lambda w: ts.decay_linear("ret", 10, w), 10, f"(ret * 10 + {_DECAY}) / 55"),
    "ts_corr": (
        lambda w: ts.ts_corr("close", "volume", 10, w),
        10,
        f"CASE WHEN min(close) OVER {_frame(10)} < max(close) OVER {_frame(10)} AND min(volume) OVER {_frame(10)} < max(volume) OVER {_frame(10)} "
        f"THEN {_full('corr', 'close', 10, 'volume')} END",
    ),
    "ts_cov": (lambda w: ts.ts_cov("ret", "volume", 10, w), 11, _full("covar_samp", "ret", 10, "volume")),
    "realized_var": (lambda w: ts.realized_variance("ret", 21, w), 22, _full("avg", "ret * ret", 21) + " * 252"),
    "mean_partial": (lambda w: ts.mean_partial("close", 10, w), 10, f"avg(close) OVER {_frame(10)}"),
}


def _rolling_query(name: str, expr, back: int, sql: str) -> None:
    @query(name, "bars_r", f"SELECT symbol, ts, round(value, 6) AS value FROM (SELECT symbol, ts, {sql} AS value FROM bars_r)")
    def run(spark, d):
        out = in_blocks(
            fx.bars(spark, d), lambda rows, w: with_returns(rows, w).withColumn("value", expr(w)), back=back
        )
        return out.select("symbol", "ts", F.round("value", 6).alias("value"))


for _name, (_expr, _back, _sql) in ROLLING.items():
    _rolling_query(_name, _expr, _back, _sql)


@query("ts_rank", "bars_r", _rank_sql("close", 20, 20))
def ts_rank(spark, d):
    out = in_arrays(fx.bars(spark, d).select("symbol", "ts", "pos", "close"), lambda s: {"value": s["close"].percentile(20, 20)}, ["close"], ["value"], back=19)
    return out.select("symbol", "ts", F.round("value", 6).alias("value"))


@query("rolling_pct", "bars_r", _rank_sql("close", 252, 63))
def rolling_pct(spark, d):
    out = in_arrays(fx.bars(spark, d).select("symbol", "ts", "pos", "close"), lambda s: {"value": s["close"].percentile(252, 63)}, ["close"], ["value"], back=251)
    return out.select("symbol", "ts", F.round("value", 6).alias("value"))


# Which region's series plays which index in the panel.
PANEL = {"AFRICA": "vix", "AMERICA": "vix9d", "ASIA": "vix3m", "EUROPE": "vix6m", "MIDDLE EAST": "vvix"}
view(
    "panel",
    "idx",
    "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT ts, "
    + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {c}" for s, c in PANEL.items())
    + " FROM idx GROUP BY ts)",
)


def panel(spark, d) -> DataFrame:
    """Several named series side by side, one row per day (an outer join by construction)."""
    from barline.plans.blocks import number_rows

    wide = fx.idx(spark, d).groupBy("ts").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(c) for s, c in PANEL.items()]
    )
    return number_rows(wide, [], ["ts"])


@query(
    "vol_signals",
    "panel",
    """
SELECT ts, round(vix3m / vix - 1, 6) AS slope_3m, round(vix / vix9d - 1, 6) AS slope_9d, round(vix6m / vix - 1, 6) AS slope_6m,
  round(vix / lag(vix, 5) OVER (ORDER BY pos) - 1, 6) AS trend_5d, round((vix / 100) * (vix / 100), 6) AS implied_variance,
  round(sqrt(CASE WHEN count(r) OVER (ORDER BY pos ROWS 20 PRECEDING) = 21 THEN avg(r * r) OVER (ORDER BY pos ROWS 20 PRECEDING) * 252 END), 6) AS realized_vol
FROM (SELECT *, vvix / lag(vvix) OVER (ORDER BY pos) - 1 AS r FROM panel)""",
)
def vol_signals(spark, d):
    def signals(rows, w):
        return (
            rows.withColumn("r", ts.simple_return("vvix", w))
            .withColumn("trend_5d", ts.simple_return("vix", w, 5))
            .withColumn("realized_vol", F.sqrt(ts.realized_variance("r", 21, w)))
        )

    out = in_blocks(panel(spark, d), signals, back=22, keys=[])
    return out.select(
        "ts",
        F.round(F.col("vix3m") / F.col("vix") - 1, 6).alias("slope_3m"),
        F.round(F.col("vix") / F.col("vix9d") - 1, 6).alias("slope_9d"),
        F.round(F.col("vix6m") / F.col("vix") - 1, 6).alias("slope_6m"),
        F.round("trend_5d", 6).alias("trend_5d"),
        F.round((F.col("vix") / 100) * (F.col("vix") / 100), 6).alias("implied_variance"),
        F.round("realized_vol", 6).alias("realized_vol"),
    )


@query(
    "crossings",
    "bars",
    """SELECT symbol, ts, round(close, 6) AS close FROM (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM bars) WHERE close >= 112 AND before < 112""",
)
def crossings(spark, d):
    out = in_blocks(fx.bars(spark, d), lambda r, w: r.withColumn("hit", ts.crossing("close", 112.0, w)), back=1)
    return out.where("hit").select("symbol", "ts", F.round("close", 6).alias("close"))


@query(
    "ffill_limit",
    "bars",
    """SELECT symbol, ts, round(value, 6) AS value FROM (SELECT symbol, ts,
  last_value(CASE WHEN high > low THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS 5 PRECEDING) AS value FROM bars)""",
)
def ffill_limit(spark, d):
    """A bar without a range counts as missing and is filled from at most five rows back."""
    missing = F.when(F.col("high") > F.col("low"), F.col("close"))
    out = in_blocks(
        fx.bars(spark, d).withColumn("x", missing), lambda r, w: r.withColumn("value", ts.ffill("x", 5, w)), back=5
    )
    return out.select("symbol", "ts", F.round("value", 6).alias("value"))


@query(
    "rule_signals",
    "bars",
    """
SELECT symbol, ts, signal_type, CASE WHEN pos < 10 THEN 0
    WHEN signal_type = 'momentum' AND close >= avg10 * (1 + 0.005::DOUBLE) THEN 1
    WHEN signal_type = 'mean_reversion' AND close <= avg10 * (1 - 0.005::DOUBLE) THEN 1
    WHEN signal_type = 'breakout' AND close >= top9 THEN 1
    WHEN signal_type = 'breakdown_exit' AND close > low9 THEN 1 ELSE 0 END AS signal,
  round(CASE WHEN pos < 10 THEN NULL WHEN signal_type = 'momentum' THEN close / avg10 - 1
    WHEN signal_type = 'mean_reversion' THEN (avg10 - close) / avg10 WHEN signal_type = 'breakout' THEN close / top9 - 1 END, 6) AS indicator
FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) AS avg10,
   max(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS top9,
   min(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS low9 FROM bars)
  CROSS JOIN (VALUES ('momentum'), ('mean_reversion'), ('breakout'), ('breakdown_exit')) t(signal_type)""",
)
def rule_signals(spark, d):
    from barline.operators.trades import rule_signal

    rules = [(s, 10, 0.005) for s in ("momentum", "mean_reversion", "breakout", "breakdown_exit")]
    out = rule_signal(fx.bars(spark, d), rules)
    return out.select("symbol", "ts", "signal_type", "signal", F.round("indicator", 6).alias("indicator"))


view(
    "sig",
    "bars",
    """SELECT *, CASE WHEN pos >= 10 AND close >= avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) * (1 + 0.005::DOUBLE) THEN 1 ELSE 0 END AS signal
  FROM bars""",
)


def momentum_signal(spark, d) -> DataFrame:
    from barline.operators.trades import rule_signal

    return rule_signal(fx.bars(spark, d), [("momentum", 10, 0.005)]).drop("signal_type", "indicator")


@query(
    "momentum_shift",
    "sig",
    """SELECT symbol, ts FROM (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM sig) WHERE before = 0 AND signal = 1""",
)
def momentum_shift(spark, d):
    out = in_blocks(
        momentum_signal(spark, d), lambda r, w: r.withColumn("before", F.lag("signal").over(w)), back=1
    )
    return out.where("before = 0 AND signal = 1").select("symbol", "ts")


@query(
    "momentum_topk",
    "bars",
    """
SELECT symbol, round(mom, 6) AS momentum, rank FROM (SELECT *, row_number() OVER (ORDER BY mom DESC, symbol) AS rank FROM (
  SELECT symbol, arg_max(close, pos) / arg_min(close, pos) - 1 AS mom FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 20
  GROUP BY symbol HAVING count(*) = 20) WHERE mom > 0) WHERE rank <= 10""",
)
def momentum_topk(spark, d):
    from barline.operators.books import momentum_rank

    return momentum_rank(fx.bars(spark, d), 20, 10).select("symbol", F.round("momentum", 6).alias("momentum"), "rank")


@query(
    "resid_momentum",
    "bars_r",
    f"""
m AS (SELECT ts, avg(ret) AS mkt FROM bars_r GROUP BY ts),
b AS (SELECT bars_r.*, mkt FROM bars_r JOIN m USING (ts)),
v AS (SELECT *, {_full('covar_samp', 'ret', 20, 'mkt')} AS cv, {_full('var_samp', 'mkt', 20)} AS vr FROM b),
r AS (SELECT *, ret - CASE WHEN vr > 0 THEN cv / vr END * mkt AS resid FROM v)
SELECT symbol, ts, round(x, 6) AS resid_mom FROM (SELECT symbol, ts, {_full('sum', 'resid', 20)} AS x FROM r)""".replace("\nm AS", "WITH m AS", 1),
)
def resid_momentum(spark, d):
    from barline.operators.books import residual_momentum

    out = residual_momentum(fx.bars(spark, d), 20)
    return out.select("symbol", "ts", F.round("resid_mom", 6).alias("resid_mom"))


@query(
    "expanding_q90",
    "bars",
    """
WITH g AS (SELECT symbol, ts, open / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS gap FROM bars),
n AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS seq FROM g WHERE gap IS NOT NULL)
SELECT symbol, ts, round(gap, 6) AS gap, round(CASE WHEN seq >= 200 THEN quantile_cont(gap, 0.9) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 6) AS threshold
FROM n""",
)
def expanding_q90(spark, d):
    gaps = gap_events(spark, d)
    out = expanding_quantile(gaps, "gap", 0.9, pos="seq", min_n=200)
    return out.select("symbol", "ts", F.round("gap", 6).alias("gap"), F.round("threshold", 6).alias("threshold"))


def gap_events(spark, d) -> DataFrame:
    """Opening gaps of all symbols in one global order."""
    from barline.plans.blocks import number_rows

    gaps = in_blocks(
        fx.bars(spark, d), lambda r, w: r.withColumn("gap", F.col("open") / F.lag("close").over(w) - 1), back=1
    ).where(F.col("gap").isNotNull())
    return number_rows(gaps, [], ["ts", "symbol"], pos="seq")


@query(
    "lagged_sentiment",
    "sent_days",
    """
SELECT symbol, day, round(coalesce(avg(score) OVER f, 0), 6) AS lagged,
  coalesce(avg(CASE WHEN label = 'neutral' OR abs(score) <= 0.2 THEN 1.0 ELSE 0.0 END) OVER f >= 0.6::DOUBLE, false) AS weak_cluster
FROM sent_days WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def lagged_sentiment(spark, d):
    from barline.operators.news import lagged_sentiment as op

    out = op(sentiment_days(spark, d), 3, weak=0.2, share=0.6)
    return out.select("symbol", "day", F.round("lagged", 6).alias("lagged"), "weak_cluster")


view(
    "sent_days",
    "scores bars_h",
    """SELECT d.symbol, d.day, coalesce(score, 0.0) AS score, coalesce(label, 'neutral') AS label, score IS NOT NULL AS scored,
  row_number() OVER (PARTITION BY d.symbol ORDER BY d.day) - 1 AS pos
  FROM (SELECT DISTINCT symbol, ts::DATE AS day FROM bars_h) d LEFT JOIN scores s ON s.symbol = d.symbol AND s.day = d.day""",
)


def sentiment_days(spark, d) -> DataFrame:
    """Every (symbol, day) with a bar; days without a score read 0 and neutral."""
    from barline.plans.blocks import number_rows

    days = fx.table(spark, d, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.to_date("ts").alias("day")
    ).distinct()
    both = days.join(fx.scores(spark, d), ["symbol", "day"], "left").select(
        "symbol",
        "day",
        F.col("score").isNotNull().alias("scored"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("label", F.lit("neutral")).alias("label"),
    )
    return number_rows(both, ["symbol"], ["day"])


@query(
    "carry_sentiment",
    "sent_days",
    """
WITH walk AS (
  SELECT symbol, pos, day, scored, CASE WHEN scored THEN score ELSE 0.0 END AS score,
    CASE WHEN scored AND score <> 0 THEN [score] ELSE []::DOUBLE[] END AS mem,
    CASE WHEN scored THEN label ELSE 'neutral' END AS label
  FROM sent_days WHERE pos = 0
  UNION ALL
  SELECT symbol, pos, day, scored, s, list_slice(CASE WHEN s <> 0 THEN list_prepend(s, mem) ELSE mem END, 1, 3),
    CASE WHEN scored THEN label WHEN abs(c) < 0.25 THEN 'neutral' WHEN c > 0 THEN 'bullish' ELSE 'bearish' END
  FROM (SELECT n.symbol, n.pos, n.day, n.scored, n.label, w.mem, c,
      CASE WHEN n.scored THEN n.score ELSE round(greatest(-1.0, least(1.0, c)), 6) END AS s
    FROM (SELECT *, coalesce(mem[1], 0) + 0.6::DOUBLE * coalesce(mem[2], 0) + (0.6::DOUBLE * 0.6::DOUBLE) * coalesce(mem[3], 0) AS c FROM walk) w
    JOIN sent_days n ON n.symbol = w.symbol AND n.pos = w.pos + 1))
SELECT symbol, day, scored, round(score, 6) AS score, label FROM walk""",
    recursive=True,
)
def carry_sentiment(spark, d):
    from barline.operators.news import carry_sentiment as op

    out = op(sentiment_days(spark, d))
    return out.select("symbol", "day", "scored", F.round("score", 6).alias("score"), "label")


@query(
    "rebase",
    "bars",
    """SELECT symbol, ts, round(close / first_value(close) OVER (PARTITION BY symbol ORDER BY pos), 6) AS rebased FROM bars""",
)
def rebase(spark, d):
    first = F.when(F.col("pos") == 0, F.col("close"))
    out = running(fx.bars(spark, d), {"base": ("last", first)})
    return out.select("symbol", "ts", F.round(F.col("close") / F.col("base"), 6).alias("rebased"))
