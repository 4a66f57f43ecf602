"""Statistics, event studies and gates (M family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import ts
from barline.operators import events, gates, metrics, stats
from barline.operators.joins import event_windows
from barline.operators.labels import direction
from barline.operators.sleeves import is_long
from barline.plans.blocks import in_blocks
from barline.queries import fixtures as fx
from barline.queries.crosssection import returns as bar_returns
from barline.queries.registry import query, view
from barline.queries.tables import index_returns, month_end_events, r6
from barline.queries.timeseries import panel
from barline.queries.trading import run_variants
from barline.session import cut



def idx_calendar(returns):
    return returns.select(F.to_date("ts").alias("day")).distinct()


view("tom_ev", "tom", """
SELECT symbol, min(ts) AS ts, product(1 + ret) - 1 AS value FROM (
  SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY rp) AS g FROM (SELECT *, CASE WHEN turn IS DISTINCT FROM lag(turn) OVER (PARTITION BY symbol ORDER BY rp) THEN 1 ELSE 0 END AS chg FROM tom)) WHERE turn GROUP BY symbol, g""")


def turn_events(spark, d):
    r = cut(index_returns(spark, d))
    return events.turn_of_month_returns(r, idx_calendar(r))


def _boot(source: str, keys: str, seed: str, reps: int) -> str:
    weight = " + ".join(f"(u >= {edge})::INTEGER" for edge in stats.POISSON)
    mask, x, steps = 0xFFFFFFFF, f"(i + {seed} * 48271 + 1) & {0xFFFFFFFF}", []
    for n in range(2):  # each step shifts and multiplies; between the two rounds comes the resample
        if n:
            x = f"(x + rep * 630360016) & {mask}"
        for expr in (x, f"xor(x, x >> 16) * 569420461 & {mask}", f"xor(x, x >> 15) * 1935289751 & {mask}", "xor(x, x >> 15)"):
            steps.append(f"h{len(steps) + 1} AS (SELECT {keys}, value, rep, i, {expr} AS x FROM {f'h{len(steps)}' if steps else 'br'})")
    return f"""bn AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i FROM {source} WHERE value IS NOT NULL),
br AS (SELECT {keys}, value, i, rep FROM bn, (SELECT unnest(range({reps})) AS rep)),
{", ".join(steps)},
b4 AS (SELECT {keys}, value, rep, {weight.replace("u >=", "x >=")} AS w FROM h{len(steps)}),
bm AS (SELECT {keys}, rep, sum(w * value) / nullif(sum(w), 0)::DOUBLE AS m FROM b4 GROUP BY {keys}, rep),
nb AS (SELECT {keys}, count(*) AS bn FROM bn GROUP BY {keys}),
ci AS (SELECT {keys}, CASE WHEN any_value(bn) >= 3 THEN quantile_cont(m, 0.025) END AS ci_low, CASE WHEN any_value(bn) >= 3 THEN quantile_cont(m, 0.975) END AS ci_high
  FROM bm JOIN nb USING ({keys}) GROUP BY {keys})"""


@query("bootstrap_ci", "tom_ev", "WITH " + _boot("tom_ev", "symbol", "7", 10_000) + " SELECT symbol, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci")
def bootstrap_ci(spark, d):
    out = stats.bootstrap_ci(turn_events(spark, d), ["symbol"], "value", ["ts"])
    return out.select("symbol", *r6("ci_low", "ci_high"))


view("icd", "idx_r", "SELECT ts::DATE AS day, row_number() OVER (ORDER BY ts) - 1 AS ci FROM (SELECT DISTINCT ts FROM idx_r)")
view("battery", "idx_r tom_ev icd", """
WITH q AS (SELECT max(day) AS day FROM icd GROUP BY year(day), quarter(day)),
o AS (SELECT coalesce(max(day) FILTER (dayofweek(day) = 5 AND r = 3), max(day) FILTER (day <= third)) AS day FROM (
  SELECT day, date_trunc('month', day)::DATE AS m, date_trunc('month', day)::DATE + ((5 - dayofweek(date_trunc('month', day)) + 7) % 7)::INTEGER + 14 AS third,
    row_number() OVER (PARTITION BY date_trunc('month', day), dayofweek(day) ORDER BY day) AS r FROM icd) GROUP BY m),
a AS (SELECT DISTINCT (SELECT min(c.day) FROM icd c WHERE c.day >= e.day) AS day FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders JOIN pages ON o_orderkey = page_id) e),
w AS (SELECT r.symbol, r.ts, r.rp, r.ret, EXISTS (SELECT 1 FROM o WHERE o.day IS NOT NULL AND r.ts::DATE <= o.day AND r.ts::DATE >= date_trunc('week', o.day)::DATE) AS flag FROM idx_r r),
g AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY rp) AS g FROM (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY symbol ORDER BY rp) THEN 1 ELSE 0 END AS chg FROM w))
SELECT symbol, 'turn_of_month' AS name, ts, value FROM tom_ev
UNION ALL SELECT symbol, 'quarter_end', ts, ret FROM idx_r WHERE ts::DATE IN (SELECT day FROM q)
UNION ALL SELECT symbol, 'opex_day', ts, ret FROM idx_r WHERE ts::DATE IN (SELECT day FROM o WHERE day IS NOT NULL)
UNION ALL SELECT symbol, 'announcement', ts, ret FROM idx_r WHERE ts::DATE IN (SELECT day FROM a WHERE day IS NOT NULL)
UNION ALL SELECT symbol, 'opex_week', min(ts), product(1 + ret) - 1 FROM g WHERE flag GROUP BY symbol, g""")


def battery(spark, d):
    """All calendar and announcement events of all regions; announcement days come from the orders the pages point to."""
    from barline.plans.blocks import number_rows

    r = cut(index_returns(spark, d))
    days = cut(number_rows(idx_calendar(r), [], ["day"], pos="ci"))
    dates = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.to_date("o_orderdate").alias("day"))
    told = fx.table(spark, d, "pages").select("page_id").join(dates, "page_id").select("day").distinct()
    parts = [
        events.turn_of_month_returns(r, days), events.quarter_end_returns(r, days), events.opex_day_returns(r, days),
        events.announcement_returns(r, told, days), events.opex_week_returns(r, days),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("event_battery", "battery", "SELECT symbol, name, ts, round(value, 6) AS value FROM battery")
def event_battery(spark, d):
    return battery(spark, d).select("symbol", "name", "ts", F.round("value", 6).alias("value"))


view("bat", "battery", "SELECT symbol || '_' || name AS name, ts, value FROM battery")


@query("effect_test", "bat", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY name) AS n FROM bat),\n"
    "pc AS (SELECT name, ts, value, n, 'full' AS piece FROM n UNION ALL SELECT name, ts, value, n, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'early' ELSE 'late' END FROM n),\n"
    "ps AS (SELECT name, piece, ts, value, CASE piece WHEN 'full' THEN 7 WHEN 'early' THEN 8 ELSE 9 END AS seed FROM pc),\n" + _boot("ps", "name, piece, seed", "seed", 10_000) + """,
s AS (SELECT pc.name, pc.piece, max(n) AS n, avg(value) AS mean, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive, any_value(ci_low) AS lo, any_value(ci_high) AS hi FROM pc JOIN ci USING (name, piece) GROUP BY 1, 2),
w AS (SELECT name, max(n) AS n, max(mean) FILTER (piece = 'full') AS mean, max(mean) FILTER (piece = 'early') AS em, max(mean) FILTER (piece = 'late') AS lm, max(lo) FILTER (piece = 'full') AS lo, max(hi) FILTER (piece = 'full') AS hi, max(positive) FILTER (piece = 'full') AS positive,
  bool_or(lo > 0 OR hi < 0) FILTER (piece = 'early') AS e, bool_or(lo > 0 OR hi < 0) FILTER (piece = 'late') AS l FROM s GROUP BY name),
v AS (SELECT *, n >= 10 AND coalesce(e AND l AND sign(em) = sign(lm), false) AS confirmed, abs(mean) >= 0.0002::DOUBLE AS pays FROM w)
SELECT name, n, round(mean, 6) AS mean, round(em, 6) AS early_mean, round(lm, 6) AS late_mean, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(positive, 6) AS positive, confirmed, pays AS exceeds_cost, CASE WHEN confirmed AND pays THEN 'SURVIVES' ELSE 'DROPPED' END AS verdict,
  CASE WHEN n < 10 THEN 'fewer than 10 events; not testable' WHEN NOT confirmed THEN 'failed split-sample confirmation' WHEN NOT pays THEN 'effect smaller than 2x round-trip cost' END AS drop_reason FROM v""")
def effect_test(spark, d):
    rows = battery(spark, d).select(F.concat_ws("_", "symbol", "name").alias("name"), "ts", "value")
    out = stats.effect_test(cut(rows), "name", "value", ["ts"], cost=0.0001)
    return out.select("name", "n", *r6("mean", "early_mean", "late_mean", "ci_low", "ci_high", "positive"), "confirmed", "exceeds_cost", "verdict", "drop_reason")


@query("car_profile", "idx_r idx_ev", """
WITH x AS (SELECT e.symbol, (r.rp - a.rp)::INTEGER AS offset, r.ret FROM idx_ev e JOIN idx_r a USING (symbol, ts) JOIN (SELECT symbol, max(rp) AS last FROM idx_r GROUP BY symbol) l ON l.symbol = e.symbol
  JOIN idx_r r ON r.symbol = e.symbol AND r.rp BETWEEN a.rp - 5 AND a.rp + 10 WHERE a.rp >= 5 AND a.rp + 10 <= l.last), m AS (SELECT symbol, offset, avg(ret) AS m, count(*) AS events FROM x GROUP BY 1, 2)
SELECT symbol, offset, round(m, 6) AS mean_ret, events, round(sum(m) OVER (PARTITION BY symbol ORDER BY offset), 6) AS car FROM m""".replace("offset", '"offset"'))
def car_profile(spark, d):
    r = cut(index_returns(spark, d))
    out = stats.car_profile(event_windows(r, month_end_events(r), 5, 10))
    return out.select("symbol", "offset", F.round("mean_ret", 6).alias("mean_ret"), "events", F.round("car", 6).alias("car"))


def _horner(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _normal_quantile_sql(p: str) -> str:
    """The rational approximation of the normal quantile in SQL."""
    q, low, high = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda z: f"{_horner(z, stats._C)} / {_horner(z, [*stats._D, 1.0])}"
    middle = f"{_horner(f'({q} * {q})', stats._A)} * {q} / {_horner(f'({q} * {q})', [*stats._B, 1.0])}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -{tail(high)} ELSE {middle} END"


@query("sharpe_hurdle", "runs", f"""
WITH p AS (SELECT market, symbol, strategy, count(*) AS n FROM runs GROUP BY ALL),
s AS (SELECT market, count(*) AS trials, sum(n)::BIGINT AS observations, sqrt(252.0::DOUBLE / greatest(1, sum(n))) AS error, 1 - 1 / greatest(2, count(*))::DOUBLE AS a, 1 - 1 / (greatest(2, count(*)) * exp(1.0::DOUBLE)) AS b FROM p GROUP BY market)
SELECT market, trials, observations, round(error, 4) AS sharpe_error, round(((1 - 0.5772156649::DOUBLE) * ({_normal_quantile_sql('a')}) + 0.5772156649::DOUBLE * ({_normal_quantile_sql('b')})) * error, 4) AS expected_best FROM s""")
def sharpe_hurdle(spark, d):
    """Hurdle per market: trials are its (symbol, strategy) pairs, observations its runs."""
    runs = fx.runs(spark, d)
    pairs = runs.groupBy("market", "symbol", "strategy").agg(F.count("*").alias("n"))
    sizes = pairs.groupBy("market").agg(F.count("*").alias("trials"), F.sum("n").alias("observations"))
    return sizes.select("market", "trials", "observations", *[F.round(c, 4).alias(n) for n, c in stats.sharpe_hurdle(F.col("trials"), F.col("observations")).items()])


view("legs", "bars", "SELECT symbol, ts, open / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS overnight, close / open - 1 AS intraday FROM bars")
_LEG = """round(avg(overnight) * 10000, 3) AS overnight_mean_bps, round(avg(intraday) * 10000, 3) AS intraday_mean_bps, round(product(1 + overnight) - 1, 4) AS overnight_total, round(product(1 + intraday) - 1, 4) AS intraday_total,
  round(avg(overnight) / stddev_samp(overnight) * sqrt(252), 3) AS overnight_sharpe, round(avg(intraday) / stddev_samp(intraday) * sqrt(252), 3) AS intraday_sharpe,
  round((product(1 + overnight) - 1) / ((product(1 + overnight) - 1) + (product(1 + intraday) - 1)), 4) AS overnight_share"""


@query("overnight_intraday", "legs", f"SELECT symbol, {_LEG} FROM legs GROUP BY symbol UNION ALL SELECT 'panel', {_LEG} FROM (SELECT ts, avg(overnight) AS overnight, avg(intraday) AS intraday FROM legs GROUP BY ts)")
def overnight_intraday(spark, d):
    """Both legs per symbol and for the mean of all symbols."""
    rows = cut(events.legs(fx.bars(spark, d)))
    mean = rows.groupBy("ts").agg(F.avg("overnight").alias("overnight"), F.avg("intraday").alias("intraday")).withColumn("symbol", F.lit("panel"))
    out = events.overnight_intraday(rows.select("symbol", "ts", "overnight", "intraday").unionByName(mean), ["symbol"])
    three = [f"{x}_{y}" for x in ("overnight", "intraday") for y in ("mean_bps", "sharpe")]
    return out.select("symbol", *[F.round(c, 3).alias(c) for c in three], *[F.round(c, 4).alias(c) for c in ("overnight_total", "intraday_total", "overnight_share")])


@query("gap_drift_events", "bars_r", """
WITH g AS (SELECT symbol, ts, fwd5, open / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS gap FROM bars_r),
n AS (SELECT *, row_number() OVER (ORDER BY ts, symbol) - 1 AS seq FROM g WHERE gap IS NOT NULL),
q AS (SELECT *, CASE WHEN seq >= 200 THEN quantile_cont(gap, 0.9) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS threshold FROM n)
SELECT symbol, ts, round(gap, 6) AS gap, round(fwd5, 6) AS fwd_5 FROM q WHERE gap >= threshold""")
def gap_drift_events(spark, d):
    out = events.gap_drift(fx.bars(spark, d), horizons=(5,))
    return out.select("symbol", "ts", *r6("gap", "fwd_5"))


@query("vix_spike_events", "panel", """
WITH f AS (SELECT *, last_value(vix IGNORE NULLS) OVER (ORDER BY pos ROWS 3 PRECEDING) AS v, lead(vvix, 5) OVER (ORDER BY pos) / vvix - 1 AS fwd FROM panel),
a AS (SELECT *, list(v) FILTER (v IS NOT NULL) OVER (ORDER BY pos ROWS 251 PRECEDING) AS l FROM f),
p AS (SELECT *, CASE WHEN v IS NOT NULL AND len(l) >= 63 THEN (len(list_filter(l, lambda e: e < v)) + (len(list_filter(l, lambda e: e = v)) + 1) / 2.0) / len(l) END AS pct FROM a),
c AS (SELECT *, lag(pct) OVER (ORDER BY pos) AS before FROM p)
SELECT ts, round(pct, 6) AS percentile, round(fwd, 6) AS fwd FROM c WHERE pct >= 0.9 AND before < 0.9 AND fwd IS NOT NULL""")
def vix_spike_events(spark, d):
    out = events.vol_spikes(panel(spark, d), 0.9, n=252, min_periods=63, asset="vvix")
    return out.select("ts", *r6("percentile", "fwd"))


@query("lag_corr", "bars_r", """
WITH f AS (SELECT *, coalesce(fwd1, 0) AS f FROM bars_r), l AS (SELECT symbol, lag, ret AS x, CASE lag WHEN 0 THEN f WHEN 1 THEN lead(f, 1) OVER w WHEN 2 THEN lead(f, 2) OVER w WHEN 3 THEN lead(f, 3) OVER w WHEN 4 THEN lead(f, 4) OVER w ELSE lead(f, 5) OVER w END AS y
  FROM f CROSS JOIN (SELECT unnest(range(6))::INTEGER AS lag) WINDOW w AS (PARTITION BY symbol, lag ORDER BY pos)),
r AS (SELECT *, rank() OVER (PARTITION BY symbol, lag ORDER BY x) + (count(*) OVER (PARTITION BY symbol, lag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, lag ORDER BY y) + (count(*) OVER (PARTITION BY symbol, lag, y) - 1) / 2.0 AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT symbol, lag, count(*) AS n, corr(x, y) AS p, corr(rx, ry) AS s, regr_slope(y, x) AS b FROM r GROUP BY 1, 2)
SELECT symbol, lag, n, round(p, 6) AS pearson, round(s, 6) AS spearman, round(b, 6) AS slope, round(p * p, 6) AS r2, round(p * sqrt(n - 2) / sqrt(1 - p * p), 4) AS t_stat FROM c""")
def lag_corr(spark, d):
    out = stats.lag_corr(bar_returns(spark, d), "ret")
    return out.select("symbol", "lag", "n", *r6("pearson", "spearman", "slope", "r2"), F.round("t_stat", 4).alias("t_stat"))


@query("conditional_means", "bars_r", """
SELECT symbol, CASE WHEN ret > 0.02 THEN 'bullish' WHEN ret < -0.02 THEN 'bearish' ELSE 'neutral' END AS tone, count(*) AS n, round(coalesce(avg(fwd5), 0), 6) AS mean_fwd FROM bars_r WHERE ret IS NOT NULL GROUP BY 1, 2""")
def conditional_means(spark, d):
    out = stats.conditional_means(bar_returns(spark, d).where("ret IS NOT NULL"), "ret", "fwd5", ["symbol"], 0.02)
    return out.select("symbol", "tone", "n", F.round("mean_fwd", 6).alias("mean_fwd"))


view("judged", "bars_h preds", """
SELECT symbol, ts, direction AS predicted, strength, CASE WHEN fwd >= 0.2 THEN 'bullish' WHEN fwd <= -0.2 THEN 'bearish' ELSE 'neutral' END AS actual FROM (
  SELECT *, lead(close, 1) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS fwd FROM bars_h) JOIN preds USING (symbol, ts) WHERE fwd IS NOT NULL""")


def judged(spark, d):
    bars = in_blocks(fx.bars_h(spark, d), lambda r, w: r.withColumn("fwd", ts.forward_return("close", 1, w)), fwd=1)
    bars = cut(bars.where("fwd IS NOT NULL"))
    actual = bars.select("symbol", "ts", direction(F.col("fwd"), F.lit(0.2)).alias("actual"))
    return fx.preds_of(bars).join(actual, ["symbol", "ts"])


_LABELS = ("bullish", "bearish", "neutral")
_TP = {c: f"count(*) FILTER (actual = '{c}' AND predicted = '{c}')" for c in _LABELS}
_NA = {c: f"count(*) FILTER (actual = '{c}')" for c in _LABELS}
_NP = {c: f"count(*) FILTER (predicted = '{c}')" for c in _LABELS}


def _safe(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0 END"


@query("class_metrics", "judged", f"""
SELECT symbol, count(*) AS samples, round(count(*) FILTER (actual = predicted) / count(*), 6) AS accuracy,
  round(({' + '.join(_safe(_TP[c], _NA[c]) for c in _LABELS)}) / greatest({' + '.join(f'({_NA[c]} > 0)::INT' for c in _LABELS)}, 1), 6) AS balanced_accuracy,
  round(({' + '.join(_safe(_TP[c], _NP[c]) for c in _LABELS)}) / 3, 6) AS macro_precision, round(({' + '.join(_safe(_TP[c], _NA[c]) for c in _LABELS)}) / 3, 6) AS macro_recall,
  round(({' + '.join(_safe('2 * ' + _TP[c], '(' + _NA[c] + ' + ' + _NP[c] + ')') for c in _LABELS)}) / 3, 6) AS macro_f1 FROM judged GROUP BY symbol""")
def class_metrics(spark, d):
    out = stats.class_metrics(judged(spark, d), "actual", "direction", _LABELS, ["symbol"])
    return out.select("symbol", "samples", *r6("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1"))


view("judged_both", "bars_h preds", """
WITH f AS (SELECT * FROM (SELECT symbol, ts, lead(close, 1) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS fwd FROM bars_h) WHERE fwd IS NOT NULL),
m AS (SELECT ts::DATE AS day, round(avg(fwd), 9) AS market FROM f GROUP BY 1)
SELECT symbol, direction AS pd, relative AS pr, CASE WHEN fwd >= 0.2 THEN 'bullish' WHEN fwd <= -0.2 THEN 'bearish' ELSE 'neutral' END AS ad,
  CASE WHEN fwd - market >= 0.1::DOUBLE THEN 'outperform' WHEN fwd - market <= -0.1::DOUBLE THEN 'underperform' ELSE 'inline' END AS ar
FROM f JOIN m ON f.ts::DATE = m.day JOIN preds USING (symbol, ts)""")
_RELATIVE = ("outperform", "underperform", "inline")


def _target_sql(name: str, a: str, p: str, labels) -> str:
    """The five metrics and the label counts of one target."""
    count = lambda ok: f"count(*) FILTER ({ok})"
    tp, na, np = ({c: count(ok.format(c=c)) for c in labels} for ok in (f"{a} = '{{c}}' AND {p} = '{{c}}'", f"{a} = '{{c}}'", f"{p} = '{{c}}'"))
    recall = " + ".join(_safe(tp[c], na[c]) for c in labels)
    return f"""round({count(f'{a} = {p}')} / count(*), 6) AS {name}_accuracy, round(({recall}) / greatest({' + '.join(f'({na[c]} > 0)::INT' for c in labels)}, 1), 6) AS {name}_balanced_accuracy,
  round(({' + '.join(_safe(tp[c], np[c]) for c in labels)}) / 3, 6) AS {name}_macro_precision, round(({recall}) / 3, 6) AS {name}_macro_recall,
  round(({' + '.join(_safe('2 * ' + tp[c], f'({na[c]} + {np[c]})') for c in labels)}) / 3, 6) AS {name}_macro_f1,
  concat_ws(',', {', '.join(f"'{c}:' || {na[c]}" for c in labels)}) AS {name}_actual, concat_ws(',', {', '.join(f"'{c}:' || {np[c]}" for c in labels)}) AS {name}_predicted"""


@query("joint_metrics", "judged_both", f"""
SELECT symbol, count(*) AS samples, {_target_sql("direction", "ad", "pd", _LABELS)}, {_target_sql("relative", "ar", "pr", _RELATIVE)},
  round(count(*) FILTER (ad = pd AND ar = pr) / count(*), 6) AS joint_accuracy FROM judged_both GROUP BY symbol""")
def joint_metrics(spark, d):
    """Direction and move against the day's mean, judged together: metrics of both, joint accuracy and label counts of each user."""
    bars = in_blocks(fx.bars_h(spark, d), lambda r, w: r.withColumn("fwd", ts.forward_return("close", 1, w)), fwd=1)
    bars = cut(bars.where("fwd IS NOT NULL").withColumn("day", F.to_date("ts")))
    market = bars.groupBy("day").agg(F.round(F.avg("fwd"), 9).alias("market"))
    actual = bars.join(market, "day").select("symbol", "ts", direction(F.col("fwd"), F.lit(0.2)).alias("ad"), direction(F.col("fwd") - F.col("market"), F.lit(0.1), _RELATIVE).alias("ar"))
    targets = {"direction": ("ad", "direction", _LABELS), "relative": ("ar", "relative", _RELATIVE)}
    out = stats.joint_metrics(fx.preds_of(bars).join(actual, ["symbol", "ts"]), targets, ["symbol"])
    scores = [f"{t}_{m}" for t in targets for m in ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")]
    counts = [F.array_join(F.transform(F.map_entries(f"{t}_{w}"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias(f"{t}_{w}") for t in targets for w in ("actual", "predicted")]
    return out.select("symbol", "samples", *r6(*scores, "joint_accuracy"), *counts)


@query("confusion", "judged", "SELECT actual, predicted, count(*) AS n FROM judged GROUP BY 1, 2")
def confusion(spark, d):
    return judged(spark, d).groupBy("actual", F.col("direction").alias("predicted")).agg(F.count("*").alias("n"))


@query("signal_quality", "judged", f"""
WITH t AS (SELECT *, predicted = 'bullish' AND strength IN ('medium', 'high') AS taken FROM judged)
SELECT symbol, round({_safe("count(*) FILTER (taken AND actual = 'bullish')", "count(*) FILTER (taken)")}, 6) AS precision, round({_safe("count(*) FILTER (taken AND actual = 'bullish')", "count(*) FILTER (actual = 'bullish')")}, 6) AS recall,
  round(count(*) FILTER (taken) / count(*), 6) AS coverage, count(*) AS n FROM t GROUP BY symbol""".replace("AS precision", 'AS "precision"'))
def signal_quality(spark, d):
    out = stats.signal_quality(judged(spark, d), is_long(F.col("direction"), F.col("strength"), F.col("relative")), "actual", ["symbol"])
    return out.select("symbol", *r6("precision", "recall", "coverage"), "n")


# The direct source starts in 1998 and the double one in 1996, as such products start late in real data.
view("stitched", "panel", """
WITH r AS (SELECT ts, vix / lag(vix) OVER (ORDER BY pos) - 1 AS a, vix9d / lag(vix9d) OVER (ORDER BY pos) - 1 AS b, vix3m / lag(vix3m) OVER (ORDER BY pos) - 1 AS c FROM panel),
s AS (SELECT ts, CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN a END AS direct, -b / CASE WHEN ts >= TIMESTAMP '1999-06-01' THEN 0.5::DOUBLE ELSE 1 END AS inverse, CASE WHEN ts >= TIMESTAMP '1996-01-01' THEN c END / CASE WHEN ts >= TIMESTAMP '1999-06-01' THEN 1.5::DOUBLE ELSE 2 END AS dbl FROM r)
SELECT *, coalesce(direct, dbl, inverse) AS ret, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN dbl IS NOT NULL THEN 'double' WHEN inverse IS NOT NULL THEN 'inverse' END AS source FROM s""")


def stitched(spark, d):
    def add(rows, w):
        return rows.withColumns({n: ts.simple_return(c, w) for n, c in (("r_direct", "vix"), ("r_inverse", "vix9d"), ("r_double", "vix3m"))})

    rows = in_blocks(panel(spark, d), add, back=1, keys=[])
    late = lambda c, start: F.when(F.col("ts") >= F.lit(start).cast("timestamp"), F.col(c))
    rows = rows.withColumns({"r_direct": late("r_direct", "1998-01-01"), "r_double": late("r_double", "1996-01-01")})
    return stats.stitch_returns(rows, "1999-06-01")


@query("stitch_returns", "stitched", "SELECT ts, round(ret, 6) AS ret, source FROM stitched")
def stitch_returns(spark, d):
    return stitched(spark, d).select("ts", F.round("ret", 6).alias("ret"), "source")


@query("leverage_check", "stitched", """
WITH l AS (SELECT 'inverse' AS source, direct AS x, inverse AS y FROM stitched UNION ALL SELECT 'double', direct, dbl FROM stitched)
SELECT source, count(*) AS overlap, round(covar_samp(y, x) / var_samp(x), 4) AS beta, round(corr(y, x), 4) AS correlation, abs(covar_samp(y, x) / var_samp(x) - 1) < 0.15 AS as_expected FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY source HAVING count(*) >= 60""")
def leverage_check(spark, d):
    return stats.leverage_check(stitched(spark, d)).select("source", "overlap", F.round("beta", 4).alias("beta"), F.round("correlation", 4).alias("correlation"), "as_expected")


@query("har_forecast")
def har_forecast(spark, d):
    """Variance forecasts of the regions' daily returns, fitted on closed targets only."""
    return stats.har_forecast(cut(index_returns(spark, d))).select("symbol", "ts", F.round("forecast", 6).alias("forecast"), F.round("actual", 6).alias("actual"), "refit")


@query("har_diagnostics")
def har_diagnostics(spark, d):
    out = stats.har_diagnostics(stats.har_forecast(cut(index_returns(spark, d))))
    return out.select("symbol", "rows", F.round("correlation", 4).alias("correlation"), *r6("rmse", "bias"), "beats_mean")


view("vwin", "sleeve_out", """
WITH e AS (SELECT variant, sp, net, sp // 126 AS win, product(1 + net) OVER (PARTITION BY variant ORDER BY sp) AS eq FROM sleeve_out),
k AS (SELECT *, eq / max(eq) OVER (PARTITION BY variant ORDER BY sp) - 1 AS dd FROM e),
f AS (SELECT variant, product(1 + net) - 1 AS total, min(dd) AS max_drawdown, CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(252) ELSE 0 END AS sharpe FROM k GROUP BY variant),
w AS (SELECT variant, win, product(1 + net) - 1 AS t, CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(252) ELSE 0 END AS s FROM k GROUP BY 1, 2 HAVING count(*) = 126)
SELECT variant, total, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 4) AS sharpe, m.mean_sharpe, m.profitable_fraction FROM f JOIN (SELECT variant, avg(s) AS mean_sharpe, avg(CASE WHEN t > 0 THEN 1.0::DOUBLE ELSE 0 END) AS profitable_fraction FROM w GROUP BY variant) m USING (variant)""")


@query("gate_checks", "vwin", """
WITH c AS (SELECT v.variant, v.mean_sharpe >= 1.0 AS c1, v.profitable_fraction >= 0.7 AS c2, abs(v.max_drawdown) <= 0.25 AS c3, v.mean_sharpe > 0.5 AS c4, v.sharpe > b.sharpe AS c5, v.max_drawdown > b.max_drawdown AS c6
  FROM vwin v, (SELECT * FROM vwin WHERE variant = 'slope_00') b)
SELECT variant, array_to_string(list_sort(list_filter([CASE WHEN NOT c1 THEN 'mean_sharpe_at_least_1_0' END, CASE WHEN NOT c2 THEN 'profitable_windows_at_least_70pct' END, CASE WHEN NOT c3 THEN 'full_history_worst_dd_within_25pct' END,
  CASE WHEN NOT c4 THEN 'clears_multiple_testing_hurdle' END, CASE WHEN NOT c5 THEN 'beats_baseline_sharpe_full_history' END, CASE WHEN NOT c6 THEN 'beats_baseline_drawdown' END], lambda x: x IS NOT NULL)), ',') AS failed,
  CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 AND c6 THEN 'PROMOTED' WHEN NOT c5 THEN 'KILLED' ELSE 'WATCHLIST' END AS status FROM c""")
def gate_checks(spark, d):
    """Twelve sleeve variants judged against the plainest one."""
    rows = cut(run_variants(spark, d).select("variant", "ts", "pos", F.col("net").alias("ret")))
    full = metrics.return_metrics(rows, ["variant"]).select("variant", F.round("sharpe", 4).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))
    windows = rows.withColumn("win", F.floor(F.col("pos") / 126))
    per = metrics.return_metrics(windows, ["variant", "win"]).where("days = 126").groupBy("variant").agg(
        F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("total_return") > 0).cast("double")).alias("profitable_fraction")
    )
    base = full.where("variant = 'slope_00'").select(F.col("sharpe").alias("base_sharpe"), F.col("max_drawdown").alias("base_max_drawdown"))
    table = full.join(per, "variant").withColumns({c: base.select(c).scalar() for c in base.columns})
    out = gates.gate(table, gates.sleeve_checks(0.5), ["beats_baseline_sharpe_full_history"])
    return out.select("variant", F.array_join("failed_checks", ",").alias("failed"), "status")


#: Date ranges in which a sleeve must lose less than the baseline.
CRISES = {"autumn_1997": ("1997-10-01", "1997-11-30"), "autumn_1998": ("1998-08-01", "1998-10-31")}
_CRISIS_DD = ", ".join(f"min(dd) FILTER (crisis = '{n}') AS {n}" for n in CRISES)
_FAILS = {
    "mean_sharpe_at_least_1_0": "v.mean_sharpe >= 1.0", "profitable_windows_at_least_70pct": "v.profitable_fraction >= 0.7", "full_history_worst_dd_within_25pct": "abs(v.max_drawdown) <= 0.25",
    "clears_multiple_testing_hurdle": "v.mean_sharpe > h.hurdle", "beats_baseline_sharpe_full_history": "v.sharpe > b.sharpe", "beats_baseline_drawdown": "v.max_drawdown > b.max_drawdown",
} | {f"beats_baseline_drawdown_{n}": f"coalesce(c.{n} > bc.{n}, false)" for n in CRISES}
_KILLS = ["beats_baseline_sharpe_full_history", *(f"beats_baseline_drawdown_{n}" for n in CRISES)]


@query("crisis_gates", "vwin", f"""
WITH x AS (SELECT variant, crisis, sp, product(1 + net) OVER (PARTITION BY variant, crisis ORDER BY sp) AS eq FROM sleeve_out JOIN (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in CRISES.items())}) t(crisis, a, b) ON ts::DATE BETWEEN a AND b),
y AS (SELECT variant, crisis, round(eq / max(eq) OVER (PARTITION BY variant, crisis ORDER BY sp) - 1, 9) AS dd FROM x), c AS (SELECT variant, {_CRISIS_DD} FROM y GROUP BY variant),
n AS (SELECT count(DISTINCT variant) AS trials, count(*) / count(DISTINCT variant) AS days FROM sleeve_out),
h AS (SELECT round(((1 - 0.5772156649::DOUBLE) * ({_normal_quantile_sql('a')}) + 0.5772156649::DOUBLE * ({_normal_quantile_sql('b')})) * sqrt(252.0::DOUBLE / days), 4) AS hurdle
  FROM (SELECT days, 1 - 1 / trials::DOUBLE AS a, 1 - 1 / (trials * exp(1.0::DOUBLE)) AS b FROM n)),
k AS (SELECT v.variant, v.mean_sharpe, v.max_drawdown, {', '.join(f"c.{n}" for n in CRISES)}, {', '.join(f"{sql} AS {name}" for name, sql in _FAILS.items())}
  FROM vwin v LEFT JOIN c USING (variant), (SELECT * FROM vwin WHERE variant = 'slope_00') b, (SELECT * FROM c WHERE variant = 'slope_00') bc, h)
SELECT variant, round(mean_sharpe, 4) AS mean_sharpe, (SELECT hurdle FROM h) AS hurdle, {', '.join(f"round({n}, 6) AS {n}" for n in CRISES)},
  array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN NOT {name} THEN '{name}' END" for name in _FAILS)}], lambda x: x IS NOT NULL)), ',') AS failed,
  CASE WHEN {' AND '.join(_FAILS)} THEN 'PROMOTED' WHEN NOT ({' AND '.join(_KILLS)}) THEN 'KILLED' ELSE 'WATCHLIST' END AS status,
  row_number() OVER (ORDER BY variant = 'slope_00', round(mean_sharpe, 9) DESC, abs(max_drawdown), variant) = 1 AS leads FROM k""")
def crisis_gates(spark, d):
    """All checks of the sleeves, with a drawdown smaller than the baseline's in every crisis and the hurdle of as many trials; who leads, and who is killed."""
    rows = cut(run_variants(spark, d).select("variant", "ts", "pos", F.col("net").alias("ret")))
    full = metrics.return_metrics(rows, ["variant"]).select("variant", "days", F.round("sharpe", 4).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))
    windows = metrics.return_metrics(rows.withColumn("win", F.floor(F.col("pos") / 126)), ["variant", "win"]).where("days = 126")
    per = windows.groupBy("variant").agg(F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("total_return") > 0).cast("double")).alias("profitable_fraction"))
    table = cut(full.join(per, "variant").join(gates.crisis_drawdowns(rows, CRISES), "variant", "left"))
    base = table.where("variant = 'slope_00'").select(*[F.col(c).alias(f"base_{c}") for c in ("sharpe", "max_drawdown", "crisis")])
    lead = table.where("variant <> 'slope_00'").agg(F.min_by("variant", F.struct(-F.round("mean_sharpe", 9), F.abs("max_drawdown"), "variant")).alias("variant"))
    hurdle = table.select(F.round(stats.sharpe_hurdle(F.count(F.lit(1)), F.max("days"))["expected_best"], 4).alias("hurdle"))
    table = table.withColumns({c: base.select(c).scalar() for c in base.columns} | {"hurdle": hurdle.scalar(), "lead": lead.scalar()})
    out = gates.gate(table, gates.sleeve_checks(F.col("hurdle")) | gates.crisis_checks(CRISES), _KILLS)
    crises = [F.round(F.col("crisis")[n], 6).alias(n) for n in CRISES]
    return out.select("variant", F.round("mean_sharpe", 4).alias("mean_sharpe"), "hurdle", *crises, F.array_join("failed_checks", ",").alias("failed"), "status", (F.col("variant") == F.col("lead")).alias("leads"))


def _full_sql(source: str) -> str:
    return f"""SELECT variant, product(1 + net) - 1 AS t, CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(252) ELSE 0 END AS s, min(dd) AS d FROM (
  SELECT *, eq / max(eq) OVER (PARTITION BY variant ORDER BY sp) - 1 AS dd FROM (SELECT *, product(1 + net) OVER (PARTITION BY variant ORDER BY sp) AS eq FROM {source})) GROUP BY variant"""


@query("lag_sensitivity", "sleeve_out sleeve_out1", f"""WITH a AS ({_full_sql('sleeve_out')}), b AS ({_full_sql('sleeve_out1')})
SELECT a.variant, round(a.t, 6) AS total_return_settled, round(a.s, 6) AS sharpe_settled, round(a.d, 6) AS max_drawdown_settled, round(b.t, 6) AS total_return_lag1, round(b.s, 6) AS sharpe_lag1, round(b.d, 6) AS max_drawdown_lag1 FROM a JOIN b USING (variant)""")
def lag_sensitivity(spark, d):
    """Sleeve metrics with a settled signal (two closes old) against the latest one."""
    def scored(lag):
        rows = run_variants(spark, d, lag=lag).select("variant", "ts", "pos", F.col("net").alias("ret"))
        return metrics.return_metrics(cut(rows), ["variant"])

    out = gates.lag_sensitivity(scored(2), scored(1))
    return out.select("variant", *r6(*[c for c in out.columns if c != "variant"]))
