"""Labels, features and splits (F family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import ts
from barline.operators import labels, metrics
from barline.operators.joins import with_params
from barline.plans.arrays import in_arrays
from barline.plans.blocks import in_blocks, number_rows
from barline.queries import fixtures as fx
from barline.queries.crosssection import week_calendar
from barline.queries.registry import query, view
from barline.queries.reports import metric_columns, splits
from barline.queries.tables import index_returns, r6
from barline.queries.timeseries import _frame
from barline.session import cut, written

view("level", "bars", "SELECT ts, avg(close) AS level FROM bars GROUP BY ts")
view("lab_in", "bars level", f"""
WITH r AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1, 0) AS r, lead(close, 5) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS fwd,
  lead(ts, 5) OVER (PARTITION BY symbol ORDER BY pos) AS ets FROM bars),
v AS (SELECT *, stddev_pop(r) OVER {_frame(20)} AS vol FROM r)
SELECT v.*, greatest(0.01::DOUBLE, vol * sqrt(5) * 0.5::DOUBLE) AS threshold, fwd - coalesce(e.level / s.level - 1, 0) AS excess FROM v LEFT JOIN level s ON s.ts = v.ts LEFT JOIN level e ON e.ts = v.ets WHERE pos >= 20 AND fwd IS NOT NULL""")


def bench(bars):
    return bars.groupBy("ts").agg(F.avg("close").alias("close"))


@query("band_labels", "lab_in", """
SELECT symbol, ts, round(fwd, 6) AS fwd, round(excess, 6) AS excess, round(vol, 6) AS vol20, round(threshold, 6) AS threshold,
  CASE WHEN fwd >= threshold THEN 'bullish' WHEN fwd <= -threshold THEN 'bearish' ELSE 'neutral' END AS direction,
  CASE WHEN abs(fwd) >= threshold * 2.5::DOUBLE THEN 'high' WHEN abs(fwd) >= threshold * 1.5::DOUBLE THEN 'medium' ELSE 'low' END AS strength,
  CASE WHEN excess >= threshold THEN 'outperform' WHEN excess <= -threshold THEN 'underperform' ELSE 'inline' END AS relative FROM lab_in""")
def band_labels(spark, d):
    bars = cut(fx.bars(spark, d))
    out = labels.band_labels(bars, bench(bars))
    return out.select("symbol", "ts", *r6("fwd", "excess", "vol20", "threshold"), "direction", "strength", "relative")


@query("hourly_labels", "bars_h", f"""
WITH r AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1, 0) AS r, lead(close, 5) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS fwd FROM bars_h),
v AS (SELECT *, greatest(0.01::DOUBLE, stddev_pop(r) OVER {_frame(20)} * sqrt(5) * 0.5::DOUBLE) AS threshold FROM r)
SELECT symbol, ts, round(fwd, 6) AS fwd, CASE WHEN fwd >= threshold THEN 'bullish' WHEN fwd <= -threshold THEN 'bearish' ELSE 'neutral' END AS direction FROM v WHERE pos >= 20 AND fwd IS NOT NULL""")
def hourly_labels(spark, d):
    # Rounded on the scaled number, as SQL does it: half of the last digit is told from the binary value, not from its decimals.
    return labels.band_labels(fx.bars_h(spark, d)).select("symbol", "ts", (F.round(F.col("fwd") * 1e6) / 1e6).alias("fwd"), "direction")


@query("triple_barrier", "lab_in bars", """
WITH j AS (SELECT l.symbol, l.ts, l.pos, l.close, l.threshold, b.pos AS bp, b.high >= l.close * (1 + l.threshold) AS up, b.low <= l.close * (1 - l.threshold) AS down, b.close AS bc
  FROM lab_in l JOIN bars b ON b.symbol = l.symbol AND b.pos BETWEEN l.pos + 1 AND l.pos + 5),
h AS (SELECT symbol, pos, arg_min(CASE WHEN up AND down THEN CASE WHEN bc >= close THEN 'bullish' ELSE 'bearish' END WHEN up THEN 'bullish' ELSE 'bearish' END, bp) FILTER (up OR down) AS b FROM j GROUP BY 1, 2)
SELECT symbol, ts, round(threshold, 6) AS threshold, coalesce(b, 'neutral') AS barrier FROM lab_in JOIN h USING (symbol, pos)""")
def triple_barrier(spark, d):
    return labels.triple_barrier(fx.bars(spark, d)).select("symbol", "ts", F.round("threshold", 6).alias("threshold"), "barrier")


_L = "lag({0}, {1}) OVER (PARTITION BY symbol ORDER BY pos)"


def _gap(ref: str, cur: str = "close") -> str:
    return f"CASE WHEN {ref} > 0 THEN {cur} / {ref} - 1 ELSE 0 END"


def _vr(n: int) -> str:
    return f"CASE WHEN volume > 0 AND avg(volume) OVER {_frame(n)} > 0 THEN volume / avg(volume) OVER {_frame(n)} - 1 ELSE 0 END"


_TECH_SQL = {
    **{f"ret_{n}": _gap(_L.format("close", n)) for n in (1, 3, 5, 10, 20)},
    **{f"sma_gap_{n}": _gap(f"avg(close) OVER {_frame(n)}") for n in (5, 10, 20)},
    **{f"vol_{n}": f"stddev_pop(r1) OVER {_frame(n)}" for n in (5, 10)},
    "range_1": "rg",
    "range_5_avg": f"avg(rg) OVER {_frame(5)}",
    "close_vs_high_20": _gap(f"max(high) OVER {_frame(20)}"),
    "close_vs_low_20": _gap(f"min(low) OVER {_frame(20)}"),
    "volume_ratio_5": _vr(5),
    "volume_ratio_20": _vr(20),
}
view("tech", "bars", f"""
SELECT * FROM (SELECT symbol, ts, pos, {', '.join(f'{e} AS {n}' for n, e in _TECH_SQL.items())}, (lead(close) OVER (PARTITION BY symbol ORDER BY pos) > close)::INTEGER AS label
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS r1, {_gap('low', 'high')} AS rg FROM bars)) WHERE pos >= 20 AND label IS NOT NULL""")


@query("tech_features", "tech", f"SELECT symbol, ts, {', '.join(f'round({n}, 6) AS {n}' for n in _TECH_SQL)}, label FROM tech")
def tech_features(spark, d):
    return labels.technical_features(fx.bars(spark, d), 6).select("symbol", "ts", *labels.TECHNICAL, "label")


_VEC = ", ".join(f"round({n}, 4)" for n in labels.TECHNICAL)


@query("sequences", "tech", f"""
SELECT symbol, ts, label, len(s)::INTEGER AS steps, round(list_sum(list_transform(s, lambda v: v[1] + v[8] + v[16])), 3) AS checksum FROM (
  SELECT *, list([{', '.join(labels.TECHNICAL)}]) OVER {_frame(24)} AS s FROM tech) WHERE len(s) = 24""")
def sequences(spark, d):
    """24-step windows of the 16 features (compared by their length and a checksum over three features)."""
    out = labels.sequence_windows(fx.bars(spark, d))
    total = F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[0] + v[7] + v[15])
    return out.select("symbol", "ts", "label", F.size("sequence").alias("steps"), F.round(total, 3).alias("checksum"))


_NP_SQL = {k: v for k, v in _TECH_SQL.items() if k.startswith("ret_")} | {
    "dist_sma_10": _TECH_SQL["sma_gap_10"], "dist_sma_20": _TECH_SQL["sma_gap_20"], "vol_20": f"stddev_pop(r) OVER {_frame(20)}",
    "volume_z": f"CASE WHEN min(volume) OVER {_frame(20)} < max(volume) OVER {_frame(20)} THEN (volume - avg(volume) OVER {_frame(20)}) / stddev_pop(volume) OVER {_frame(20)} ELSE 0 END",
}


@query("np_features", "lab_in bars", f"""
WITH f AS (SELECT symbol, ts, pos, {', '.join(f'{e} AS {n}' for n, e in _NP_SQL.items())} FROM (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1, 0) AS r FROM bars)),
o AS (SELECT symbol, ts, CASE volume::BIGINT % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS d, CASE volume::BIGINT % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS s, CASE volume::BIGINT % 2 WHEN 0 THEN 'earnings' ELSE 'macro' END AS e FROM bars WHERE high > low),
j AS (SELECT f.*, l.excess, coalesce(CASE d WHEN 'bullish' THEN 1.0::DOUBLE WHEN 'bearish' THEN -1.0::DOUBLE ELSE 0 END, 0) AS label_score, coalesce(CASE s WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE WHEN 'high' THEN 3.0::DOUBLE END, 1) AS strength_score, coalesce(e, 'other') AS e
  FROM f JOIN lab_in l USING (symbol, pos) LEFT JOIN o ON o.symbol = f.symbol AND o.ts = f.ts)
SELECT symbol, ts, {', '.join(f'round({n}, 6) AS {n}' for n in _NP_SQL)}, label_score, strength_score, label_score * strength_score AS signed_strength, (e = 'earnings')::INT::DOUBLE AS event_earnings, (e = 'macro')::INT::DOUBLE AS event_macro, (e = 'other')::INT::DOUBLE AS event_other,
  round(excess, 6) AS excess, (excess >= 0.01)::INTEGER AS target_long FROM j""")
def np_features(spark, d):
    bars = cut(fx.bars(spark, d))
    n = F.col("volume").cast("bigint")
    outputs = bars.where("high > low").select(
        "symbol", "ts", F.when(n % 3 == 0, "bullish").when(n % 3 == 1, "bearish").otherwise("neutral").alias("direction"),
        F.when(n % 4 == 0, "low").when(n % 4 == 1, "medium").otherwise("high").alias("strength"),
        F.when(n % 2 == 0, "earnings").otherwise("macro").alias("event_type"), F.lit("mixed").alias("session"),
    )
    out = labels.news_price_features(bars, bench(bars), outputs)
    return out.select(
        "symbol", "ts", *r6(*_NP_SQL), "label_score", "strength_score", "signed_strength", "event_earnings", "event_macro", "event_other",
        F.round("excess", 6).alias("excess"), "target_long",
    )


@query("date_split", "splits", "SELECT day, period FROM splits")
def date_split(spark, d):
    return splits(spark, d).select("day", "period")


@query("embargo", "splits", """
SELECT day, CASE WHEN period <> 'test' AND row_number() OVER (PARTITION BY period ORDER BY day DESC) <= 5 THEN 'embargo' ELSE period END AS period FROM splits""")
def embargo(spark, d):
    return labels.embargo(cut(splits(spark, d)), 5).select("day", "period")


@query("balanced_sample", "", """
WITH e AS (SELECT vec_id, label % 3 AS class, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) AS r FROM embeddings),
h AS (SELECT vec_id, class FROM e WHERE r <= 200 // 3), f AS (SELECT vec_id, class FROM e WHERE r > 200 // 3 ORDER BY vec_id LIMIT greatest(0, 200 - (SELECT count(*) FROM h)::INT))
SELECT * FROM h UNION ALL SELECT * FROM f""")
def balanced_sample(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("class"))
    return labels.balanced_sample(rows, "class", ["vec_id"], 200)


view("sector_in", "bars wcal level", """
WITH f AS (SELECT symbol, ts, h, CASE h WHEN 1 THEN lead(close, 1) OVER w WHEN 3 THEN lead(close, 3) OVER w ELSE lead(close, 5) OVER w END / close - 1 AS fwd FROM bars CROSS JOIN (SELECT unnest([1, 3, 5]) AS h) WINDOW w AS (PARTITION BY symbol, h ORDER BY pos)),
n AS (SELECT 'S' || s_suppkey AS symbol, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT ts, ci < floor(0.6::DOUBLE * (SELECT count(*) FROM wcal)) AS train FROM wcal)
SELECT f.*, sector, train FROM f JOIN n USING (symbol) JOIN p USING (ts) WHERE fwd IS NOT NULL""")


@query("sector_labels", "sector_in", """
WITH s AS (SELECT sector, h, fwd, row_number() OVER (PARTITION BY sector, h ORDER BY fwd) - 1 AS i, count(*) OVER (PARTITION BY sector, h) AS n FROM sector_in WHERE train),
t AS (SELECT sector, h, CASE WHEN max(n) < 10 THEN -0.01 ELSE max(fwd) FILTER (i = floor(0.35::DOUBLE * (n - 1))) END AS lo, CASE WHEN max(n) < 10 THEN 0.01 ELSE max(fwd) FILTER (i = floor(0.65::DOUBLE * (n - 1))) END AS hi FROM s GROUP BY 1, 2)
SELECT symbol, ts, h AS horizon, round(lo, 6) AS lower, round(hi, 6) AS upper, CASE WHEN fwd <= lo THEN 'bearish' WHEN fwd >= hi THEN 'bullish' ELSE 'neutral' END AS target FROM sector_in JOIN t USING (sector, h)""")
def sector_labels(spark, d):
    """Labels per horizon from order statistics of the sector's train rows; the sector is the supplier's nation."""
    bars = fx.bars(spark, d)
    sector = fx.suppliers(spark, d).select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.col("n_name").alias("sector"))
    horizons = (1, 3, 5)
    ahead = in_arrays(bars.select("symbol", "ts", "close", "pos"), labels.forward_returns(horizons), ["close"], [f"f{h}" for h in horizons], fwd=5)
    period = written(labels.period_of(week_calendar(bars)).select("ts", "period"), "period")
    wide = written(ahead.join(sector, "symbol").join(period, "ts").drop("close", "pos"), "ahead")  # one row a bar; horizons are laid out where they are read
    item = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("fwd")) for h in horizons])
    rows = wide.select("symbol", "ts", "sector", "period", F.explode(item).alias("x")).select("symbol", "ts", "sector", "period", "x.*").where("fwd IS NOT NULL")
    edges = written(labels.sector_thresholds(rows.where("period = 'train'"), "fwd", ["sector", "horizon"], 0.3), "edges")
    target = F.when(F.col("fwd") <= F.col("lower"), "bearish").when(F.col("fwd") >= F.col("upper"), "bullish").otherwise("neutral")
    return rows.join(edges, ["sector", "horizon"]).select("symbol", "ts", "horizon", *r6("lower", "upper"), target.alias("target"))


@query("wf_folds", "tech", """
SELECT symbol, ts, CASE WHEN i >= 100 THEN (i - 100) // 25 END AS fold, CASE WHEN i >= 100 THEN 100 + (i - 100) // 25 * 25 END AS train_end FROM (SELECT *, pos - 20 AS i FROM tech)""")
def wf_folds(spark, d):
    rows = labels.technical_features(fx.bars(spark, d)).withColumn("i", F.col("pos") - 20)
    return labels.walk_forward(rows, 100, 25, "i").select("symbol", "ts", "fold", "train_end")


@query("tile_windows", "cal", """
WITH n AS (SELECT count(*) AS n FROM cal),
w AS (SELECT 'w' || lpad((ci // 126 + 1)::VARCHAR, 2, '0') AS "window", day FROM cal, n WHERE ci // 126 < n // 126 UNION ALL SELECT 'recent_252', day FROM cal, n WHERE ci >= n - 252 AND n >= 252 UNION ALL SELECT 'full', day FROM cal)
SELECT "window", min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM w GROUP BY 1""")
def tile_windows(spark, d):
    tagged = labels.tile_windows(fx.cal(spark, d), 126)
    return tagged.groupBy("window").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


SLICES = {"spring_1996": ("1996-03-01", "1996-05-31"), "turn_1998": ("1997-12-15", "1998-01-31"), "late": ("2000-01-01", "2001-12-31")}


@query("slice_metrics", "idx_r", """
WITH s AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in SLICES.items()) + """) t(slice, a, b)),
r AS (SELECT symbol, slice, rp, ret, product(1 + ret) OVER (PARTITION BY symbol, slice ORDER BY rp) AS eq FROM idx_r JOIN s ON ts::DATE BETWEEN a AND b),
k AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, slice ORDER BY rp) - 1 AS dd FROM r)
SELECT symbol, slice, round(product(1 + ret) - 1, 6) AS total_return, round(min(ret), 6) AS worst_day, round(min(dd), 6) AS max_drawdown, count(*) AS days FROM k GROUP BY 1, 2""")
def slice_metrics(spark, d):
    """Metrics inside named date ranges."""
    rows = cut(metrics.slice_rows(index_returns(spark, d), SLICES))
    out = metrics.return_metrics(rows, ["symbol", "slice"])
    worst = rows.groupBy("symbol", "slice").agg(F.min("ret").alias("worst_day"))
    return out.join(worst, ["symbol", "slice"]).select("symbol", "slice", *r6("total_return", "worst_day", "max_drawdown"), "days")
