"""Streaming queries (R and S10) and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import calendar as cal_ops
from barline.queries import fixtures as fx
from barline.queries.registry import query, view
from barline.session import cut, scratch_path
from barline.streaming import ticks as st


def tick_stream(spark, d):
    """The events table as a tick stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return raw.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.when(F.col("event_type") == "error", "quote").otherwise("bar").alias("event_type"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.col("ts").cast("timestamp").alias("event_ts"), "event_id",
    )


def _run(spark, stream, name):
    st.use_rocksdb(spark)
    path = scratch_path(spark, name)
    st.run_to_end(stream, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


_MOVES = """
SELECT symbol, event_ts, event_id, round(prev, 6) AS prev_price, round(price, 6) AS price, side FROM (
  SELECT *, CASE WHEN prev > 0 AND price >= prev * (1 + 0.5::DOUBLE) THEN 'buy' WHEN prev > 0 AND price <= prev * (1 - 0.5::DOUBLE) THEN 'sell' END AS side FROM (
    SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY event_ts, event_id) AS prev FROM ticks WHERE event_type = 'bar')) WHERE side IS NOT NULL"""


@query("price_moves", "ticks", _MOVES)
def price_moves(spark, d):
    out = st.price_moves(fx.ticks(spark, d), 5000)
    return out.select("symbol", "event_ts", "event_id", F.round("prev_price", 6).alias("prev_price"), F.round("price", 6).alias("price"), "side")


@query("price_move_stream", "ticks", _MOVES)
def price_move_stream(spark, d):
    """The same through the stateful stream."""
    out = _run(spark, st.price_move_intents(tick_stream(spark, d), 5000), "moves")
    return out.select("symbol", "event_ts", "event_id", F.round("prev_price", 6).alias("prev_price"), F.round("price", 6).alias("price"), "side")


@query("stale_sources", "ticks", """
WITH l AS (SELECT symbol, max(event_ts) FILTER (event_type = 'quote') AS last_seen FROM ticks GROUP BY symbol)
SELECT symbol, last_seen, coalesce((SELECT max(event_ts) FROM ticks) - last_seen > INTERVAL 1 DAY, true) AS stale FROM l""")
def stale_sources(spark, d):
    """Users without a quote in the last day of the data."""
    ticks = fx.ticks(spark, d)
    last = ticks.where("event_type = 'quote'")
    sources = ticks.select("symbol").distinct().withColumn("now", ticks.agg(F.max("event_ts")).scalar())
    return st.stale_sources(last, sources, F.col("now"), 86400)


view("entries", "", "SELECT 'U' || user_id AS symbol, arg_min(value, (ts, event_id)) AS avg_entry FROM events GROUP BY 1")
_STOPS = """
SELECT symbol, event_ts, event_id, round(price, 6) AS price, round(high, 6) AS high_water, CASE WHEN price <= avg_entry * (1 - 0.5::DOUBLE) THEN 'stop_loss' WHEN price <= high * (1 - 0.8::DOUBLE) THEN 'trailing_stop' END AS reason FROM (
  SELECT t.*, avg_entry, greatest(avg_entry, max(price) OVER (PARTITION BY t.symbol ORDER BY event_ts, event_id)) AS high FROM ticks t JOIN entries USING (symbol))"""


def positions(spark, d):
    """A position per user, entered at its first price."""
    return fx.ticks(spark, d).groupBy("symbol").agg(F.min_by("price", F.struct("event_ts", "event_id")).alias("avg_entry"))


def _stop_columns(df):
    return df.select("symbol", "event_ts", "event_id", F.round("price", 6).alias("price"), F.round("high_water", 6).alias("high_water"), "reason")


@query("stream_stops", "ticks entries", _STOPS)
def stream_stops(spark, d):
    return _stop_columns(st.stops_batch(fx.ticks(spark, d), positions(spark, d), 0.5, 0.8))


@query("stop_stream", "ticks entries", _STOPS)
def stop_stream(spark, d):
    """The same through the stateful stream."""
    return _stop_columns(_run(spark, st.stream_stops(tick_stream(spark, d), positions(spark, d), 0.5, 0.8), "stops"))


@query("intraday_decisions", "ticks preds scores", """
WITH p AS (SELECT symbol, arg_max(direction, ts) AS direction, arg_max(strength, ts) AS strength FROM preds GROUP BY symbol),
s AS (SELECT symbol, arg_max(label, day) AS label, arg_max(score, day) AS score, max(day) AS day FROM scores GROUP BY symbol),
t AS (SELECT symbol, arg_max(price, (event_ts, event_id)) AS price, arg_min(price, (event_ts, event_id)) AS entry, max(price) AS high, (count(*) % 3 = 0) AS held, max(event_ts)::DATE AS last_day FROM ticks GROUP BY symbol),
j AS (SELECT t.symbol, held, direction = 'bullish' AND strength IN ('medium', 'high') AS model_long, label, score, s.day IS NULL OR (SELECT max(event_ts) FROM ticks)::DATE - s.day > 2 AS stale,
  CASE WHEN price <= entry * 0.5::DOUBLE THEN 'stop_loss' WHEN price <= high * (1 - 0.99::DOUBLE) THEN 'trailing_stop' END AS stop_reason, last_day < (SELECT max(event_ts) FROM ticks)::DATE AS exited_today
  FROM t LEFT JOIN p USING (symbol) LEFT JOIN s USING (symbol))
SELECT symbol, CASE WHEN held AND stop_reason IS NOT NULL THEN stop_reason WHEN held AND (NOT model_long OR coalesce(NOT stale AND (label = 'bearish' OR score < 0), false)) THEN 'intraday_signal_exit'
  WHEN NOT held AND model_long AND coalesce(NOT stale AND label = 'bullish' AND score > 0, false) AND NOT exited_today THEN 'intraday_signal_entry' ELSE 'no_action' END AS action FROM j""")
def intraday_decisions(spark, d):
    """One decision per user at the end of the data, from its newest prediction, score and prices."""
    at = F.struct("event_ts", "event_id")
    ticks = fx.ticks(spark, d)
    price = ticks.groupBy("symbol").agg(
        F.max_by("price", at).alias("price"), F.min_by("price", at).alias("entry"), F.max("price").alias("high"), F.count("*").alias("n"), F.to_date(F.max("event_ts")).alias("last_day")
    )
    pred = fx.preds(spark, d).groupBy("symbol").agg(F.max_by("direction", "ts").alias("direction"), F.max_by("strength", "ts").alias("strength"))
    score = fx.scores(spark, d).groupBy("symbol").agg(F.max_by("label", "day").alias("label"), F.max_by("score", "day").alias("score"), F.max("day").alias("day"))
    rows = price.join(pred, "symbol", "left").join(score, "symbol", "left").withColumn("today", ticks.agg(F.to_date(F.max("event_ts"))).scalar()).select(
        "symbol", F.when(F.col("n") % 3 == 0, 1.0).otherwise(0.0).alias("qty"),
        ((F.col("direction") == "bullish") & F.col("strength").isin("medium", "high")).alias("model_long"), "label", "score",
        (F.col("day").isNull() | (F.date_diff("today", "day") > 2)).alias("stale"),
        F.when(F.col("price") <= F.col("entry") * 0.5, "stop_loss").when(F.col("price") <= F.col("high") * (1 - 0.99), "trailing_stop").alias("stop_reason"),
        (F.col("last_day") < F.col("today")).alias("exited_today"),
    )
    return st.intraday_decisions(rows)


_BARS_1H = """
SELECT symbol, date_trunc('hour', event_ts)::TIMESTAMP AS ts, round(arg_min(price, (event_ts, event_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (event_ts, event_id)), 6) AS close, sum(volume) AS volume
FROM ticks WHERE event_type = 'bar' GROUP BY 1, 2"""


@query("bars_1h", "ticks", _BARS_1H)
def bars_1h(spark, d):
    return st.tick_bars(fx.ticks(spark, d), "1 hour").select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("stream_bars", "ticks", _BARS_1H)
def stream_bars(spark, d):
    """Hourly bars through the stream alone: partial bars of every micro-batch in a store, merged when read."""
    st.use_rocksdb(spark)
    path = scratch_path(spark, "bars")
    st.write_bars(st.clean_ticks(tick_stream(spark, d), "1 hour"), f"{path}/store", f"{path}/state", "1 hour").awaitTermination()
    return st.read_bars(spark, f"{path}/store").select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("tick_sessions", "ticks", """
WITH g AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY symbol ORDER BY event_ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM ticks),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY event_ts, event_id) AS sid FROM g)
SELECT symbol, min(event_ts) AS start, max(event_ts) + INTERVAL 1 HOUR AS "end", count(*) AS ticks, round(max(price), 6) AS high, round(min(price), 6) AS low FROM s GROUP BY symbol, sid""")
def tick_sessions(spark, d):
    return st.sessions_batch(fx.ticks(spark, d), 3600).select("symbol", "start", "end", "ticks", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


@query("stream_fanout", "ticks", "SELECT symbol, event_id, round(price, 6) AS price FROM ticks")
def stream_fanout(spark, d):
    """Every tick written to a store and an audit log by one stream; the store is read back."""
    path = scratch_path(spark, "fanout")
    q = st.fan_out(tick_stream(spark, d), f"{path}/store", f"{path}/audit", f"{path}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/store").select("symbol", "event_id", F.round("price", 6).alias("price"))


@query("regular_bars", "ticks", """
SELECT symbol, count(*) AS bars FROM (SELECT DISTINCT symbol, date_trunc('hour', event_ts) AS h FROM ticks WHERE event_type = 'bar') WHERE hour(((h AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) BETWEEN 9 AND 15 GROUP BY symbol""")
def regular_bars(spark, d):
    """Regular-hours bars per user built from ticks."""
    bars = cal_ops.regular_hours(cut(st.tick_bars(fx.ticks(spark, d), "1 hour")))
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"))
