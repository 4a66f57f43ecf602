"""Sources, sinks, calendar and join queries (S, W, A and J family)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from barline.functions import ts
from barline.operators import books, calendar as cal_ops, joins
from barline.operators.news import effective_day
from barline.plans.blocks import in_blocks, number_rows
from barline.queries import fixtures as fx
from barline.queries.registry import query, view
from barline.queries.timeseries import panel
from barline.session import cut, scratch_path
from barline.sources import readers, sinks


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def r12(*cols):
    """For averages of exact decimals, which may lie on a boundary of fewer digits."""
    return [F.round(c, 12).alias(c) for c in cols]


# ---- sources


@query("bars_clean", "lines", """
SELECT symbol, ts, round(px, 6) AS close FROM (
  SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, px, row_number() OVER (PARTITION BY l_suppkey, l_shipdate
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC, px DESC) AS r FROM lines) WHERE r = 1""")
def bars_clean(spark, d):
    """Line items of one supplier and day stand for repeated deliveries of one bar; the last one is kept."""
    raw = fx.table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").alias("ts"), fx._px().alias("open"),
        fx._px().alias("close"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    )
    out = readers.clean_bars(raw, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "close"])
    return out.select("symbol", "ts", F.round("close", 6).alias("close"))


@query("tail_bars", "bars", """
SELECT symbol, ts, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r <= 21""")
def tail_bars(spark, d):
    return books.tail_bars(fx.bars(spark, d), cal_ops.window_bars("1m")).select("symbol", "ts", F.round("close", 6).alias("close"))


@query("index_csv", "", "SELECT 'orders' AS name, o_orderdate AS ts, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_orderdate")
def index_csv(spark, d):
    """Every order as a CSV line with one of three date formats; read back through the CSV reader."""
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")
    ).otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    rows = fx.table(spark, d, "orders").select(day.alias("DATE"), F.col("o_orderkey").alias("OPEN"), F.col("o_totalprice").alias("CLOSE"))
    return readers.parse_index(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]), "orders", F.col("OPEN").cast("bigint"))


@query("rates_to_bars", "", """
SELECT r AS symbol, day::TIMESTAMP AS ts, round(px, 6) AS open, round(px, 6) AS high, round(px, 6) AS low, round(px, 6) AS close FROM (
  SELECT o_orderstatus AS r, o_orderdate::DATE AS day, max(o_totalprice) AS px FROM orders GROUP BY 1, 2)""")
def rates_to_bars(spark, d):
    """Highest order per status and day as quotes, packed into one JSON payload per month."""
    quotes = fx.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.max("o_totalprice").alias("px"))
    days = quotes.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "px"))).alias("q"))
    months = days.groupBy(F.trunc("day", "month")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), "q"))).alias("rates"))).alias("payload")
    )
    return readers.rates_to_bars(months).select("symbol", "ts", *r6("open", "high", "low", "close"))


@query("articles_dedup", "", "SELECT event_id AS article_id, ts AS created_at, 'U' || user_id AS symbol FROM events")
def articles_dedup(spark, d):
    """Two overlapping page sets of the same articles give each article once."""
    page = fx.table(spark, d, "events").select(
        F.col("event_id").alias("article_id"), F.col("ts").alias("created_at"), F.concat(F.lit("U"), F.col("user_id")).alias("symbol")
    )
    return readers.dedup_articles(page.unionByName(page.where("symbol >= 'U5'")))


@query("page_dates", "", """
WITH p AS (SELECT page_id, html || '<a href="/monetary' || strftime(o_orderdate, '%Y%m%d') || 'a.htm">' AS html
  FROM pages JOIN orders ON o_orderkey = page_id),
f AS (SELECT DISTINCT strptime(unnest(regexp_extract_all(html, 'monetary(\\d{8})a', 1)), '%Y%m%d')::DATE AS day FROM p)
SELECT day, year(day)::INTEGER AS year, count(*) OVER (PARTITION BY year(day)) AS per_year, count(*) OVER (PARTITION BY year(day)) <> 8 AS unexpected FROM f""")
def page_dates(spark, d):
    """Each page gets a dated link (the date of the order with its number) and is then searched as a whole."""
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"))
    pages = fx.table(spark, d, "pages").join(orders, "page_id").select(
        F.concat(F.col("html"), F.lit('<a href="/monetary'), F.col("stamp"), F.lit('a.htm">')).alias("html")
    )
    return readers.dates_from_pages(pages, r"monetary(\d{8})a")


@query("jsonl_read", "", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_read(spark, d):
    """Conversations as JSON lines, up to eight turns run together on a line."""
    rows = fx.table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("o"))
    # At most eight turns per line, so a very long conversation becomes many lines.
    lines = rows.groupBy("conv_id", F.floor(F.col("turn") / 8)).agg(F.array_join(F.sort_array(F.collect_list("o")), " ").alias("value"))
    return readers.split_json_lines(lines, "conv_id bigint, turn bigint, role string, text string").drop("_corrupt")


@query("scores_latest", "", """
SELECT symbol, day, round(score, 6) AS score FROM (SELECT 'U' || user_id AS symbol, ts::DATE AS day, value AS score,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def scores_latest(spark, d):
    rows = fx.table(spark, d, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.to_date("ts").alias("day"), F.round("value", 6).alias("score"), "ts", "event_id"
    )
    return readers.latest_per(rows, ["symbol", "day"], ["ts", "event_id"]).drop("ts", "event_id")


# ---- sinks


@query("latest_book", "runs", """
SELECT symbol, strategy, run_id, round(total_return, 6) AS total_return FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, strategy ORDER BY created_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1""")
def latest_book(spark, d):
    out = sinks.upsert_view(fx.runs(spark, d), ["symbol", "strategy"], ["created_at", "run_id"])
    return out.select("symbol", "strategy", "run_id", F.round("total_return", 6).alias("total_return"))


@query("line_protocol", "ticks", """
SELECT 'market_events,symbol=' || symbol || ',event_type=' || event_type || ' price=' || price::VARCHAR || ',volume=' || volume::VARCHAR || ',received_ts_ns=' || (epoch_us(received_ts) * 1000)::VARCHAR || ' ' || (epoch_us(event_ts) * 1000)::VARCHAR AS line FROM ticks""")
def line_protocol(spark, d):
    return sinks.to_line_protocol(fx.ticks(spark, d))


@query("tick_count", "ticks", "SELECT count(*) AS ticks FROM ticks")
def tick_count(spark, d):
    return fx.ticks(spark, d).agg(F.count("*").alias("ticks"))


# ---- calendar


@query("aligned", "bars wcal", """
SELECT s.symbol, c.ts, c.ci, round(b.close, 6) AS close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN wcal c
LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = c.ts""")
def aligned(spark, d):
    out = cal_ops.align_calendar(cut(fx.bars(spark, d)))
    return out.select("symbol", "ts", "ci", F.round("close", 6).alias("close"))


@query("min_history", "bars", """
SELECT symbol, ts, round(close, 6) AS close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n >= 290""")
def min_history(spark, d):
    return cal_ops.min_history(fx.bars(spark, d), 290).select("symbol", "ts", F.round("close", 6).alias("close"))


@query("derived", "bars_r", "SELECT symbol, ts, round(vwap, 6) AS vwap, round(ret, 6) AS ret FROM bars_r")
def derived(spark, d):
    from barline.queries.timeseries import with_returns

    return in_blocks(fx.bars(spark, d), with_returns, back=1).select("symbol", "ts", *r6("vwap", "ret"))


@query("fwd_excess", "bars_r", """
WITH m AS (SELECT ts, avg(close) AS level FROM bars GROUP BY ts),
f AS (SELECT symbol, ts, fwd5, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY pos) AS ets FROM bars_r)
SELECT symbol, f.ts, round(coalesce(fwd5, 0), 6) AS fwd, round(coalesce(fwd5, 0) - coalesce(e.level / s.level - 1, 0), 6) AS excess
FROM f LEFT JOIN m s ON s.ts = f.ts LEFT JOIN m e ON e.ts = f.ets""")
def fwd_excess(spark, d):
    """Forward return over five bars and its excess over the mean level of all symbols at both ends."""
    bars = fx.bars(spark, d)
    level = bars.groupBy("ts").agg(F.avg("close").alias("level"))
    out = in_blocks(
        bars, lambda r, w: r.withColumns({"fwd": ts.forward_return("close", 5, w), "ets": F.lead("ts", 5).over(w)}), fwd=5
    )
    start, end = level.withColumnRenamed("level", "l0"), level.select(F.col("ts").alias("ets"), F.col("level").alias("l1"))
    out = out.join(start, "ts", "left").join(end, "ets", "left")
    fwd = F.coalesce("fwd", F.lit(0.0))
    return out.select(
        "symbol", "ts", F.round(fwd, 6).alias("fwd"), F.round(fwd - F.coalesce(F.col("l1") / F.col("l0") - 1, F.lit(0.0)), 6).alias("excess")
    )


@query("regular_hours", "bars_h", """
SELECT symbol, ts, round(close, 6) AS close FROM bars_h WHERE hour(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) BETWEEN 9 AND 15""")
def regular_hours(spark, d):
    return cal_ops.regular_hours(fx.bars_h(spark, d)).select("symbol", "ts", F.round("close", 6).alias("close"))


@query("opex_dates", "cal", """
WITH f AS (SELECT day, date_trunc('month', day)::DATE AS m, row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS r FROM cal WHERE dayofweek(day) = 5),
t AS (SELECT m, m + ((5 - dayofweek(m) + 7) % 7)::INTEGER + 14 AS third FROM (SELECT DISTINCT date_trunc('month', day)::DATE AS m FROM cal)),
b AS (SELECT t.m, max(c.day) AS day FROM t JOIN cal c ON date_trunc('month', c.day)::DATE = t.m AND c.day <= t.third GROUP BY t.m)
SELECT t.m AS month, coalesce(f.day, b.day) AS expiry FROM t LEFT JOIN f ON f.m = t.m AND f.r = 3 LEFT JOIN b ON b.m = t.m WHERE coalesce(f.day, b.day) IS NOT NULL""")
def opex_dates(spark, d):
    return cal_ops.opex_dates(fx.cal(spark, d))


view("opex", "cal", """
SELECT coalesce(max(day) FILTER (dayofweek(day) = 5 AND r = 3), max(day) FILTER (day <= third)) AS expiry FROM (
  SELECT day, date_trunc('month', day)::DATE AS m, date_trunc('month', day)::DATE + ((5 - dayofweek(date_trunc('month', day)) + 7) % 7)::INTEGER + 14 AS third,
    row_number() OVER (PARTITION BY date_trunc('month', day), dayofweek(day) ORDER BY day) AS r FROM cal) GROUP BY m""")


@query("opex_week", "cal opex", """
SELECT day, ci, EXISTS (SELECT 1 FROM opex WHERE day <= expiry AND day >= date_trunc('week', expiry)::DATE) AS in_opex_week FROM cal""")
def opex_week(spark, d):
    return cal_ops.opex_week(fx.cal(spark, d))


@query("turn_of_month", "cal", """
SELECT day, ci, (row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day) <= 3 OR row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day DESC) <= 4) AS turn FROM cal""")
def turn_of_month(spark, d):
    return cal_ops.turn_of_month(fx.cal(spark, d))


@query("quarter_ends", "cal", "SELECT year(day)::INTEGER AS year, quarter(day)::INTEGER AS quarter, max(day) AS day FROM cal GROUP BY 1, 2")
def quarter_ends(spark, d):
    return cal_ops.quarter_ends(fx.cal(spark, d))


@query("reaction_day", "", "SELECT event_id, CASE WHEN hour(ts) >= 16 THEN ts::DATE + 1 ELSE ts::DATE END AS reaction FROM events")
def reaction_day(spark, d):
    return fx.table(spark, d, "events").select("event_id", cal_ops.reaction_day(F.col("ts")).alias("reaction"))


@query("reaction_day_snap", "cal", """
SELECT e.event_id, c.day AS reaction FROM (SELECT event_id, CASE WHEN hour(ts) >= 16 THEN ts::DATE + 1 ELSE ts::DATE END AS d FROM events) e ASOF LEFT JOIN cal c ON e.d <= c.day""")
def reaction_day_snap(spark, d):
    """The reaction day moved on to a trading day."""
    events = fx.table(spark, d, "events").select("event_id", "ts")
    return cal_ops.reaction_trading_day(events, fx.cal(spark, d)).select("event_id", "reaction")


@query("scaled_volume", "bars", "SELECT symbol, ts, round(coalesce(volume, 0) * 0.25::DOUBLE, 6) AS volume, round(close * coalesce(volume, 0) * 0.25::DOUBLE, 4) AS dollar_volume FROM bars")
def scaled_volume(spark, d):
    """Bars as a quarter of the market would see them."""
    rows = cal_ops.scale_volume(fx.bars(spark, d), 0.25)
    return rows.select("symbol", "ts", F.round("volume", 6).alias("volume"), F.round(F.col("close") * F.col("volume"), 4).alias("dollar_volume"))


@query("periods", "bars_h", """
SELECT symbol, round(greatest(252.0::DOUBLE, 252.0::DOUBLE * count(*) / count(DISTINCT ts::DATE)), 6) AS periods FROM bars_h GROUP BY symbol""")
def periods(spark, d):
    return cal_ops.periods_per_year(fx.bars_h(spark, d)).select("symbol", F.round("periods", 6).alias("periods"))


# ---- joins


@query("attach_default", "bars_h scores", """
SELECT b.symbol, b.ts, coalesce(score, 0.0::DOUBLE) AS score, coalesce(label, 'neutral') AS label FROM bars_h b
LEFT JOIN scores s ON s.symbol = b.symbol AND s.day = b.ts::DATE""")
def attach_default(spark, d):
    bars = fx.bars_h(spark, d).select("symbol", "ts", F.to_date("ts").alias("day"))
    return joins.attach(bars, fx.scores(spark, d), ["symbol", "day"], {"score": 0.0, "label": "neutral"}).drop("day")


# A weekday calendar of the events' own month; every weekday is a trading day.
view("ecal", "", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS ci FROM (SELECT DISTINCT ts::DATE AS day FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)")


def event_calendar(spark, d):
    days = fx.table(spark, d, "events").where(F.dayofweek("ts").between(2, 6)).select(F.to_date("ts").alias("day")).distinct()
    return number_rows(days, [], ["day"], pos="ci")


view("eff", "ecal", """
SELECT a.event_id AS article_id, ts AS created_at, 'U' || user_id AS symbol, (SELECT min(day) FROM ecal WHERE day >= CASE WHEN hour(lt) >= 16 THEN lt::DATE + 1 ELSE lt::DATE END) AS trading_day, lt
FROM (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS lt FROM events) a""")


@query("effective_day", "eff", "SELECT article_id, trading_day FROM eff WHERE trading_day IS NOT NULL")
def effective_days(spark, d):
    stamps = fx.table(spark, d, "events").select(F.col("event_id").alias("article_id"), F.col("ts").alias("created_at"))
    return effective_day(stamps, event_calendar(spark, d)).select("article_id", "trading_day")


@query("session_counts", "eff", """
SELECT trading_day, CASE WHEN lt::DATE < trading_day THEN 'post_close' WHEN hour(lt) * 60 + minute(lt) < 570 THEN 'pre_market' WHEN hour(lt) >= 16 THEN 'post_close' ELSE 'intraday' END AS session,
  count(*) AS articles FROM eff WHERE trading_day IS NOT NULL GROUP BY 1, 2""")
def session_counts(spark, d):
    stamps = fx.table(spark, d, "events").select(F.col("event_id").alias("article_id"), F.col("ts").alias("created_at"))
    days = effective_day(stamps, event_calendar(spark, d))
    label = cal_ops.session_label(F.col("created_at"), F.col("trading_day"))
    return days.groupBy("trading_day", label.alias("session")).agg(F.count("*").alias("articles"))


view("rbars_h", "bars_h", "SELECT * FROM bars_h WHERE hour(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) BETWEEN 9 AND 15")


@query("next_bar", "rbars_h", """
SELECT event_id AS article_id, min(b.ts) AS bar_ts FROM events e JOIN rbars_h b ON b.symbol = 'U' || e.user_id AND b.ts >= e.ts GROUP BY event_id""")
def next_bar(spark, d):
    """First regular-hours bar at or after each article of a user."""
    stamps = fx.table(spark, d, "events").select(
        F.col("event_id").alias("article_id"), F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("ts").alias("created_at")
    )
    out = joins.next_bar(stamps, cal_ops.regular_hours(fx.bars_h(spark, d)))
    return out.select("article_id", "bar_ts")


@query("snap_events", "cal", """
SELECT page_id, day, (SELECT min(c.day) FROM cal c WHERE c.day >= e.day) AS trading_day FROM (
  SELECT page_id, o_orderdate::DATE AS day FROM pages JOIN orders ON o_orderkey = page_id) e WHERE trading_day IS NOT NULL""")
def snap_events(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.to_date("o_orderdate").alias("day"))
    events = fx.table(spark, d, "pages").select("page_id").join(orders, "page_id")
    return joins.snap_events(events, fx.cal(spark, d)).select("page_id", "day", "trading_day")


view("rpreds", "preds rbars_h", "SELECT p.* FROM preds p JOIN rbars_h b ON b.symbol = p.symbol AND b.ts = p.ts")


@query("asof_pred", "bars_h rpreds", """
SELECT b.symbol, b.ts, p.ts AS matched_ts, p.direction, p.strength FROM bars_h b ASOF LEFT JOIN rpreds p ON b.symbol = p.symbol AND b.ts >= p.ts""")
def asof_pred(spark, d):
    """Predictions exist in regular hours only; every bar sees the latest one."""
    hourly = cut(fx.bars_h(spark, d))
    preds = fx.preds_of(cal_ops.regular_hours(hourly))
    out = joins.asof_backward(hourly.select("symbol", "ts"), preds, ["direction", "strength"])
    return out.select("symbol", "ts", "matched_ts", "direction", "strength")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_SERIES = {r: r.lower().replace(" ", "_") for r in _REGIONS}


@query("outer_series", "idx", "SELECT ts, " + ", ".join(f"round(max(close) FILTER (symbol = '{r}'), 6) AS {n}" for r, n in _SERIES.items()) + " FROM idx GROUP BY ts")
def outer_series(spark, d):
    """Daily closes of all regions side by side."""
    daily = cut(fx.idx(spark, d))
    parts = {name: daily.where(F.col("symbol") == region).select("ts", F.col("close").alias("value")) for region, name in _SERIES.items()}
    return joins.outer_series(parts).select("ts", *r6(*_SERIES.values()))


@query("missing_scores", "bars_h scores", """
SELECT DISTINCT symbol, ts::DATE AS trading_day FROM bars_h EXCEPT SELECT symbol, day FROM scores""")
def missing_scores(spark, d):
    days = fx.bars_h(spark, d).select("symbol", F.to_date("ts").alias("trading_day")).distinct()
    return joins.missing_scores(days, fx.scores(spark, d).withColumnRenamed("day", "trading_day"), ("symbol", "trading_day"))


view("idx_r", "idx", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rp FROM (SELECT symbol, ts, close, open, pos, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS ret FROM idx) WHERE ret IS NOT NULL")
view("idx_ev", "idx_r", "SELECT symbol, max(ts) AS ts FROM idx_r GROUP BY symbol, date_trunc('month', ts)")


def index_returns(spark, d):
    """Daily region returns, numbered without the first day."""
    rows = books.with_simple_return(fx.idx(spark, d)).where("ret IS NOT NULL")
    return rows.withColumn("pos", F.col("pos") - 1)


def month_end_events(returns):
    return returns.groupBy("symbol", F.trunc("ts", "month").alias("_m")).agg(F.max("ts").alias("ts")).drop("_m")


@query("event_windows", "idx_r idx_ev", """
SELECT e.symbol, e.ts AS event_ts, (r.rp - a.rp)::INTEGER AS offset, round(r.ret, 6) AS ret FROM idx_ev e JOIN idx_r a USING (symbol, ts)
JOIN (SELECT symbol, max(rp) AS last FROM idx_r GROUP BY symbol) l ON l.symbol = e.symbol
JOIN idx_r r ON r.symbol = e.symbol AND r.rp BETWEEN a.rp - 5 AND a.rp + 5 WHERE a.rp >= 5 AND a.rp + 5 <= l.last""")
def event_windows(spark, d):
    returns = cut(index_returns(spark, d))
    out = joins.event_windows(returns, month_end_events(returns), 5, 5)
    return out.select("symbol", "event_ts", "offset", F.round("ret", 6).alias("ret"))


GRID_VALUES = {
    "stop_loss": (0.04, 0.05, 0.06), "trail": (0.01, 0.015, 0.02), "time_stop": (10, 20, 30), "cooldown": (1, 2), "same_day": (False, True), "break_even": (False, True), "profit_lock": (False, True),
}
GRID = [dict(zip(GRID_VALUES, values)) for values in itertools.product(*GRID_VALUES.values())]
_SQL_GRID = ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}]){'::DOUBLE' if isinstance(v[0], float) else ''} AS {k})" for k, v in GRID_VALUES.items())


@query("param_grid", "bars", f"""
SELECT symbol, {', '.join(GRID_VALUES)}, round(low * (1 - stop_loss), 6) AS lowest_stop, bars FROM (SELECT symbol, min(close) AS low, count(*) AS bars FROM bars GROUP BY symbol), {_SQL_GRID}""")
def param_grid(spark, d):
    """All 432 settings of the rule grid for every symbol, with the lowest stop price that a setting can have."""
    lows = fx.bars(spark, d).groupBy("symbol").agg(F.min("close").alias("low"), F.count("*").alias("bars"))
    return joins.with_params(lows, GRID).select("symbol", *GRID_VALUES, F.round(F.col("low") * (1 - F.col("stop_loss")), 6).alias("lowest_stop"), "bars")


@query("rule_delta", "runs", """
WITH m AS (SELECT symbol, strategy, cost_profile, avg(total_return) AS r, min(max_drawdown) AS w FROM runs GROUP BY 1, 2, 3)
SELECT a.symbol, a.strategy, round(a.r, 12) AS r_a, round(b.r, 12) AS r_b, round(b.r - a.r, 12) AS r_delta, round(a.w, 12) AS w_a, round(b.w, 12) AS w_b, round(b.w - a.w, 12) AS w_delta
FROM m a JOIN m b ON a.symbol = b.symbol AND a.strategy = b.strategy WHERE a.cost_profile = 'F' AND b.cost_profile = 'O'""")
def rule_delta(spark, d):
    means = fx.runs(spark, d).groupBy("symbol", "strategy", "cost_profile").agg(
        F.avg("total_return").alias("r"), F.min("max_drawdown").alias("w")
    )
    out = joins.delta(means.where("cost_profile = 'F'"), means.where("cost_profile = 'O'"), ["symbol", "strategy"], ["r", "w"])
    return out.select("symbol", "strategy", *r12("r_a", "r_b", "r_delta", "w_a", "w_b", "w_delta"))


@query("vol_panel", "panel", "SELECT ts, round(vix, 6) AS vix, round(vvix, 6) AS vvix FROM panel")
def vol_panel(spark, d):
    return panel(spark, d).select("ts", *r6("vix", "vvix"))


@query("examples_json", "", "SELECT md5(text) AS prompt_md5, lang AS completion, length(text) AS n_chars FROM documents")
def examples_json(spark, d):
    """Write prompt / completion examples of every document to JSON lines and read them back."""
    docs = fx.table(spark, d, "documents").select(F.col("text").alias("prompt"), F.col("lang").alias("completion"))
    path = scratch_path(spark, "examples")
    sinks.export_examples(docs, path)
    back = readers.read_jsonl(spark, path, "prompt string, completion string")
    return back.select(F.md5("prompt").alias("prompt_md5"), "completion", F.length("prompt").cast("bigint").alias("n_chars"))
