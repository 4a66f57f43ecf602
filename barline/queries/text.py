"""News and text queries (N family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import calendar as cal_ops, joins, news
from barline.queries import fixtures as fx
from barline.queries.registry import query, view
from barline.queries.tables import event_calendar, r6
from barline.session import cut

_SP = news.SPACES.replace("'", "''")
_EVENT_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in news.EVENT_KEYWORDS
) + " ELSE 'other' END"
_LINE = f"trim(regexp_replace(headline, '{_SP}', ' ', 'g')) || CASE WHEN trim(regexp_replace(summary, '{_SP}', ' ', 'g')) <> '' THEN ' Summary: ' || trim(regexp_replace(summary, '{_SP}', ' ', 'g')) ELSE '' END"
_MAJ = """CASE WHEN (n_pre = top AND n_pre > 0)::INT + (n_intra = top AND n_intra > 0)::INT + (n_post = top AND n_post > 0)::INT <> 1 THEN 'mixed'
  WHEN n_pre = top THEN 'pre_market' WHEN n_intra = top THEN 'intraday' ELSE 'post_close' END"""

view("bundles", "articles eff", f"""
WITH a AS (SELECT a.*, e.trading_day, e.lt, row_number() OVER (PARTITION BY a.symbol, e.trading_day ORDER BY a.created_at, a.article_id) AS r
  FROM articles a JOIN eff e USING (article_id) WHERE e.trading_day IS NOT NULL),
s AS (SELECT *, CASE WHEN lt::DATE < trading_day THEN 'post' WHEN hour(lt) * 60 + minute(lt) < 570 THEN 'pre' WHEN hour(lt) >= 16 THEN 'post' ELSE 'intra' END AS sess, r || '. ' || {_LINE} AS line FROM a WHERE r <= 5),
g AS (SELECT symbol, trading_day, string_agg(article_id, ',' ORDER BY r) AS article_ids, count(*)::INTEGER AS headline_count, string_agg(line, chr(10) ORDER BY r) AS text,
  count(*) FILTER (sess = 'pre') AS n_pre, count(*) FILTER (sess = 'intra') AS n_intra, count(*) FILTER (sess = 'post') AS n_post FROM s GROUP BY 1, 2),
t AS (SELECT *, greatest(n_pre, n_intra, n_post) AS top FROM g)
SELECT symbol, trading_day, article_ids, headline_count, text, n_pre, n_intra, n_post, {_MAJ} AS session, {_EVENT_CASE.format('text')} AS event_type FROM t""")


def bundles(spark, d):
    days = news.effective_day(fx.article_stamps(spark, d), event_calendar(spark, d))
    return news.bundle_news(days, fx.article_texts(spark, d), ["symbol", "trading_day"])


@query("news_bundles", "bundles", "SELECT symbol, trading_day, article_ids, headline_count, length(text) AS n_chars, md5(text) AS text_md5, n_pre, n_intra, n_post, session, event_type FROM bundles")
def news_bundles(spark, d):
    """First five articles per user and trading day as one numbered text (compared by length and hash)."""
    return bundles(spark, d).select(
        "symbol", "trading_day", F.array_join(F.col("article_ids").cast("array<string>"), ",").alias("article_ids"), "headline_count",
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"), "n_pre", "n_intra", "n_post", "session", "event_type",
    )


@query("bar_bundles", "articles rbars_h", f"""
WITH n AS (SELECT a.article_id, min(b.ts) AS bar_ts FROM articles a JOIN rbars_h b ON b.symbol = a.symbol AND b.ts >= a.created_at GROUP BY 1),
s AS (SELECT a.symbol, bar_ts, a.article_id, row_number() OVER (PARTITION BY a.symbol, bar_ts ORDER BY created_at, a.article_id) AS r, {_LINE} AS line FROM articles a JOIN n USING (article_id))
SELECT symbol, bar_ts, count(*)::INTEGER AS headline_count, md5(string_agg(r || '. ' || line, chr(10) ORDER BY r)) AS text_md5 FROM s WHERE r <= 5 GROUP BY 1, 2""")
def bar_bundles(spark, d):
    """The same per regular-hours bar of the user."""
    placed = joins.next_bar(fx.article_stamps(spark, d), cal_ops.regular_hours(fx.bars_h(spark, d)))
    out = news.bundle_news(placed, fx.article_texts(spark, d), ["symbol", "bar_ts"], day="bar_ts")
    return out.select("symbol", "bar_ts", "headline_count", F.md5("text").alias("text_md5"))


@query("majority_session", "bundles", "SELECT session, count(*) AS bundles FROM bundles GROUP BY 1")
def majority_session(spark, d):
    days = news.effective_day(fx.article_stamps(spark, d), event_calendar(spark, d))
    return news.bundle_heads(days, ["symbol", "trading_day"]).groupBy("session").agg(F.count("*").alias("bundles"))


@query("event_type", "", f"SELECT doc_id, {_EVENT_CASE.format('text')} AS event_type FROM documents")
def event_type(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", news.event_type(F.col("text")).alias("event_type"))


_TYPES = "earnings, guidance, analyst, mna, regulatory, litigation, product, macro, other"
_BODY = "'Symbol: ' || symbol || chr(10) || 'Trading day: ' || trading_day::VARCHAR || chr(10) || 'Session context: ' || session || chr(10) || 'Headline count: ' || headline_count || chr(10) || 'Headlines:' || chr(10) || text || chr(10) || chr(10) || 'JSON:'"
_LABEL_PROMPT = f"'You are a financial news analyst. Read the stock-specific news bundle and return compact JSON with keys label, strength, event_type, session, horizon. label must be bullish, bearish, or neutral. strength must be low, medium, or high. event_type must be one of {_TYPES}. session must be pre_market, intraday, post_close, or mixed. horizon must be 5d.' || chr(10) || chr(10) || {_BODY}"
_DIR_PROMPT = f"'You are a financial news directional forecaster. Read the stock-specific news bundle and return compact JSON with keys direction, strength, relative_to_spy, event_type, session, horizon. direction must be bullish, bearish, or neutral. strength must be low, medium, or high. relative_to_spy must be outperform, underperform, or inline. event_type must be one of {_TYPES}. session must be pre_market, intraday, post_close, or mixed. horizon must be 5d.' || chr(10) || chr(10) || {_BODY}"


@query("prompts", "bundles", f"""
SELECT symbol, trading_day, md5({_LABEL_PROMPT}) AS label_prompt, md5({_DIR_PROMPT}) AS direction_prompt,
  '{{"label":"neutral","strength":"low","event_type":"' || event_type || '","session":"' || session || '","horizon":"5d"}}' AS completion FROM bundles""")
def prompts(spark, d):
    done = news.completion({"label": F.lit("neutral"), "strength": F.lit("low"), "event_type": F.col("event_type"), "session": F.col("session"), "horizon": F.lit("5d")})
    return bundles(spark, d).select(
        "symbol", "trading_day", F.md5(news.prompt("label")).alias("label_prompt"), F.md5(news.prompt("direction")).alias("direction_prompt"), done.alias("completion")
    )


@query("prompt_hash", "bundles", f"SELECT symbol, trading_day, sha256({_LABEL_PROMPT} || 'base-model' || 'v1') AS prompt_hash FROM bundles")
def prompt_hash(spark, d):
    return bundles(spark, d).select("symbol", "trading_day", news.prompt_hash(news.prompt("label"), "base-model", "v1").alias("prompt_hash"))


# Model answers: the document as prose around a JSON object whose values come from the document's number.
view("answers", "", """
SELECT doc_id, text || chr(10) || '{"direction": "' || CASE doc_id % 4 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'bearish' WHEN 2 THEN ' neutral ' ELSE 'sideways' END
  || '", "strength": "' || CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'huge' END || '", "relative_to_spy": "' || CASE doc_id % 2 WHEN 0 THEN 'outperform' ELSE 'underperform' END || '"'
  || CASE doc_id % 5 WHEN 0 THEN ', "event_type": " Earnings "' WHEN 1 THEN ', "session": "Intraday", "event_type": "merger"' WHEN 2 THEN ', "session": "post_close"' WHEN 3 THEN ', "event_type": null' ELSE '' END
  || CASE WHEN lang = 'en' THEN '}' ELSE '} Done.' END || CASE WHEN source LIKE '%forum%' THEN ' }' ELSE '' END AS completion FROM documents""")


def answers(spark, d):
    i = F.col("doc_id")
    pick = lambda n, names: F.get(F.array(*[F.lit(x) for x in names]), (i % n).cast("int"))
    body = F.concat(
        F.col("text"), F.lit('\n{"direction": "'), pick(4, ["Bullish", "bearish", " neutral ", "sideways"]), F.lit('", "strength": "'),
        pick(3, ["high", "medium", "huge"]), F.lit('", "relative_to_spy": "'), pick(2, ["outperform", "underperform"]), F.lit('"'),
        pick(5, [', "event_type": " Earnings "', ', "session": "Intraday", "event_type": "merger"', ', "session": "post_close"', ', "event_type": null', ""]),
        F.when(F.col("lang") == "en", "}").otherwise("} Done."), F.when(F.col("source").contains("forum"), " }").otherwise(""),
    )
    return fx.table(spark, d, "documents").select("doc_id", body.alias("completion"))


_RAW = "regexp_extract(completion, '(?s)\\{.*\\}')"


@query("parse_completions", "answers", f"""
WITH r AS (SELECT doc_id, CASE WHEN json_valid({_RAW}) THEN {_RAW} ELSE '{{}}' END AS j FROM answers),
v AS (SELECT doc_id, lower(trim(j->>'direction')) AS d, lower(trim(j->>'strength')) AS s, lower(trim(j->>'relative_to_spy')) AS r, lower(trim(j->>'event_type')) AS e, lower(trim(j->>'session')) AS n FROM r)
SELECT doc_id, CASE WHEN d IN ('bullish', 'bearish', 'neutral') THEN d ELSE 'neutral' END AS direction, CASE WHEN s IN ('low', 'medium', 'high') THEN s ELSE 'low' END AS strength,
  CASE WHEN r IN ('outperform', 'underperform', 'inline') THEN r ELSE 'inline' END AS relative, coalesce(e, 'other') AS event_type, coalesce(n, 'mixed') AS session FROM v""")
def parse_completions(spark, d):
    return news.parse_completions(answers(spark, d)).drop("completion")


@query("parse_sentiments", "", """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"label": "' || CASE doc_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'odd' END || '", "confidence": ' || (doc_id % 7) / 5.0::DOUBLE || '}'
  ELSE CASE doc_id % 3 WHEN 0 THEN 'Bullish. ' WHEN 1 THEN 'bearish, ' ELSE '' END || text END AS answer FROM documents),
p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN answer::JSON->>'label' ELSE lower(trim(regexp_extract(trim(answer), '^(\\S+)', 1), '.,:;"''')) END AS label, CASE WHEN doc_id % 2 = 0 THEN least(1.0, (answer::JSON->>'confidence')::DOUBLE) ELSE 1.0 END AS c
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN answer ELSE answer END AS answer FROM a))
SELECT doc_id, CASE WHEN label IN ('bullish', 'bearish') THEN label ELSE 'neutral' END AS label, round(CASE label WHEN 'bullish' THEN c WHEN 'bearish' THEN -c ELSE 0 END, 6)::DOUBLE AS score FROM p""")
def parse_sentiments(spark, d):
    """Half of the answers are JSON, half prose that may start with a label."""
    i = F.col("doc_id")
    as_json = F.concat(
        F.lit('{"label": "'), F.when(i % 3 == 0, "bullish").when(i % 3 == 1, "bearish").otherwise("odd"),
        F.lit('", "confidence": '), ((i % 7) / 5.0).cast("string"), F.lit("}"),
    )
    prose = F.concat(F.when(i % 3 == 0, "Bullish. ").when(i % 3 == 1, "bearish, ").otherwise(""), F.col("text"))
    rows = fx.table(spark, d, "documents").select("doc_id", F.when(i % 2 == 0, as_json).otherwise(prose).alias("answer"))
    return news.parse_sentiment(rows).drop("answer")


@query("calibrate", "scores", """
WITH s AS (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM scores WHERE abs(score) > 1e-9),
v AS (SELECT symbol, max(score) FILTER (i = floor(0.65::DOUBLE * (n - 1))) AS e, max(score) FILTER (i = floor(0.35::DOUBLE * (n - 1))) AS x FROM s GROUP BY symbol)
SELECT symbol, round(coalesce(greatest(0.03, e), 0.05), 6) AS entry_threshold, round(CASE WHEN x IS NULL THEN 0.02 ELSE least(greatest(0.03, e) - 1e-6, greatest(0, x)) END, 6) AS exit_threshold
FROM (SELECT DISTINCT symbol FROM scores) LEFT JOIN v USING (symbol)""")
def calibrate(spark, d):
    out = news.calibrate(fx.scores(spark, d), ["symbol"])
    return out.select("symbol", *r6("entry_threshold", "exit_threshold"))


@query("coverage", "bars_h scores ecal", """
WITH d AS (SELECT DISTINCT symbol, ts::DATE AS day FROM bars_h),
p AS (SELECT day, CASE WHEN ci < floor(0.6::DOUBLE * n) THEN 'train' WHEN ci < floor(0.8::DOUBLE * n) THEN 'validation' ELSE 'test' END AS period FROM ecal, (SELECT count(*) AS n FROM ecal))
SELECT period, round(avg(CASE WHEN coalesce(score, 0) <> 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS coverage FROM d JOIN p USING (day) LEFT JOIN scores USING (symbol, day) GROUP BY period""")
def coverage(spark, d):
    """Share of (user, weekday) rows with a non-zero score per split."""
    from barline.operators.labels import period_of

    days = fx.bars_h(spark, d).select("symbol", F.to_date("ts").alias("day")).distinct()
    rows = days.join(period_of(event_calendar(spark, d)).select("day", "period"), "day").join(fx.scores(spark, d), ["symbol", "day"], "left")
    real = (F.coalesce("score", F.lit(0.0)) != 0).cast("double")
    return rows.groupBy("period").agg(F.round(F.avg(real), 4).alias("coverage"))


@query("staleness", "", """
WITH s AS (SELECT 'U' || user_id AS symbol, max(ts) FILTER (event_type = 'purchase') AS last_ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT symbol, last_ts, (floor(epoch(now)) - floor(epoch(last_ts)))::BIGINT AS age_s, last_ts IS NULL OR floor(epoch(now)) - floor(epoch(last_ts)) > 1800 AS stale FROM s, n""")
def staleness(spark, d):
    events = fx.table(spark, d, "events").withColumn("symbol", F.concat(F.lit("U"), F.col("user_id")))
    users = events.select("symbol").distinct().withColumn("now", events.agg(F.max("ts")).scalar())
    seen = events.where("event_type = 'purchase'")
    return news.staleness(users, seen, F.col("now"))


@query("news_coverage", "eff scores", """
WITH b AS (SELECT symbol, trading_day, count(*) AS articles FROM eff WHERE trading_day IS NOT NULL GROUP BY 1, 2),
n AS (SELECT symbol, sum(articles)::BIGINT AS articles, count(*) AS news_days FROM b GROUP BY 1),
t AS (SELECT symbol, count(*) FILTER (label = 'bullish') AS bullish_days, count(*) FILTER (label = 'bearish') AS bearish_days, count(*) FILTER (label = 'neutral') AS neutral_days FROM scores GROUP BY 1)
SELECT symbol, articles, news_days, bullish_days, bearish_days, neutral_days FROM n FULL JOIN t USING (symbol)""")
def news_coverage(spark, d):
    stamps = fx.table(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("ts").alias("created_at"))
    days = news.effective_day(stamps, event_calendar(spark, d)).groupBy("symbol", "trading_day").agg(F.count("*").alias("articles"))
    return news.news_coverage(days, fx.scores(spark, d))


_PAIRS = [*news.NEWS_PROXIES, "XAUUSD"]


@query("news_proxies", "", "WITH p AS (SELECT c_custkey, ['" + "','".join(_PAIRS) + """'][c_custkey % 8 + 1] AS symbol FROM customer)
SELECT c_custkey, symbol, unnest(CASE symbol """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in news.NEWS_PROXIES.items()) + " ELSE [symbol] END) AS news_symbol FROM p")
def news_proxies(spark, d):
    """Customers hold one of seven known pairs or an unmapped one."""
    pair = F.get(F.array(*[F.lit(p) for p in _PAIRS]), (F.col("c_custkey") % 8).cast("int"))
    return news.news_symbols(fx.table(spark, d, "customer").select("c_custkey", pair.alias("symbol")))
