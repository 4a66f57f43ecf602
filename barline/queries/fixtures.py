"""Market-style tables derived from the driver's parquet tables, in Spark and in SQL side by side.

Symbols are suppliers, users, nations or regions, so every derived table grows with the data it is read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline.operators.bars import numbered_bars
from barline.plans.blocks import number_rows
from barline.queries.registry import view

DAY = 86400
WEEK = 7 * DAY

# Keyword put into the headline of an article, by number 0..7 (8 adds none).
HEADLINE_WORDS = ["earnings", "guidance", "upgrade", "merger", "antitrust", "lawsuit", "launch", "inflation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its zone-less timestamps read as UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def _px() -> Column:
    return F.lit(100.0) * (F.lit(1.0) + F.col("l_discount")) + F.col("l_extendedprice") / F.lit(9973.0)


def _line_order() -> Column:
    return F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "px")


def _ohlc(df: DataFrame, order: Column, volume: Column) -> DataFrame:
    return df.groupBy("symbol", "ts").agg(
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        volume.alias("volume"),
    )


_SQL_PX = "100.0::DOUBLE * (1.0::DOUBLE + l_discount) + l_extendedprice / 9973.0::DOUBLE"
_SQL_ORD = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, px)"
_SQL_OHLC = "arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close"

view("lines", "", f"SELECT *, {_SQL_PX} AS px FROM lineitem")
view(
    "bars",
    "lines",
    f"""
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (
  SELECT 'S' || l_suppkey AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, {_SQL_OHLC}, sum(l_quantity) AS volume
  FROM (SELECT *, {_SQL_ORD} AS o FROM lines) GROUP BY 1, 2)""",
)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier: symbol, ts, open, high, low, close, volume, pos."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "px"]
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.date_trunc("week", "l_shipdate").alias("ts"), *order[:-1], _px().alias("px"), F.col("l_quantity").cast("double").alias("volume")
    )
    out = numbered_bars(lines, order)
    return out.select(F.concat(F.lit("S"), F.col("key")).alias("symbol"), *[c for c in out.columns if c != "key"])


view(
    "idx",
    "lines",
    f"""
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (
  SELECT r_name AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, {_SQL_OHLC}, sum(l_quantity) AS volume
  FROM (SELECT *, {_SQL_ORD} AS o FROM lines) JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY 1, 2)""",
)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to nation and region names; nation and region are fixed-size dimension tables."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weekday bars per region."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .where(F.dayofweek("l_shipdate").between(2, 6))
        .join(suppliers(spark, sf_dir).select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("r_name").alias("symbol"), F.date_trunc("day", "l_shipdate").alias("ts"), "*", _px().alias("px"))
    )
    out = _ohlc(lines, _line_order(), F.sum("l_quantity"))
    return number_rows(out, ["symbol"], ["ts"])


view(
    "cal",
    "",
    """SELECT day, row_number() OVER (ORDER BY day) - 1 AS ci FROM (
  SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5)""",
)


def cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading calendar: weekday order dates with their index ``ci``."""
    days = (
        table(spark, sf_dir, "orders")
        .where(F.dayofweek("o_orderdate").between(2, 6))
        .select(F.to_date("o_orderdate").alias("day"))
        .distinct()
    )
    return number_rows(days, [], ["day"], pos="ci")


view(
    "ticks",
    "",
    """SELECT 'U' || user_id AS symbol, CASE WHEN event_type = 'error' THEN 'quote' ELSE 'bar' END AS event_type,
  value AS price, (props::JSON->>'k')::DOUBLE AS volume, ts AS event_ts, ts + INTERVAL 1 SECOND AS received_ts, event_id FROM events""",
)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per user; events of type error stand for quotes, all others for bars."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        F.when(F.col("event_type") == "error", "quote").otherwise("bar").alias("event_type"),
        F.col("value").alias("price"),
        _k().cast("double").alias("volume"),
        F.col("ts").alias("event_ts"),
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("received_ts"),
        "event_id",
    )


view(
    "bars_h",
    "",
    """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (
  SELECT 'U' || user_id AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open,
    max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume,
    arg_min((props::JSON->>'k')::BIGINT, (ts, event_id)) AS k
  FROM events GROUP BY 1, 2)""",
)


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per user; ``k`` is the number carried by the first event of the hour."""
    order = F.struct("ets", "event_id")
    out = (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
            F.date_trunc("hour", "ts").alias("ts"),
            F.col("ts").alias("ets"),
            "event_id",
            "value",
            _k().alias("k"),
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("*").cast("double").alias("volume"),
            F.min_by("k", order).alias("k"),
        )
    )
    return number_rows(out, ["symbol"], ["ts"])


_WORDS_SQL = " ".join(f"WHEN {i} THEN ' {w}'" for i, w in enumerate(HEADLINE_WORDS))
view(
    "articles",
    "",
    f"""
SELECT event_id AS article_id, ts AS created_at, 'U' || user_id AS symbol,
  split_part(text, chr(10), 1) || CASE (props::JSON->>'k')::BIGINT % 9 {_WORDS_SQL} ELSE '' END AS headline,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary,
  source
FROM events JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS di, count(*) OVER () AS nd FROM documents)
  ON di = event_id % nd""",
)


def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that articles refer to: a whole document each, its first line as headline, the rest as summary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    numbered = number_rows(docs.select("doc_id"), [], ["doc_id"], pos="text_id").join(docs, "doc_id")
    cut = F.instr("text", "\n")
    return numbered.select(
        "text_id",
        F.substring_index("text", "\n", 1).alias("headline"),
        F.when(cut > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise("").alias("summary"),
        "source",
    )


def article_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per event without its text: the number of the text, and the word that the article adds to the headline."""
    word = F.get(F.array(*[F.lit(" " + w) for w in HEADLINE_WORDS]), (_k() % 9).cast("int"))
    texts = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        (F.col("event_id") % texts).alias("text_id"),
        F.coalesce(word, F.lit("")).alias("added"),
    )


view(
    "scores",
    "",
    """
SELECT symbol, day, score, CASE WHEN score > 0.05 THEN 'bullish' WHEN score < -0.05 THEN 'bearish' ELSE 'neutral' END AS label FROM (
  SELECT 'U' || user_id AS symbol, ts::DATE AS day,
    (sum((props::JSON->>'k')::BIGINT) / count(*)::DOUBLE - 49.5::DOUBLE) / 50.0::DOUBLE AS score
  FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2)""",
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment per (user, day) from clicks and purchases; days without either have no score."""
    out = (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("click", "purchase"))
        .groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.to_date("ts").alias("day"))
        .agg(F.sum(_k()).alias("ks"), F.count("*").alias("n"))
        .select("symbol", "day", ((F.col("ks") / F.col("n").cast("double") - 49.5) / 50.0).alias("score"))
    )
    label = F.when(F.col("score") > 0.05, "bullish").when(F.col("score") < -0.05, "bearish").otherwise("neutral")
    return out.withColumn("label", label)


view(
    "preds",
    "bars_h",
    """
SELECT symbol, ts, CASE k % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction,
  CASE (k // 3) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS strength,
  CASE (k // 9) % 3 WHEN 0 THEN 'outperform' WHEN 1 THEN 'underperform' ELSE 'inline' END AS relative
FROM bars_h""",
)


def preds_of(hourly: DataFrame) -> DataFrame:
    """A made-up directional prediction per hourly bar, from the number carried by its first event."""

    def pick(base: int, names: list[str]) -> Column:
        slot = F.floor(F.col("k") / base) % 3
        return F.when(slot == 0, names[0]).when(slot == 1, names[1]).otherwise(names[2])

    return hourly.select(
        "symbol",
        "ts",
        pick(1, ["bullish", "bearish", "neutral"]).alias("direction"),
        pick(3, ["low", "medium", "high"]).alias("strength"),
        pick(9, ["outperform", "underperform", "inline"]).alias("relative"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preds_of(bars_h(spark, sf_dir))


view(
    "runs",
    "",
    """
SELECT o_orderkey AS run_id, c_mktsegment AS market, n_name AS symbol, o_orderpriority AS strategy,
  'y' || year(o_orderdate) AS window_name, o_orderdate AS created_at,
  o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE AS total_return, -((o_orderkey * 7 % 97) / 100.0::DOUBLE) AS max_drawdown,
  (o_custkey * 13 % 89) / 40.0::DOUBLE - 1.0::DOUBLE AS sharpe, (o_orderkey % 23)::INTEGER AS trades, (o_orderkey * 3 % 101) / 100.0::DOUBLE AS win_rate,
  (o_orderkey * 11 % 83) / 20.0::DOUBLE AS profit_factor, CASE WHEN o_orderkey % 29 > 0 THEN (o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE) * 1.5::DOUBLE END AS annualized_return,
  o_orderstatus AS cost_profile, o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE + (o_orderkey * 3 % 101) / 1000.0::DOUBLE AS score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy run summaries: one per order, with metrics from fixed arithmetic on its keys."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    o = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    gain = F.col("o_totalprice") / 250000.0 - 1.0
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("c_mktsegment").alias("market"),
        F.col("n_name").alias("symbol"),
        F.col("o_orderpriority").alias("strategy"),
        F.concat(F.lit("y"), F.year("o_orderdate")).alias("window_name"),
        F.col("o_orderdate").alias("created_at"),
        gain.alias("total_return"),
        (-((F.col("o_orderkey") * 7 % 97) / 100.0)).alias("max_drawdown"),
        ((F.col("o_custkey") * 13 % 89) / 40.0 - 1.0).alias("sharpe"),
        (F.col("o_orderkey") % 23).cast("int").alias("trades"),
        ((F.col("o_orderkey") * 3 % 101) / 100.0).alias("win_rate"),
        ((F.col("o_orderkey") * 11 % 83) / 20.0).alias("profit_factor"),
        F.when(F.col("o_orderkey") % 29 > 0, gain * 1.5).alias("annualized_return"),
        F.col("o_orderstatus").alias("cost_profile"),
        (gain + (F.col("o_orderkey") * 3 % 101) / 1000.0).alias("score"),
    )
