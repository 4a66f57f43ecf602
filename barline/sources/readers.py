"""Readers: bars, index files, rates, articles, pages, JSON lines, score caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline import schemas
from barline.functions.scalar import finite


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Latest row per key. An aggregate, so each task sends at most one row per key to the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_bars(raw: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Finite prices, no rows without open or close, the last of duplicate (symbol, ts) rows."""
    numeric = [c for c in ("open", "high", "low", "close", "volume") if c in raw.columns]
    rows = raw.withColumns({c: finite(F.col(c)) for c in numeric})
    return latest_per(rows.where("open IS NOT NULL AND close IS NOT NULL"), ["symbol", "ts"], order)


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] = (), start: str | None = None) -> DataFrame:
    """OHLCV parquet with filters on raw columns, so that they reach the scan."""
    raw = schemas.validate_schema(spark.read.parquet(path), schemas.BARS)
    if symbols:
        raw = raw.where(F.col("symbol").isin(*symbols))
    if start is not None:
        raw = raw.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    order = ["ingest_ts"] if "ingest_ts" in raw.columns else [c for c in raw.columns if c not in ("symbol", "ts")]
    return clean_bars(raw, order)


# Date formats met in index files.
INDEX_DATES = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd-MMM-yyyy"]


def parse_index(rows: DataFrame, name: str, order: Column | None = None) -> DataFrame:
    """First column is the date, CLOSE or else the last column the value; last of duplicate dates wins.

    Lines of one file keep their order; pass ``order`` when the rows come from several files.
    """
    date, value = rows.columns[0], next((c for c in rows.columns if c.strip().upper() == "CLOSE"), rows.columns[-1])
    day = F.coalesce(*[F.try_to_timestamp(F.trim(F.col(f"`{date}`")), F.lit(f)) for f in INDEX_DATES])
    number = F.col(f"`{value}`").try_cast("double")
    parsed = rows.select(day.alias("ts"), number.alias("value"), (F.monotonically_increasing_id() if order is None else order).alias("_line"))
    parsed = parsed.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return latest_per(parsed, ["ts"], ["_line"]).select(F.lit(name).alias("name"), "ts", "value")


def read_index_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    return parse_index(spark.read.option("header", True).csv(path), name)


def rates_to_bars(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON ``{"rates": {"2024-01-02": {"USD": 1.1}}}`` to close-only bars with open = high = low = close."""
    parsed = F.from_json(column, "rates map<string, map<string, double>>")["rates"]
    days = payloads.select(F.explode(parsed).alias("day", "quotes"))
    quotes = days.select("day", F.explode("quotes").alias("symbol", "close"))
    price = F.col("close")
    return quotes.select(
        "symbol", F.col("day").cast("timestamp").alias("ts"), price.alias("open"), price.alias("high"),
        price.alias("low"), price.alias("close"), F.lit(None).cast("double").alias("volume"),
    )


def dedup_articles(pages: DataFrame) -> DataFrame:
    """One row per article id; among copies the one with the largest (created_at, rest) survives."""
    return latest_per(pages, ["article_id"], [c for c in pages.columns if c != "article_id"])


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return dedup_articles(spark.read.schema(schemas.ARTICLES).json(path))


def dates_from_pages(pages: DataFrame, pattern: str, expected: int = 8, html: str = "html") -> DataFrame:
    """Distinct dates named in pages, with the number found per year and whether that is unexpected."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("_d"))
    days = found.select(F.try_to_timestamp("_d", F.lit("yyyyMMdd")).cast("date").alias("day")).where("day IS NOT NULL").distinct()
    per_year = days.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("per_year"))
    return days.withColumn("year", F.year("day")).join(per_year, "year").select(
        "day", "year", "per_year", (F.col("per_year") != expected).alias("unexpected")
    )


def split_json_lines(lines: DataFrame, ddl: str, column: str = "value") -> DataFrame:
    """Objects of JSON lines that may hold several objects per line or broken text (kept in ``_corrupt``)."""
    # A boundary is "}{" followed by a key. Inside a string the quote of such a key would be escaped.
    boundary = r"\}\s*(?=\{\s*\"(?:[^\"\\]|\\.)*\"\s*:)"
    parts = F.split(F.regexp_replace(F.trim(F.col(column)), boundary, "}\u0001"), "\u0001")
    objects = lines.where(F.trim(F.col(column)) != "").select(F.explode(parts).alias("_o"))
    parsed = F.from_json("_o", ddl + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return objects.select(parsed.alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return split_json_lines(spark.read.text(path), ddl)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score cache; the last line written for a (symbol, day, prompt hash) wins."""
    rows = spark.read.schema(schemas.SCORES).json(path).withColumn("_line", F.monotonically_increasing_id())
    return latest_per(rows, ["symbol", "trading_day", "prompt_hash"], ["_line"]).drop("_line")


def read_ticks_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Tick files as a stream; use ``trigger(availableNow=True)`` to stop when all are read."""
    return spark.readStream.schema(schemas.TICKS).option("maxFilesPerTrigger", files_per_trigger).json(path)
