"""Dated text: effective days, bundles, event types, prompts, completions, sentiment series."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from barline.functions.scalar import clip
from barline.operators.calendar import local_time, next_trading_day_map, on_calendar, session_label
from barline.plans.blocks import in_blocks
from barline.session import written

# Ordered keyword groups; the first group with a keyword contained in the text gives the type.
EVENT_KEYWORDS = [
    ("earnings", ("earnings", "revenue", "eps", "profit", "sales")),
    ("guidance", ("guidance", "forecast", "outlook", "raises outlook", "cuts outlook")),
    ("analyst", ("analyst", "price target", "upgrade", "downgrade", "rating")),
    ("mna", ("acquire", "acquisition", "merger", "buyout", "stake")),
    ("regulatory", ("regulator", "regulatory", "antitrust", "probe", "investigation", "approval")),
    ("litigation", ("lawsuit", "court", "settlement", "sues", "legal")),
    ("product", ("launch", "product", "chip", "platform", "service", "ai")),
    ("macro", ("inflation", "fed", "rates", "tariff", "economy", "opec", "oil")),
]


def effective_day(articles: DataFrame, cal: DataFrame, close_hour: int = 16, zone: str | None = None) -> DataFrame:
    """Trading day an article counts for: its own if before the close, else the next; the first for all earlier ones, dropped past the last.

    After shifting late articles by one day this is an equi-join on a dense date map, not a range join.
    """
    local = local_time("created_at", zone) if zone else local_time("created_at")
    shifted = F.when(F.hour(local) >= close_hour, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    days = next_trading_day_map(cal)
    return articles.withColumn("date", on_calendar(shifted, cal)).join(days, "date").drop("date")


OTHER = len(EVENT_KEYWORDS)


def event_rank(text: Column) -> Column:
    """Number of the first group with a keyword in the text; :data:`OTHER` without one."""
    lowered = F.lower(text)
    found = [F.when(reduce(or_, [F.contains(lowered, F.lit(w)) for w in words]), F.lit(i)) for i, (_, words) in enumerate(EVENT_KEYWORDS)]
    return F.coalesce(*found, F.lit(OTHER))


def event_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name, _ in EVENT_KEYWORDS], F.lit("other")), rank)


def event_type(text: Column) -> Column:
    return event_name(event_rank(text))


def majority_session(pre: Column, intra: Column, post: Column) -> Column:
    top = F.greatest(pre, intra, post)
    leaders = sum(((c == top) & (c > 0)).cast("int") for c in (pre, intra, post))
    name = F.when(pre == top, "pre_market").when(intra == top, "intraday").otherwise("post_close")
    return F.when(leaders == 1, name).otherwise("mixed")


# Fixed value: every character that counts as white space in Unicode.
SPACES = r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _spaced(x: Column) -> Column:
    return F.regexp_replace(x, SPACES, " ")


def _squeeze(x: Column) -> Column:
    return F.trim(_spaced(x))


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int, salts: int = 16) -> DataFrame:
    """First ``k`` rows per key in two steps: first ``k`` per (key, salt), then among those, so that a key
    holding a third of all rows is cut down in parallel before it meets in one place."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    near = near.where(F.col("_r") <= k).drop("_r", "_salt")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k)


def bundle_heads(articles: DataFrame, keys: list[str], day: str = "trading_day", k: int = 5) -> DataFrame:
    """First ``k`` articles per key without their texts: ids, ``items`` (text_id, added) in order, headline and session counts."""
    picked = first_k(articles.select(*keys, "created_at", "article_id", "text_id", "added"), keys, ["created_at", "article_id"], k)
    item = F.struct(F.col("_r").alias("r"), F.col("article_id").alias("id"), "text_id", "added")
    session = session_label(F.col("created_at"), F.to_date(F.col(day)))
    counts = {"n_pre": "pre_market", "n_intra": "intraday", "n_post": "post_close"}
    grouped = picked.select(*keys, item.alias("item"), session.alias("s")).groupBy(*keys).agg(
        F.sort_array(F.collect_list("item")).alias("items"),  # at most k items
        F.count("*").cast("int").alias("headline_count"),
        *[F.sum((F.col("s") == v).cast("int")).alias(c) for c, v in counts.items()],
    )
    return grouped.select(
        *keys,
        F.transform("items", lambda i: i["id"]).alias("article_ids"),
        F.transform("items", lambda i: F.struct(i["text_id"].alias("text_id"), i["added"].alias("added"))).alias("items"),
        "headline_count", *counts,
        majority_session(*[F.col(c) for c in counts]).alias("session"),
    )


#: Least articles of a chunk, lines of one text above which a chunk has no more than ``LINES`` articles, and bytes of texts that a chunk keeps in memory.
LEAST_ROWS, LINES, CHUNK_BYTES = 1 << 13, 1 << 17, 1 << 28


def _chunks(heads: DataFrame, ranks: DataFrame, lines: int) -> int:
    """How many chunks: one for each core, as each has its own copy of the texts, and fewer where there are few articles. More articles make larger chunks, not more.

    A text that more than ``lines`` different words are added to would have as long a list of ranks; then a chunk has ``lines`` articles.
    """
    picks = heads.agg(F.coalesce(F.sum("headline_count"), F.lit(0))).first()[0]
    most = ranks.groupBy("text_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    least = -(-picks // lines) if most > lines else 1
    return max(1, least, min(heads.sparkSession.sparkContext.defaultParallelism, picks // LEAST_ROWS))


class _Texts:
    """Texts of a chunk and the event ranks of their lines, packed: in memory up to ``size`` bytes, in a file of the task beyond."""

    def __init__(self, size: int):
        self.packed, self.places, self.end = tempfile.SpooledTemporaryFile(size), {}, 0

    def add(self, i, *text) -> None:
        self.packed.seek(self.end)
        self.places[i] = self.end
        pickle.dump(text, self.packed, pickle.HIGHEST_PROTOCOL)
        self.end = self.packed.tell()

    def get(self, i) -> tuple:
        self.packed.seek(self.places[i])
        return pickle.load(self.packed)


def _join_lines(out: list[str], size: int):
    """Rows of a chunk, texts first: keeps the texts, and adds to each bundle its text and the first event rank among its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                new = batch.filter(batch.column("ranks").is_valid())
                head, tail = (new.column(c).cast(pa.binary()).to_pylist() for c in ("headline", "summary"))
                for i, h, t, ranks in zip(new.column("text_id").to_pylist(), head, tail, new.column("ranks").to_pylist()):
                    texts.add(i, h, t, {r["added"].encode(): r["rank"] for r in ranks})
                bundles = batch.filter(batch.column("items").is_valid())
                if not bundles.num_rows:
                    continue
                items = bundles.column("items")
                each = items.flatten()
                ids, words = each.field("text_id").to_pylist(), each.field("added").cast(pa.binary()).to_pylist()
                lines, first, start = [], [], 0
                for n in pc.list_value_length(items).to_pylist():
                    whole_lines, rank = [], OTHER
                    for r in range(n):
                        i, added = ids[start + r], words[start + r]
                        if i in texts.places:
                            head, tail, ranks = texts.get(i)
                            rank = min(rank, ranks[added])
                            if head is not None:
                                whole_lines.append(b"%d. %b" % (r + 1, _title(head, added)) + (b" Summary: " + tail if tail else b""))
                    lines.append(b"\n".join(whole_lines) if whole_lines else None)
                    first.append(rank)
                    start += n
                columns = [*[bundles.column(c) for c in out], pa.array(lines, pa.binary()).cast(pa.string()), pa.array(first, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*out, "text", "event_rank"])

    return run


def _title(head: bytes, added: bytes) -> bytes:
    return ((head[:-1] if head[-1:] == b" " == added[:1] else head) + added).strip(b" ")


def bundle_news(articles: DataFrame, texts: DataFrame, keys: list[str], day: str = "trading_day", k: int = 5, rows: int = LINES, size: int = CHUNK_BYTES) -> DataFrame:
    """First ``k`` articles per key as one numbered text with ids, session counts and event type (whole texts).

    Articles name their text by ``text_id`` and may have words ``added`` to its headline; ``texts`` has text_id, headline, summary. Many articles may share a
    text, so texts do not travel with articles: bundles are dealt into a chunk for each core, each distinct text goes to each chunk that needs it once, and the
    lines are put together there, where they are not shuffled again. Keywords are looked up once for each distinct line.
    """
    heads = written(bundle_heads(articles, keys, day, k), "heads")
    spaced = written(texts.select("text_id", _spaced(F.col("headline")).alias("headline"), _squeeze(F.col("summary")).alias("summary")), "texts")
    heads = heads.withColumn("items", F.transform("items", lambda i: F.struct(i["text_id"].alias("text_id"), F.coalesce(i["added"], F.lit("")).alias("added"))))
    line = F.concat(_squeeze(F.concat("headline", "added")), F.when(F.col("summary") != "", F.concat(F.lit(" Summary: "), "summary")).otherwise(""))
    named = heads.select(F.explode("items").alias("i")).select("i.text_id", "i.added").distinct()
    ranks = written(named.join(spaced, "text_id").select("text_id", "added", event_rank(line).alias("rank")), "ranks")
    n = _chunks(heads, ranks, rows)
    dealt = heads.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    wanted = dealt.select("chunk", F.explode("items").alias("i")).select("chunk", "i.text_id", "i.added").distinct()
    ranked = wanted.join(ranks, ["text_id", "added"]).groupBy("chunk", "text_id").agg(F.collect_list(F.struct("added", "rank")).alias("ranks"))
    needed = ranked.join(spaced, "text_id").withColumn("side", F.lit(0))
    both = dealt.withColumn("side", F.lit(1)).unionByName(needed, allowMissingColumns=True).repartitionById(n, "chunk").sortWithinPartitions("side")
    out = [c for c in heads.columns if c != "items"]
    schema = StructType([*heads.select(*out).schema.fields, StructField("text", StringType()), StructField("event_rank", IntegerType())])
    done = both.select(*out, "items", "text_id", "headline", "summary", "ranks").mapInArrow(_join_lines(out, size), schema)
    return done.withColumn("event_type", event_name(F.col("event_rank"))).drop("event_rank")


# Answer vocabulary of the two prompts.
LABEL_SPEC = "label, strength, event_type, session, horizon"
DIRECTION_SPEC = "direction, strength, relative_to_spy, event_type, session, horizon"
SESSIONS = "pre_market, intraday, post_close, or mixed"


def prompt(kind: str, horizon: str = "5d") -> Column:
    """Prompt text over bundle columns; ``kind`` is ``label`` or ``direction``."""
    types = ", ".join([n for n, _ in EVENT_KEYWORDS] + ["other"])
    if kind == "label":
        intro = (
            "You are a financial news analyst. Read the stock-specific news bundle and return compact JSON "
            f"with keys {LABEL_SPEC}. label must be bullish, bearish, or neutral. "
        )
        extra = ""
    else:
        intro = (
            "You are a financial news directional forecaster. Read the stock-specific news bundle and return compact JSON "
            f"with keys {DIRECTION_SPEC}. direction must be bullish, bearish, or neutral. "
        )
        extra = "relative_to_spy must be outperform, underperform, or inline. "
    rules = (
        f"strength must be low, medium, or high. {extra}event_type must be one of {types}. "
        f"session must be {SESSIONS}. horizon must be {horizon}.\n\n"
    )
    return F.concat(
        F.lit(intro + rules + "Symbol: "), F.col("symbol"),
        F.lit("\nTrading day: "), F.col("trading_day").cast("string"),
        F.lit("\nSession context: "), F.col("session"),
        F.lit("\nHeadline count: "), F.col("headline_count").cast("string"),
        F.lit("\nHeadlines:\n"), F.col("text"), F.lit("\n\nJSON:"),
    )


def completion(fields: dict[str, Column]) -> Column:
    """Compact JSON with the fields in the given order."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def prompt_hash(text: Column, model: str, version: str) -> Column:
    return F.sha2(F.concat(text, F.lit(model), F.lit(version)), 256)


# Allowed answers; the last of each tuple pair is the default.
DIRECTIONS = (("bullish", "bearish", "neutral"), "neutral")
STRENGTHS = (("low", "medium", "high"), "low")
RELATIVES = (("outperform", "underperform", "inline"), "inline")


def _first_object(text: Column, ddl: str) -> Column:
    """The JSON between the outermost braces as a struct; null unless it is exactly one valid object."""
    raw = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    items = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"array<struct<{ddl}>>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def _one_of(value: Column, spec) -> Column:
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*spec[0]), clean).otherwise(spec[1])


def parse_completions(df: DataFrame, text: str = "completion") -> DataFrame:
    """Direction, strength, relative label, event type and session from the outermost braces of the text; defaults when broken.

    Event type and session may be any word, in lower case without outer spaces; where they are missing or null they are ``other`` and ``mixed``.
    """
    parsed = _first_object(F.col(text), "direction:string,strength:string,relative_to_spy:string,event_type:string,session:string")
    free = lambda name, default: F.coalesce(F.lower(F.trim(parsed[name])), F.lit(default)).alias(name)
    return df.select(
        *df.columns,
        _one_of(parsed["direction"], DIRECTIONS).alias("direction"),
        _one_of(parsed["strength"], STRENGTHS).alias("strength"),
        _one_of(parsed["relative_to_spy"], RELATIVES).alias("relative"),
        free("event_type", "other"),
        free("session", "mixed"),
    )


def parse_sentiment(df: DataFrame, text: str = "answer") -> DataFrame:
    """Label and signed score from a JSON answer with label and confidence, else from its first word."""
    body = F.trim(F.col(text))
    items = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<struct<label:string,confidence:double>>")
    parsed = F.when(body.startswith("{") & (F.size(items) == 1), F.get(items, F.lit(0)))
    word = F.lower(F.regexp_replace(F.regexp_extract(body, r"^(\S+)", 1), r"^[.,:;\"']+|[.,:;\"']+$", ""))
    label = _one_of(F.when(parsed.isNotNull(), F.coalesce(parsed["label"], F.lit("neutral"))).otherwise(word), DIRECTIONS)
    sure = F.when(parsed.isNotNull(), F.coalesce(parsed["confidence"], F.lit(0.0))).otherwise(1.0)
    bounded = clip(sure, F.lit(0.0), F.lit(1.0))
    score = F.when(label == "bullish", bounded).when(label == "bearish", -bounded).otherwise(0.0)
    return df.select(*df.columns, label.alias("label"), F.round(score, 6).alias("score"))


def calibrate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Entry and exit thresholds from the 65th and 35th order statistic of the non-zero scores."""
    from barline.plans.ranks import quantiles

    real = scores.where(F.abs("score") > 1e-9)
    found = quantiles(real, keys, "score", {"_e": 0.65, "_x": 0.35}, order_stat=True)
    entry = F.greatest(F.lit(0.03), F.col("_e"))
    out = scores.select(*keys).distinct().join(found, keys, "left")
    return out.select(
        *keys,
        F.coalesce(entry, F.lit(0.05)).alias("entry_threshold"),
        F.when(F.col("_x").isNull(), 0.02).otherwise(F.least(entry - 1e-6, F.greatest(F.lit(0.0), F.col("_x")))).alias("exit_threshold"),
    )


def staleness(sources: DataFrame, seen: DataFrame, now: Column, limit_s: int = 1800, key: str = "symbol") -> DataFrame:
    """Age of the newest score per source; stale when older than the limit or never seen."""
    newest = seen.groupBy(key).agg(F.max("ts").alias("last_ts"))
    age = F.unix_seconds(now) - F.unix_seconds("last_ts")
    return sources.join(newest, key, "left").select(
        key, "last_ts", age.alias("age_s"), (F.col("last_ts").isNull() | (age > limit_s)).alias("stale")
    )


def news_coverage(bundles: DataFrame, scores: DataFrame) -> DataFrame:
    """Articles, news days and days per label for each symbol."""
    news = bundles.groupBy("symbol").agg(F.sum("articles").alias("articles"), F.count("*").alias("news_days"))
    tone = scores.groupBy("symbol").agg(
        *[F.count_if(F.col("label") == x).alias(f"{x}_days") for x in ("bullish", "bearish", "neutral")]
    )
    return news.join(tone, "symbol", "full_outer")


# Currency pairs and the symbols whose news stand in for them.
NEWS_PROXIES = {
    "EURUSD": ["FXE", "UUP"], "USDJPY": ["FXY", "UUP"], "GBPUSD": ["FXB", "UUP"], "AUDUSD": ["FXA", "UUP"],
    "USDCAD": ["FXC", "UUP"], "USDCHF": ["FXF", "UUP"], "EURJPY": ["FXE", "FXY"],
}


def news_symbols(df: DataFrame, proxies: dict[str, list[str]] = NEWS_PROXIES, column: str = "symbol") -> DataFrame:
    """One row per symbol to read news for: the proxies of a pair, or the symbol itself."""
    table = F.create_map(*[x for k, v in proxies.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    names = F.coalesce(F.try_element_at(table, F.col(column)), F.array(F.col(column)))
    return df.withColumn("news_symbol", F.explode(names))


def lagged_sentiment(days: DataFrame, k: int, weak: float, share: float) -> DataFrame:
    """Mean score of the previous ``k`` days (today excluded) and a flag for weak or neutral stretches."""

    def smooth(rows: DataFrame, w) -> DataFrame:
        past = w.rowsBetween(-k, -1)
        dull = ((F.col("label") == "neutral") | (F.abs("score") <= weak)).cast("double")
        return rows.withColumn("lagged", F.coalesce(F.avg("score").over(past), F.lit(0.0))).withColumn(
            "weak_cluster", F.coalesce(F.avg(dull).over(past) >= share, F.lit(False))
        )

    return in_blocks(days, smooth, back=k)


def carry_sentiment(days: DataFrame, decay: float = 0.6, edge: float = 0.25) -> DataFrame:
    """Fill unscored days with the decayed sum of the last three non-zero values, which feed later fills.

    The fill is recursive, so it is a native fold along the days of a symbol. A symbol has one row per calendar
    day here, so the folded array is no longer than the calendar.
    """
    item = F.struct("pos", "day", "scored", "score", "label")
    rows = days.groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    start = F.struct(
        F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"),
        F.array().cast("array<struct<day:date,scored:boolean,score:double,label:string>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        carried = acc["a"] + F.lit(decay) * acc["b"] + F.lit(decay * decay) * acc["c"]
        score = F.when(x["scored"], x["score"]).otherwise(F.round(clip(carried, F.lit(-1.0), F.lit(1.0)), 6))
        label = (
            F.when(x["scored"], x["label"])
            .when(F.abs(carried) < edge, "neutral")
            .when(carried > 0, "bullish")
            .otherwise("bearish")
        )
        moved = score != 0.0
        return F.struct(
            F.when(moved, score).otherwise(acc["a"]).alias("a"),
            F.when(moved, acc["a"]).otherwise(acc["b"]).alias("b"),
            F.when(moved, acc["b"]).otherwise(acc["c"]).alias("c"),
            F.concat(
                acc["out"],
                F.array(F.struct(x["day"].alias("day"), x["scored"].alias("scored"), score.alias("score"), label.alias("label"))),
            ).alias("out"),
        )

    folded = rows.select("symbol", F.aggregate("rows", start, step)["out"].alias("out"))
    return folded.select("symbol", F.explode("out").alias("o")).select("symbol", "o.*")
