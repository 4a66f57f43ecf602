"""Bundles put together from shared texts, dealt into many chunks, against the same in plain Python."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from barline.operators import news

BLANK = r"[\t\n\x0b\f\r\x1c-\x20\x85\xa0 ]+"
TEXTS = [(0, "Profit up", "b\n\tc "), (1, "two  words ", ""), (2, "", " \n"), (3, None, ""), (4, " x", "a\xa0court")]
ADDED = ["", " launch", "word", "  "]


def squeezed(x):
    return re.sub(BLANK, " ", x).strip(" ")


def plain(rows, texts):
    lines = []
    for n, (_, _, _, t, added) in enumerate(rows, 1):
        head, tail = texts[t]
        if head is not None:
            lines.append(f"{n}. {squeezed(head + added)}" + (f" Summary: {squeezed(tail)}" if squeezed(tail) else ""))
    return "\n".join(lines) if lines else None


@pytest.mark.parametrize("rows, size", [(1 << 17, 1 << 28), (2, 1 << 28), (1 << 17, 20)])
def test_bundles_of_shared_texts(spark, rows, size):
    at = datetime.datetime(2024, 1, 3, 15)
    stamps = [(f"S{i % 7}", at + datetime.timedelta(minutes=i * 37 % 59), i, i * i % 5, ADDED[i // 3 % 4]) for i in range(60)] + [("N", at, 99, 3, "")]
    articles = spark.createDataFrame([(*s, datetime.date(2024, 1, 3)) for s in stamps], "symbol string, created_at timestamp, article_id long, text_id long, added string, trading_day date")
    texts = spark.createDataFrame(TEXTS, "text_id long, headline string, summary string")
    got = {r.symbol: r for r in news.bundle_news(articles, texts, ["symbol", "trading_day"], rows=rows, size=size).collect()}
    assert len(got) == 8
    for symbol, r in got.items():
        first = sorted((s for s in stamps if s[0] == symbol), key=lambda s: s[1:3])[:5]
        assert r.article_ids == [s[2] for s in first] and r.headline_count == len(first)
        assert r.text == plain(first, {t: rest for t, *rest in TEXTS})
        hits = [name for name, words in news.EVENT_KEYWORDS if any(w in (r.text or "").lower() for w in words)]
        assert r.event_type == (hits or ["other"])[0]


def test_more_articles_of_the_same_texts_make_no_more_copies(spark, monkeypatch):
    monkeypatch.setattr(news, "LEAST_ROWS", 1)
    at, day, cores = datetime.datetime(2024, 1, 3, 15), datetime.date(2024, 1, 3), spark.sparkContext.defaultParallelism
    texts = spark.createDataFrame([(i, f"h{i}", "t") for i in range(3)], "text_id long, headline string, summary string")
    for articles, words in ((20 * cores, 1), (40 * cores, 1), (40 * cores, 9)):
        rows = [(f"S{i}", at, i, i % 3, f" {i // 3 % words}", day) for i in range(articles)]
        stamps = spark.createDataFrame(rows, "symbol string, created_at timestamp, article_id long, text_id long, added string, trading_day date")
        done = news.bundle_news(stamps, texts, ["symbol", "trading_day"], rows=8)
        chunks = done.select("article_ids", "text", F.spark_partition_id().alias("chunk")).collect()
        assert {(r.article_ids[0], r.text) for r in chunks} == {(i, f"1. h{t}{w} Summary: t") for _, _, i, t, w, _ in rows}
        # a chunk for each core; only where a text has more than 8 different lines, chunks of 8 articles
        most = cores if words == 1 else articles // 8
        assert max(r.chunk for r in chunks) < most and (words == 1 or max(r.chunk for r in chunks) >= cores)


def test_texts_beyond_the_memory_limit_lie_in_a_file():
    texts = news._Texts(1000)
    for i in range(50):
        texts.add(i, b"h" * i, None if i % 7 == 0 else b"t" * 100, {b" w": i})
    assert texts.packed._rolled and all(texts.get(i) == (b"h" * i, None if i % 7 == 0 else b"t" * 100, {b" w": i}) for i in (49, 0, 7, 31, 49))
