"""Readers, sinks, text edges, calendar edges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barline import schemas
from barline.operators import joins, news
from barline.operators.calendar import session_label
from barline.sources import readers, sinks


def test_json_lines(spark, tmp_path):
    lines = ['{"a": 1, "t": "x"}{"a": 2, "t": "y } { z"}', "", '{"a": 3, "t": "q}{"}', '{"a": broken', '{"a": 4, "t": "c"} \t {"a": 5, "t": "say {\\"k\\": 1} {\\"k\\": 2}"}']
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines))
    got = readers.read_jsonl(spark, str(path), "a int, t string").collect()
    good = {r["a"]: r["t"] for r in got if r["_corrupt"] is None}
    assert good == {1: "x", 2: "y } { z", 3: "q}{", 4: "c", 5: 'say {"k": 1} {"k": 2}'}
    assert sum(r["_corrupt"] is not None for r in got) == 1


def test_index_csv(spark, tmp_path):
    path = tmp_path / "idx.csv"
    path.write_text("DATE,OPEN,CLOSE\n2024-01-02,1,10\n01/03/2024,1,11\n2024-01-02,1,12\nbad,1,13\n04-Jan-2024,1,x\n")
    got = readers.read_index_csv(spark, str(path), "vix").orderBy("ts").collect()
    assert [(r["ts"].day, r["value"]) for r in got] == [(2, 12.0), (3, 11.0)]


def test_scores_last_write_wins(spark, tmp_path):
    row = {"symbol": "A", "trading_day": "2024-01-02", "label": "bullish", "article_ids": [1], "prompt_hash": "h", "model_name": "m"}
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(json.dumps(dict(row, score=s)) for s in (0.1, 0.7)))
    got = readers.read_scores(spark, str(path)).collect()
    assert [r["score"] for r in got] == [0.7]


def test_read_bars_and_schema(spark, tmp_path):
    t = dt.datetime(2024, 1, 2)
    rows = [("A", t, 1.0, 2.0, 0.5, 1.5, 10.0), ("A", t, 1.0, 2.0, 0.5, 1.5, 11.0), ("B", t, None, 2.0, 0.5, 1.5, 1.0), ("C", t, float("nan"), 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schemas.BARS)
    df.write.parquet(str(tmp_path / "bars"))
    assert [(r["symbol"], r["volume"]) for r in readers.read_bars(spark, str(tmp_path / "bars")).collect()] == [("A", 11.0)]
    with pytest.raises(ValueError):
        schemas.validate_schema(df.drop("close"), schemas.BARS)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in (1, 2):
        sinks.append_runs(spark.createDataFrame([("k", i, "historical")], "key string, n int, run_type string"), path)
    log = spark.read.parquet(path)
    assert log.count() == 2 and sinks.upsert_view(log, ["key"], ["n"]).first()["n"] == 2
    assert sinks.count_ticks(spark, path) == 2 and sinks.count_ticks(spark, str(tmp_path / "none")) == 0


def test_dates_before_the_calendar_go_to_its_first_day(spark):
    day = dt.date
    cal = spark.createDataFrame([(day(2024, 1, 2), 0), (day(2024, 1, 4), 1)], "day date, ci long").checkpoint()
    rows = spark.createDataFrame([("old", dt.datetime(2021, 6, 1, 12)), ("late", dt.datetime(2024, 1, 2, 22)), ("past", dt.datetime(2024, 1, 5, 12))], "article_id string, created_at timestamp").checkpoint()
    got = {r["article_id"]: r["trading_day"] for r in news.effective_day(rows, cal).collect()}
    assert got == {"old": day(2024, 1, 2), "late": day(2024, 1, 4)}
    events = spark.createDataFrame([(day(2020, 5, 5),), (day(2024, 1, 3),), (day(2024, 1, 9),)], "day date").checkpoint()
    assert sorted((r["day"], r["trading_day"]) for r in joins.snap_events(events, cal).collect()) == [(day(2020, 5, 5), day(2024, 1, 2)), (day(2024, 1, 3), day(2024, 1, 4))]


def test_effective_day_edges(spark):
    """Before and at the close, weekend, holiday, past the last day, both sides of the clock change (times in UTC)."""
    cal = spark.createDataFrame(
        [(i, dt.date(*d)) for i, d in enumerate([(2024, 3, 7), (2024, 3, 8), (2024, 3, 11), (2024, 3, 13)])], "ci long, day date"
    )
    at = [(3, 8, 20, 59), (3, 8, 21, 0), (3, 9, 12, 0), (3, 11, 19, 59), (3, 11, 20, 0), (3, 12, 12, 0), (3, 13, 20, 0)]
    rows = spark.createDataFrame([(i, dt.datetime(2024, *a)) for i, a in enumerate(at)], "article_id int, created_at timestamp")
    got = {r["article_id"]: r["trading_day"].day for r in news.effective_day(rows, cal).collect()}
    assert got == {0: 8, 1: 11, 2: 11, 3: 11, 4: 13, 5: 13}


def test_session_label_edges(spark):
    day = dt.date(2024, 7, 2)
    at = [(2, 13, 29), (2, 13, 30), (2, 19, 59), (2, 20, 0), (1, 23, 0)]
    rows = spark.createDataFrame([(i, dt.datetime(2024, 7, *a), day) for i, a in enumerate(at)], "i int, ts timestamp, day date")
    got = [r["s"] for r in rows.select("i", session_label(F.col("ts"), F.col("day")).alias("s")).orderBy("i").collect()]
    assert got == ["pre_market", "intraday", "intraday", "post_close", "post_close"]


def test_completions(spark):
    texts = ['x {"direction": "Bullish ", "strength": "HIGH"} y', "no json", '{"direction": "up"} {"direction": "bearish"}', '{"direction": "bearish", "relative_to_spy": "underperform", "event_type": " Merger", "session": null}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, completion string")
    got = [tuple(r)[2:] for r in news.parse_completions(rows).orderBy("i").collect()]
    assert got == [("bullish", "high", "inline", "other", "mixed"), ("neutral", "low", "inline", "other", "mixed"), ("neutral", "low", "inline", "other", "mixed"), ("bearish", "low", "underperform", "merger", "mixed")]
    answers = ['{"label": "bearish", "confidence": 0.4}', "Bullish, because", "", "maybe"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, answer string")
    assert [tuple(r)[2:] for r in news.parse_sentiment(rows).orderBy("i").collect()] == [("bearish", -0.4), ("bullish", 1.0), ("neutral", 0.0), ("neutral", 0.0)]


def test_carry_sentiment_by_hand(spark):
    days = [("a", i, dt.date(2024, 1, 1 + i), s is not None, s or 0.0, "bullish" if s else "neutral") for i, s in enumerate([0.5, None, None, None, 0.9, None])]
    df = spark.createDataFrame(days, "symbol string, pos long, day date, scored boolean, score double, label string")
    got = [round(r["score"], 6) for r in news.carry_sentiment(df).orderBy("day").collect()]
    # 0.5; 0.5; 0.5 + 0.6*0.5 = 0.8; 0.8 + 0.3 + 0.18 = 1.28 -> 1; scored 0.9; 0.9 + 0.6*1 + 0.36*0.8 -> 1
    assert got == [0.5, 0.5, 0.8, 1.0, 0.9, 1.0]
