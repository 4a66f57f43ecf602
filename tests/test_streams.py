"""Streams fed in many micro-batches equal their batch twins; restarts, late ticks and replays are safe."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barline.streaming import ticks as st

SCHEMA = "symbol string, event_type string, price double, volume double, event_ts timestamp, event_id long"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice("abc"), "quote" if i % 9 == 0 else "bar", 100 + rng.uniform(-3, 3), 1.0, T0 + dt.timedelta(seconds=20 * i), i) for i in range(240)]


@pytest.fixture
def files(spark, rows, tmp_path):
    """Eight files whose names and times follow the order of the ticks."""
    import os

    src = tmp_path / "src"
    src.mkdir()
    for n in range(8):
        part = rows[30 * n : 30 * (n + 1)]
        lines = spark.createDataFrame(part, SCHEMA).select(F.to_json(F.struct("*")).alias("v")).toPandas()["v"]
        path = src / f"{n}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return src


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))


def test_price_moves_stream_equals_batch(spark, rows, files, tmp_path):
    st.use_rocksdb(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    st.run_to_end(st.price_move_intents(stream(spark, files), 100), out, state)
    batch = st.price_moves(spark.createDataFrame(rows, SCHEMA), 100)
    got, want = spark.read.parquet(out).select(*batch.columns).collect(), batch.collect()
    assert sorted(got) == sorted(want) and len(want) > 20
    # A restart from the checkpoint finds nothing new and repeats nothing.
    st.run_to_end(st.price_move_intents(stream(spark, files), 100), out, state)
    assert spark.read.parquet(out).count() == len(want)


def test_stops_stream_equals_batch(spark, rows, files, tmp_path):
    st.use_rocksdb(spark)
    held = spark.createDataFrame([("a", 100.0), ("b", 99.0)], "symbol string, avg_entry double")
    st.run_to_end(st.stream_stops(stream(spark, files), held, 0.02, 0.03), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = st.stops_batch(spark.createDataFrame(rows, SCHEMA), held, 0.02, 0.03)
    got = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect()
    assert sorted(got, key=str) == sorted(batch.collect(), key=str)


def test_bars_drop_late_and_repeated_ticks(spark, tmp_path):
    import os

    src = tmp_path / "src"
    src.mkdir()
    minute = lambda m, p, i: ("a", "bar", p, 1.0, T0 + dt.timedelta(minutes=m), i)
    batches = [[minute(0, 1.0, 1), minute(0, 1.0, 1), minute(1, 2.0, 2)], [minute(30, 3.0, 3)], [minute(32, 3.5, 7)], [minute(2, 99.0, 4), minute(31, 4.0, 5)], [minute(90, 5.0, 6)]]
    for n, part in enumerate(batches):
        lines = spark.createDataFrame(part, SCHEMA).select(F.to_json(F.struct("*")).alias("v")).toPandas()["v"]
        (src / f"{n}.json").write_text("\n".join(lines))
        os.utime(src / f"{n}.json", (1_700_000_000 + n,) * 2)
    clean = st.clean_ticks(stream(spark, src), "5 minutes")
    st.run_to_end(st.tick_bars(clean, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["ts"].minute: (r["open"], r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (1.0, 2.0, 2.0), 30: (3.0, 3.5, 3.0)}


def bars_of(df):
    return sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in df.collect())


def test_bar_store_equals_batch(spark, rows, files, tmp_path):
    """Windows that lie in several files are corrected by later batches; a restart goes on, a replayed batch overwrites itself."""
    import os

    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    run = lambda: st.write_bars(st.clean_ticks(stream(spark, files), "1 hour"), store, state, "7 minutes").awaitTermination()
    run()
    assert len([f for f in os.listdir(store) if f.startswith("batch=")]) >= 8
    assert bars_of(st.read_bars(spark, store)) == bars_of(st.tick_bars(spark.createDataFrame(rows, SCHEMA), "7 minutes"))
    more = [("a", "bar", 250.0, 2.0, rows[-1][4] - dt.timedelta(minutes=20), 900), ("b", "bar", 1.0, 3.0, rows[-1][4] + dt.timedelta(minutes=1), 901), rows[-1], rows[-1]]
    lines = spark.createDataFrame(more, SCHEMA).select(F.to_json(F.struct("*")).alias("v")).toPandas()["v"]
    (files / "late.json").write_text("\n".join(lines))
    run()  # a late tick inside the delay, a new one, and repeats of an old one
    want = bars_of(st.tick_bars(spark.createDataFrame([*rows, *more[:2]], SCHEMA), "7 minutes"))
    assert bars_of(st.read_bars(spark, store)) == want
    compact = str(tmp_path / "compact")
    st.merged_bars(spark.read.parquet(store)).write.parquet(compact)
    assert bars_of(st.read_bars(spark, compact)) == want


def test_interval_trigger_goes_on_until_stopped(spark, rows, files, tmp_path):
    """With an interval the query stays up, takes what has come since the last tick of the clock, and goes on from its state after a stop."""
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    for _ in range(2):
        q = st.write_bars(st.clean_ticks(stream(spark, files), "1 hour"), store, state, "7 minutes", interval="200 milliseconds")
        try:
            q.processAllAvailable()
            assert q.isActive
        finally:
            q.stop()
    assert bars_of(st.read_bars(spark, store)) == bars_of(st.tick_bars(spark.createDataFrame(rows, SCHEMA), "7 minutes"))


def test_fan_out(spark, rows, files, tmp_path):
    q = st.fan_out(stream(spark, files), str(tmp_path / "store"), str(tmp_path / "audit"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == len(rows)
    assert spark.read.text(str(tmp_path / "audit")).count() == len(rows)


def test_stale_snapshot(spark):
    ticks = spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(seconds=50))], "symbol string, event_ts timestamp")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    now = F.lit(T0 + dt.timedelta(seconds=60))
    got = {r["symbol"]: r["stale"] for r in st.stale_sources(ticks, sources, now, 30).collect()}
    assert got == {"a": True, "b": False, "c": True}
