"""Tick streams: price moves, staleness, running stops, bars and sessions, each with a batch twin.

State per symbol is a few numbers. Watermarks and de-duplication are optional for the price path (the surveyed
runner takes ticks as they come) and required for bars and sessions.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barline.plans.blocks import in_blocks, number_rows, running

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def clean_ticks(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Bound the state: late ticks beyond ``delay`` may be dropped, repeats of a tick (symbol, event_ts, event_id) are dropped."""
    return stream.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["symbol", "event_ts", "event_id"])


# ---- R01: price moves


class _LastPrice(StatefulProcessor):
    """Last bar price per symbol; emits a side when the move since then reaches the threshold."""

    def __init__(self, threshold_bps: float):
        self.threshold = threshold_bps / 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows), ignore_index=True).sort_values(["event_ts", "event_id"], kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        prior = ticks["price"].shift(1)
        prior.iloc[0] = before
        ticks["prev_price"] = prior.astype(float)
        self.last.update((float(ticks["price"].iloc[-1]),))
        known = ticks["prev_price"] > 0
        up = known & (ticks["price"] >= ticks["prev_price"] * (1 + self.threshold))
        down = known & ~up & (ticks["price"] <= ticks["prev_price"] * (1 - self.threshold))
        ticks["side"] = None
        ticks.loc[up, "side"] = "buy"
        ticks.loc[down, "side"] = "sell"
        out = ticks[up | down]
        if len(out):
            yield out[["symbol", "event_ts", "event_id", "prev_price", "price", "side"]]

    def close(self) -> None:
        pass


MOVES = "symbol string, event_ts timestamp, event_id bigint, prev_price double, price double, side string"


def price_move_intents(stream: DataFrame, threshold_bps: float) -> DataFrame:
    """Streaming form: only ``bar`` ticks count, the first tick of a symbol emits nothing."""
    bars = stream.where("event_type = 'bar'").select("symbol", "event_ts", "event_id", "price")
    return bars.groupBy("symbol").transformWithStateInPandas(_LastPrice(threshold_bps), MOVES, "append", "none")


def price_moves(ticks: DataFrame, threshold_bps: float) -> DataFrame:
    """Batch twin of :func:`price_move_intents`."""
    bars = number_rows(ticks.where("event_type = 'bar'"), ["symbol"], ["event_ts", "event_id"])
    rows = in_blocks(bars, lambda r, w: r.withColumn("prev_price", F.lag("price").over(w)), back=1)
    limit = threshold_bps / 10_000
    known = F.col("prev_price") > 0
    side = F.when(known & (F.col("price") >= F.col("prev_price") * (1 + limit)), "buy").when(
        known & (F.col("price") <= F.col("prev_price") * (1 - limit)), "sell"
    )
    return rows.withColumn("side", side).where("side IS NOT NULL").select("symbol", "event_ts", "event_id", "prev_price", "price", "side")


# ---- R02: staleness


class _Heartbeat(StatefulProcessor):
    """Re-arms a processing-time timer with every tick; a source is stale when the timer fires."""

    def __init__(self, timeout_s: int):
        self.timeout_ms = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        since = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, tz=timezone.utc).replace(tzinfo=None)
        yield pd.DataFrame({"symbol": [key[0]], "stale_since": [pd.Timestamp(since)]})

    def close(self) -> None:
        pass


def stale_stream(stream: DataFrame, timeout_s: int) -> DataFrame:
    """Streaming form: one row per source and silence, when no tick came for ``timeout_s`` seconds."""
    return stream.select("symbol", "event_ts").groupBy("symbol").transformWithStateInPandas(
        _Heartbeat(timeout_s), "symbol string, stale_since timestamp", "append", "ProcessingTime"
    )


def stale_sources(ticks: DataFrame, sources: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Snapshot: sources without a tick in the last ``timeout_s`` seconds, or without any."""
    last = ticks.groupBy("symbol").agg(F.max("event_ts").alias("last_seen"))
    silent = F.unix_micros(now) - F.unix_micros("last_seen") > timeout_s * 1_000_000
    return sources.join(last, "symbol", "left").select("symbol", "last_seen", F.coalesce(silent, F.lit(True)).alias("stale"))


# ---- R03: running high-water and stops


class _HighWater(StatefulProcessor):
    """Running high-water mark per position; the stop is tested on every tick."""

    def __init__(self, stop_loss: float, trailing: float):
        self.stop_loss, self.trailing = stop_loss, trailing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "high double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows), ignore_index=True).sort_values(["event_ts", "event_id"], kind="stable")
        entry = float(ticks["avg_entry"].iloc[0])
        start = max(entry, self.mark.get()[0]) if self.mark.exists() else entry
        ticks["high_water"] = ticks["price"].cummax().clip(lower=start)
        self.mark.update((float(ticks["high_water"].iloc[-1]),))
        fixed = entry * (1 - self.stop_loss)
        trail = ticks["high_water"] * (1 - self.trailing)
        ticks["reason"] = None
        ticks.loc[ticks["price"] <= trail, "reason"] = "trailing_stop"
        ticks.loc[ticks["price"] <= fixed, "reason"] = "stop_loss"
        yield ticks[["symbol", "event_ts", "event_id", "price", "high_water", "reason"]]

    def close(self) -> None:
        pass


STOPS = "symbol string, event_ts timestamp, event_id bigint, price double, high_water double, reason string"


def stream_stops(stream: DataFrame, positions: DataFrame, stop_loss: float, trailing: float) -> DataFrame:
    """Streaming form: ticks joined to a static position table (symbol, avg_entry)."""
    held = stream.select("symbol", "event_ts", "event_id", "price").join(positions.select("symbol", "avg_entry"), "symbol")
    return held.groupBy("symbol").transformWithStateInPandas(_HighWater(stop_loss, trailing), STOPS, "append", "none")


def stops_batch(ticks: DataFrame, positions: DataFrame, stop_loss: float, trailing: float) -> DataFrame:
    """Batch twin of :func:`stream_stops`."""
    held = ticks.select("symbol", "event_ts", "event_id", "price").join(positions.select("symbol", "avg_entry"), "symbol")
    rows = running(number_rows(held, ["symbol"], ["event_ts", "event_id"]), {"_top": ("max", F.col("price"))})
    high = F.greatest("_top", "avg_entry")
    reason = F.when(F.col("price") <= F.col("avg_entry") * (1 - stop_loss), "stop_loss").when(F.col("price") <= high * (1 - trailing), "trailing_stop")
    return rows.select("symbol", "event_ts", "event_id", "price", high.alias("high_water"), reason.alias("reason"))


# ---- R04: decisions on a snapshot


def intraday_decisions(rows: DataFrame) -> DataFrame:
    """Enter on a long prediction with fresh bullish sentiment; exit on a stop, a lost prediction or bearish news.

    ``rows``: symbol, qty, model_long, label, score, stale, stop_reason, exited_today.
    """
    fresh = ~F.col("stale")
    bullish = fresh & (F.col("label") == "bullish") & (F.col("score") > 0)
    bearish = fresh & ((F.col("label") == "bearish") | (F.col("score") < 0))
    held = F.col("qty") > 0
    action = (
        F.when(held & F.col("stop_reason").isNotNull(), F.col("stop_reason"))
        .when(held & (~F.col("model_long") | F.coalesce(bearish, F.lit(False))), "intraday_signal_exit")
        .when(~held & F.col("model_long") & F.coalesce(bullish, F.lit(False)) & ~F.col("exited_today"), "intraday_signal_entry")
        .otherwise("no_action")
    )
    return rows.select("symbol", action.alias("action"))


# ---- bars and sessions


def tick_bars(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """OHLCV per symbol and event-time window; works on a batch and on a watermarked stream."""
    at = F.struct("event_ts", "event_id")
    grouped = ticks.where("event_type = 'bar'").groupBy("symbol", F.window("event_ts", width).alias("w"))
    bars = grouped.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def partial_bars(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """One row for each symbol and window of a set of ticks that can be merged with rows of other sets: prices with the place they stood at."""
    at = F.struct("event_ts", "event_id", "price")
    grouped = ticks.where("event_type = 'bar'").groupBy("symbol", F.window("event_ts", width).alias("w"))
    rows = grouped.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume"))
    return rows.select("symbol", F.col("w.start").alias("ts"), "first", "last", "high", "low", "volume")


def merged_bars(parts: DataFrame) -> DataFrame:
    """Partial rows of the same symbol and window as one; merging is associative, so that it also compacts a store."""
    return parts.groupBy("symbol", "ts").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def write_bars(stream: DataFrame, store: str, checkpoint: str, width: str = "1 minute", interval: str | None = None):
    """Keep bars of a stream of ticks in ``store``: every micro-batch adds its partial bars under its batch id.

    A batch that is run again overwrites its own folder, so that a restart counts no tick twice. A tick that comes after its bar was first written
    corrects the bar; the only ticks left out are those that the stream itself drops (:func:`clean_ticks`). No bar waits for a watermark.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_bars(batch, width).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def read_bars(spark, store: str) -> DataFrame:
    """The bars of a store as they stand now: symbol, ts, open, high, low, close, volume."""
    bars = merged_bars(spark.read.parquet(store))
    return bars.select("symbol", "ts", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")


def tick_sessions(ticks: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Bursts of activity: ticks of a symbol closer together than ``gap``."""
    return ticks.groupBy("symbol", F.session_window("event_ts", gap).alias("s")).agg(
        F.count("*").alias("ticks"), F.max("price").alias("high"), F.min("price").alias("low")
    ).select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "ticks", "high", "low")


def sessions_batch(ticks: DataFrame, gap_s: int) -> DataFrame:
    """Batch twin of :func:`tick_sessions` that does not bring all ticks of a symbol together."""
    rows = number_rows(ticks, ["symbol"], ["event_ts", "event_id"])

    def starts(r: DataFrame, w) -> DataFrame:
        near = F.unix_micros("event_ts") - F.unix_micros(F.lag("event_ts").over(w)) < gap_s * 1_000_000
        return r.withColumn("_new", F.when(near, 0).otherwise(1))

    marked = running(in_blocks(rows, starts, back=1), {"_sid": ("sum", F.col("_new"))})
    end = F.max("event_ts") + F.make_dt_interval(secs=F.lit(gap_s))
    return marked.groupBy("symbol", "_sid").agg(
        F.min("event_ts").alias("start"), end.alias("end"), F.count("*").alias("ticks"), F.max("price").alias("high"), F.min("price").alias("low")
    ).drop("_sid")


# ---- R05: fan-out


def fan_out(stream: DataFrame, store: str, audit: str, checkpoint: str, interval: str | None = None):
    """Write every batch to a store and to a JSON audit log, each under its batch id, so a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        batch.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{audit}/batch={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything available now into parquet, however long that takes."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
