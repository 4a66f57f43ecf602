"""Sinks: run logs, latest-per-key views over them, JSON examples, line text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline.sources.readers import latest_per


def append_runs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append run summaries, laid out by run type."""
    df.write.mode("append").partitionBy("run_type").format(fmt).save(path)


def upsert_view(log: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Current state of an append-only log: the latest row per key stands for an upsert."""
    return latest_per(log, keys, order)


def export_examples(df: DataFrame, path: str, columns: Sequence[str] = ("prompt", "completion")) -> None:
    """Fine-tuning examples as JSON lines."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def to_line_protocol(ticks: DataFrame, name: str = "market_events") -> DataFrame:
    """One line of text per tick: name, tags, fields, nanoseconds."""
    line = F.concat(
        F.lit(f"{name},symbol="), F.col("symbol"), F.lit(",event_type="), F.col("event_type"),
        F.lit(" price="), F.col("price").cast("string"), F.lit(",volume="), F.col("volume").cast("string"),
        F.lit(",received_ts_ns="), (F.unix_micros("received_ts") * 1000).cast("string"),
        F.lit(" "), (F.unix_micros("event_ts") * 1000).cast("string"),
    )
    return ticks.select(line.alias("line"))


def count_ticks(spark: SparkSession, path: str) -> int:
    """Stored ticks; 0 when there is no table yet."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise
