"""Declared schemas of the input tables; production readers never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TICKS = "symbol string, event_type string, price double, volume double, event_ts timestamp, received_ts timestamp"
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
ARTICLES = (
    "article_id bigint, created_at timestamp, headline string, summary string, symbols array<string>, source string, url string"
)
SCORES = "symbol string, trading_day date, label string, score double, article_ids array<bigint>, prompt_hash string, model_name string"
RUNS = (
    "market string, symbol string, strategy_name string, window_name string, run_type string, total_return double, "
    "max_drawdown double, trades int, win_rate double, latest_signal string, score double, created_at timestamp, payload string"
)


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def validate_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Raise when a declared column is missing or has another type; extra columns are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema(ddl).fields:
        if field.name not in have:
            raise ValueError(f"missing column {field.name}")
        if have[field.name] != field.dataType:
            raise ValueError(f"column {field.name} is {have[field.name]}, expected {field.dataType}")
    return df
