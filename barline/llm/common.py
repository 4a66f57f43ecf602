"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import scratch_path

#: White space of the contracts: space and the five control characters next to it.
BLANKS = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"


def keep(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, so that lost executors cost no recomputation of what went before."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for the next task, and its allocators keep what they have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker keeps no more memory than it had before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def whole_text(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def neighbours(items: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """``pair`` of each item of an array and the next one; ``items`` must be a column or bound, else it is worked out twice."""
    rest = F.greatest(F.lit(0), F.size(items) - 1)
    return F.zip_with(F.slice(items, F.lit(1), rest), F.slice(items, F.lit(2), rest), pair)


def unit(*cols: str | Column) -> Column:
    """A fixed number in (0, 1) for each row, drawn from its columns."""
    return ((F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") + 0.5) / float(1 << 52)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
