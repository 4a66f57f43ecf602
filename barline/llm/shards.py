"""Sharding by sampled splitters.

Keys are the hashes of the texts, so that equal texts lie side by side. A size-weighted sample of the keys gives splitters at quantiles of
the bytes; rows are range-partitioned by them, the ranges are measured, and ranges that came out overfull are subdivided at the finer sample
keys inside them. Cumulative bytes over the measured ranges then cut the order into shards of nearly equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barline.llm.common import keep, unit, whole_text

#: Sampled keys: the only thing whose size the driver sees; fixed, whatever the input.
SAMPLE = 16384
#: Ranges that are aimed at; a measured range of more than one such share is left subdivided.
RANGES = 2048


def splitters(keyed: DataFrame, sample: int, shards: int) -> np.ndarray:
    """Sorted (k, d) keys of a size-weighted sample. A text that few sampled rows have is split from others but not inside.

    A row is drawn with a chance that follows its size, so that about ``sample`` rows are drawn of any number.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 1
    rows = keyed.where(unit("k", "d") < F.col("size") * (sample / total)).select("k", "d").collect()
    pairs = sorted((r.k, r.d) for r in rows)
    counts: dict[int, int] = {}
    for k, _ in pairs:
        counts[k] = counts.get(k, 0) + 1
    hot = max(2, len(pairs) // (20 * shards))
    keys = {(k, d) if counts[k] > hot else (k, -(1 << 63)) for k, d in pairs}
    return np.array(sorted(keys), dtype=np.int64).reshape(-1, 2)


def to_ranges(keyed: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Add ``part``, the number of splitters at or below a row's (k, d)."""
    schema = T.StructType([*keyed.schema.fields, T.StructField("part", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, first = np.unique(cuts[:, 0], return_index=True) if len(cuts) else (np.empty(0, np.int64), np.empty(0, np.int64))
        last = np.append(first[1:], len(cuts))
        inner = {int(h): cuts[a:b, 1] for h, a, b in zip(heads, first, last) if b - a > 1}
        for batch in batches:
            k, d = (batch.column(name).to_numpy() for name in ("k", "d"))
            part = np.searchsorted(cuts[:, 0], k, "right")
            for h, ds in inner.items():  # only texts that fill a good part of a shard
                at = np.flatnonzero(k == h)
                if len(at):
                    part[at] += np.searchsorted(ds, d[at], "right") - len(ds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int64))], [*batch.schema.names, "part"])

    return keyed.mapInArrow(place, schema)


def merged(stats: dict[int, tuple[int, int]], parts: int, ranges: int) -> np.ndarray:
    """Range of each part: neighbours together up to a fair share of the bytes; what is larger stays subdivided."""
    share = sum(b for b, _ in stats.values()) / max(1, ranges)
    out, current, filled = np.zeros(parts, np.int64), 0, 0
    for p in range(parts):
        b = stats.get(p, (0, 0))[0]
        if filled and filled + b > share:
            current, filled = current + 1, 0
        out[p], filled = current, filled + b
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text; others are ignored).

    A null text counts as empty (size 1) and a null doc_id sorts first. Rows are ordered by (hash of the text, doc_id); the row in the middle of
    the bytes of shard s lies in shard s, and equal texts stay together unless sampling shows that they fill a twentieth of a shard or more.
    Repeated rows have slots of their own. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    text = whole_text("text")
    size = (F.octet_length(text) + 1).cast("long")
    keyed = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("d"))
    keyed = keep(keyed, "shard-keys")
    cuts = splitters(keyed, sample, shards)
    parts = to_ranges(keyed, cuts)
    stats = {r.part: (r.b, r.n) for r in parts.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(b for b, _ in stats.values())
    of = merged(stats, len(cuts) + 1, ranges)
    offsets: dict[int, tuple[int, int]] = {}
    b0 = n0 = 0
    for p in range(len(cuts) + 1):
        offsets.setdefault(int(of[p]), (b0, n0))
        b, n = stats.get(p, (0, 0))
        b0, n0 = b0 + b, n0 + n
    hot = sorted({int(h) for h, c in zip(*np.unique(cuts[:, 0], return_counts=True)) if c > 1}) if len(cuts) else []
    table = keyed.sparkSession.createDataFrame([(p, int(of[p]), *offsets[int(of[p])]) for p in range(len(cuts) + 1)], "part long, range long, bytes_before long, rows_before long")
    in_range = Window.partitionBy("range").orderBy("k", "d")
    rows = parts.join(F.broadcast(table), "part")  # at most SAMPLE + 1 rows
    before = F.col("bytes_before") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.withColumn("before", before).withColumn("row", F.col("rows_before") + F.row_number().over(in_range) - 1)
    text_group = Window.partitionBy("range", "k")
    start, length = F.min("before").over(text_group), F.sum("size").over(text_group)
    lone = F.col("k").isin(hot) if hot else F.lit(False)
    middle = F.when(lone, F.col("before") * 2 + F.col("size")).otherwise(start * 2 + length)
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2.0 * max(1, total)))).cast("int"))
    rows = keep(rows.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-rows")
    first = rows.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
