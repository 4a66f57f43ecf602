"""Exact deduplication with keyed streaming state.

Digests of the normalised texts arrive as a stream. A streaming aggregation whose state lies in RocksDB on disk, without watermark or expiry,
retains for each digest a stable identifier (the row to keep), a content locator (the file that holds its text) and a count. A micro-batch
reduces its own rows first, so that a digest with a third of all rows still sends one row per task to the state. Every digest that was hit
more than once is then checked on the full bytes of its texts; texts that share a digest but differ are separated by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import BLANKS, keep, whole_text
from barline.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Salts of the byte check: rows of one digest are compared with it in so many places.
SALTS = 16
NO_ID = -(1 << 63)


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole_text(text), BLANKS + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_log(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One narrow row per document: doc_id, digest of the normalised text, its code points before that, and the file it lies in."""
    return docs.select("doc_id", digest(normalised("text")).alias("digest"), F.char_length(whole_text("text")).cast("long").alias("n"), F.input_file_name().alias("file"))


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream, so that the caller's settings stay as they are."""
    session = spark.newSession()
    for key, value in (
        ("spark.sql.streaming.stateStore.providerClass", ROCKSDB), ("spark.sql.streaming.stateStore.unloadOnCommit", "true"),
        ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true"),
        ("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64"), ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")),
    ):
        session.conf.set(key, value)
    return session


def absorb(spark: SparkSession, log_path: str, state_path: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream all files of the log that the state has not seen into it; return the state: digest, keep (n, negated id, file), size.

    The same ``state_path`` may be given again after more files were added to the log, also after a failure: the stream goes on where it was.
    """
    session = state_session(spark)
    stream = session.readStream.schema(session.read.parquet(log_path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(log_path)
    best = F.max(F.struct("n", F.coalesce(-F.col("doc_id"), F.lit(NO_ID)).alias("neg_id"), "file")).alias("best")
    query = (
        stream.groupBy("digest").agg(best, F.count(F.lit(1)).alias("size"))
        .writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = session.read.format("statestore").load(state_path)
    best, size = state.schema["value"].dataType.names[:2]
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{best}").alias("best"), F.col(f"value.{size}").alias("size"))


def same_bytes(docs: DataFrame, hit: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, same: whether all texts of a digest that was hit are equal byte for byte (their smallest and largest are the same)."""
    rows = docs.select(normalised("text").alias("norm"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).withColumn("digest", digest(F.col("norm")))
    salted = hit.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.join(salted, ["digest", "salt"], "left_semi").groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 64) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are equal when identical without white space. Of equal texts the one with the most code points stays, then the one with the smallest
    doc_id. A null text is an empty one, so that null, empty and blank texts are one group. A null doc_id comes after all others. A row that is
    repeated with its doc_id counts in group_size each time and has the same decision each time. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    path = scratch_path(spark, "digest-log")
    digest_log(docs, digest).write.parquet(path)
    log = spark.read.parquet(path).select("doc_id", "digest", "n")
    state = absorb(spark, path, scratch_path(spark, "digest-state"), files_per_trigger)
    state = keep(state.select("digest", F.when(F.col("best.neg_id") != NO_ID, -F.col("best.neg_id")).alias("keep_id"), "size"), "digest-kept", spark)
    checked = keep(same_bytes(docs, state.where("size > 1"), digest), "digest-checked")
    clashes = checked.where(~F.col("same")).select("digest")
    out = log.join(state, "digest")
    if not clashes.isEmpty():
        rows = docs.select("doc_id", normalised("text").alias("norm"), F.char_length(whole_text("text")).cast("long").alias("n")).withColumn("digest", digest(F.col("norm")))
        rows = rows.join(clashes, "digest", "left_semi")
        best = F.max(F.struct("n", F.coalesce(-F.col("doc_id"), F.lit(NO_ID)).alias("neg_id")))
        parts = rows.groupBy("digest", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
        parts = parts.select("digest", "norm", F.when(F.col("best.neg_id") != NO_ID, -F.col("best.neg_id")).alias("keep_id"), "size")
        parted = rows.join(parts, ["digest", "norm"]).select("doc_id", "keep_id", "size", sha256(F.col("norm")).alias("digest"))
        out = out.join(clashes, "digest", "left_anti").select("doc_id", "keep_id", "size", "digest").unionByName(parted)
    return out.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
