"""From raw documents to packed sequences: language, copies, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which is written as Parquet and read again as
the documents of the next stage. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import keep, whole_text
from barline.llm.exact_dedup import exact_dedup, normalised, sha256
from barline.llm.language import language_id
from barline.llm.mixing import mix
from barline.llm.ngram_join import Rule, ngram_join
from barline.llm.packing import pack
from barline.llm.queries import LEVELS, RANKS, TOKENIZER, WEIGHTS

#: Share of the tokens that the mixture takes. One epoch: a document that was deduplicated does not come back.
SHARE, EPOCHS = 0.6, 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go."""
    return language_id(docs).where("NOT rejected").select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text. Rows that share an id, or have none, are told apart by their texts."""
    chosen = exact_dedup(docs).where("kept").select(row_key(F.col("text_sha256"))).distinct()
    order = F.struct(F.char_length(whole_text("text")), F.col("text"))
    rows = docs.groupBy(row_key(sha256(normalised("text")))).agg(F.max_by(F.struct(*docs.columns), order).alias("_row"))  # rows of one id and text: the longest
    return rows.join(chosen, "_key", "left_semi").select("_row.*")


def row_key(digest: Column) -> Column:
    """The id, empty where there is none, and the digest of the text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest).alias("_key")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Every row is a document of its own under a number that is written with it, so that rows without an id take part as well and rows that share
    one are linked by their own texts only. Rows without an id come last, by a hash of the text.
    """
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows", spark)
    joined = ngram_join(rows.select(F.col("_row").alias("doc_id"), "text"), Rule(words=5, percent=80)).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "_row")
    named = rows.select("_row", "doc_id", F.xxhash64("text").alias("h")).join(joined, "_row")
    first = named.groupBy("component_id").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The seeded token-prefix of every source under the target weights."""
    return mix(docs, LEVELS, WEIGHTS, share=SHARE, epochs=EPOCHS, columns=docs.columns).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the chosen documents and its place in a sequence."""
    return pack(docs, TOKENIZER, RANKS)


STAGES = [("language", language), ("copies", copies), ("near copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: No SQL can express compression by a dictionary, the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"stage-{i}", spark)
    return docs
