"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import licences, secret_scan
from barline.llm.alignment import align
from barline.llm.common import documents
from barline.llm.exact_dedup import exact_dedup
from barline.llm.language import held_out, language_id
from barline.llm.mixing import mix
from barline.llm.ngram_join import Rule, ngram_join
from barline.llm.packing import pack
from barline.llm.personal import personal_data
from barline.llm.shards import shard_by_bytes
from barline.llm.substring import dedup_substrings
from barline.llm.topk import top_k, whole_numbers
from barline.llm.whitening import whiten

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of every hundredth vector with all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole_numbers("embedding").alias("q"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP2 = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of 2048."""
    return pack(documents(spark, sf_dir), TOKENIZER, RANKS)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles overlap by 85 %."""
    return ngram_join(documents(spark, sf_dir), Rule(words=4, percent=85))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four fifths that are not held out."""
    docs = documents(spark, sf_dir)
    own = docs.select("doc_id", "text")
    return language_id(own, docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


#: Levels and weights of the mix; all sources of a language weigh the same.
LEVELS = {
    "domain": "CASE WHEN source RLIKE '[0-3]$' THEN 'web' WHEN source RLIKE '[4-6]$' THEN 'books' ELSE 'forum' END",
    "language": "lang",
    "origin": "source",
}
WEIGHTS = ["CASE domain WHEN 'web' THEN 0.5D WHEN 'books' THEN 0.3D ELSE 0.2D END", "CASE language WHEN 'en' THEN 0.4D ELSE 0.2D END", "1.0D"]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tenths of all tokens, at most two epochs of a leaf, mixed by domain, language and source."""
    return mix(documents(spark, sf_dir), LEVELS, WEIGHTS, share=0.6, epochs=2)


def _level(i: int) -> str:
    keys = ["domain", "language", "origin"]
    by, up = ", ".join(keys[: i + 1]), ", ".join(keys[:i])
    part, name = f"PARTITION BY {up}" if up else "", keys[i]
    weight = ("CASE domain WHEN 'web' THEN 0.5::DOUBLE WHEN 'books' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END", "CASE language WHEN 'en' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END", "1.0::DOUBLE")[i]
    given = "given0" if i == 0 else f"n{i - 1}.given"
    src = f"(SELECT {by}, sum(tokens) * 2 AS room FROM leaves GROUP BY {by})"
    joined = f"{src} x CROSS JOIN (SELECT sum(tokens) * 0.6::DOUBLE AS given0 FROM leaves)" if i == 0 else f"{src} x JOIN n{i - 1} USING ({up})"
    return f"""
p{i} AS (SELECT {", ".join("x." + k for k in keys[: i + 1])}, x.room, {given} AS budget, {weight} AS w FROM {joined}),
q{i} AS (SELECT *, (budget - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER ({part}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM p{i} WINDOW o AS ({part} ORDER BY room / w, {name})),
n{i} AS (SELECT {by}, least(room::DOUBLE, coalesce(w * arg_min(lev, (room / w, {name})) FILTER (WHERE room > lev * w) OVER ({part}), room::DOUBLE)) AS given FROM q{i})"""


OP8 = rf"""
WITH r AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '[0-3]$') THEN 'web' WHEN regexp_matches(source, '[4-6]$') THEN 'books' ELSE 'forum' END AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS origin, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS digest FROM documents),
leaves AS (SELECT domain, language, origin, sum(tokens) AS tokens FROM r GROUP BY ALL),
{",".join(_level(i) for i in range(3)).strip()},
b AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(given / tokens + 1e-9) AS INTEGER) ELSE 1 END AS whole FROM leaves JOIN n2 USING (domain, language, origin)),
c AS (SELECT domain, language, origin, tokens AS leaf, whole, greatest(0, CAST(floor(given - whole * tokens + 1e-6) AS BIGINT)) AS rest FROM b),
parts AS (
  SELECT doc_id, domain, language, origin, whole AS epoch, tokens, rest,
    sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5(concat_ws(':', '17', whole, coalesce(CAST(doc_id AS VARCHAR), ''), digest)), tokens RANGE UNBOUNDED PRECEDING) AS upto
  FROM r JOIN c USING (domain, language, origin) WHERE rest > 0 AND leaf > 0)
SELECT doc_id, domain, language, origin, CAST(unnest(range(whole)) AS INTEGER) AS epoch, tokens FROM r JOIN c USING (domain, language, origin)
UNION ALL SELECT doc_id, domain, language, origin, epoch, tokens FROM parts WHERE upto <= rest"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of nearly equal bytes."""
    return shard_by_bytes(documents(spark, sf_dir), 16)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for each text."""
    return exact_dedup(documents(spark, sf_dir))


OP10 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k"""

QUERIES = {
    "op2_topk": op2_topk, "op3_packing": op3_packing, "op4_ngram_join": op4_ngram_join, "op7_language": op7_language, "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding, "op10_exact_dedup": op10_exact_dedup,
}
SQL = {"op2_topk": OP2, "op8_mixing": OP8, "op10_exact_dedup": OP10}


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text."""
    return personal_data(documents(spark, sf_dir))


QUERIES["op5_personal_data"] = op5_personal_data


#: Where a document would lie in a source tree.
PATH = "concat_ws('/', source, CAST(doc_id DIV 1000 AS STRING), CAST(doc_id DIV 50 AS STRING), concat(CAST(doc_id AS STRING), '.txt'))"
#: Paths of the licence scan: the same tree, in which a tenth of the documents are licence files, one directory above the other documents.
FILED = "concat_ws('/', source, CAST(doc_id DIV 1000 AS STRING), CASE WHEN doc_id % 10 = 0 THEN concat('LICENSE-', CAST(doc_id AS STRING)) ELSE concat_ws('/', CAST(doc_id DIV 50 AS STRING), concat(CAST(doc_id AS STRING), '.txt')) END)"
#: Labelled findings: the tables hold no reviews, so that an assignment to a secret's name stands for one; a quarter of the findings has no label.
REVIEWED = r"""CASE WHEN pmod(h, 4) <> 0 THEN lead RLIKE '(?i)(token|secret|key|password|passwd|credential)s?\\s*[=:]\\s*["\']?$' END"""


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate string of the documents, and whether the forest takes it for a secret."""
    return secret_scan.scan(documents(spark, sf_dir), REVIEWED, PATH)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or that of the nearest directory."""
    return licences.scan(documents(spark, sf_dir), FILED)


QUERIES |= {"op1_secrets": op1_secrets, "op6_licences": op6_licences}


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the byte-level and the piece tokenizer over every text, with corpus counts."""
    return align(documents(spark, sf_dir), TOKENIZER, PIECES, RANKS)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 32 leading components of their covariance, whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and digest of every text without stretches of twenty words that start earlier."""
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES |= {"op11_alignment": op11_alignment, "op12_whitening": op12_whitening, "op13_substring_dedup": op13_substring_dedup}
