"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of sampled texts. A text is encoded with each dictionary, in blocks, and the
language with the fewest bytes wins; a narrow margin to the runner-up is a rejection. Texts and dictionaries are reduced to their distinct
lower-case words first: a word that a text repeats would only be matched with itself and say nothing about the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import released, unit

#: Bound of the fitting sample: about SAMPLE texts for each language, none longer than LONGEST code points; DICTIONARY bytes of them are used.
SAMPLE, LONGEST, DICTIONARY = 240, 20_000, 64 << 10
BLOCK = 8 << 10
#: Texts of fewer bytes are encoded so many times over.
SHORT, REPEATS = 64, 4
#: A text is rejected when the best language saves less than this share of the runner-up's bytes.
MARGIN = 0.003
#: Margin at which the score is one half.
HALF = 0.02
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id"):
    """One document in five is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def distinct_words(text: str) -> bytes:
    coarse = " ".join(dict.fromkeys(text.lower().split()))
    return " ".join(dict.fromkeys(LETTERS.findall(coarse))).encode("utf-8", "replace")


def fit_dictionaries(labelled: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Content of a dictionary for each language of ``labelled`` (doc_id, text, lang), most frequent language first, from a seeded sample."""
    labelled = labelled.select("doc_id", "text", "lang").where(f"text IS NOT NULL AND lang IS NOT NULL AND length(text) BETWEEN 1 AND {LONGEST}")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    rows = labelled.withColumn("u", unit(F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"), F.lit(7))).where(F.col("u") <= share[F.col("lang")]).select("lang", "u", "text").collect()
    out: dict[str, bytes] = {lang: b"" for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for lang, _, text in sorted(rows):
        if len(out[lang]) < size:
            out[lang] += distinct_words(text) + b"\n"
    return {lang: content[:size] for lang, content in out.items() if content.strip()}


class Coder:
    """Bytes that a text takes with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        for content in dictionaries.values():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        data = distinct_words(text)
        if len(data) < SHORT:  # so little would be stored as it is; repeats cost the same with every dictionary
            data = (data + b" ") * REPEATS
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin; ``und`` and 0 for a text that is null or has no letter. Ties go to the more frequent language."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], (min(others) - sizes[best]) / max(1, min(others)) if others else 1.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Return the columns of ``docs`` with lang_pred, score (0 to 1) and rejected added; a column of such a name is replaced.

    ``und`` is the language of a text that is null or has no letter, and of every text when no language was learned; it is rejected. Else a text
    is rejected when the best language saves less than ``margin``; it still carries that language. Repeated rows are judged alike; no rows give none.
    """
    names = ("lang_pred", "score", "rejected")
    docs = docs.drop(*names)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dictionaries)
        for batch in batches:
            found = [coder.predict(text) for text in batch.column("text").to_pylist()]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([1 - 2 ** (-y / HALF) for _, y in found], pa.float64())
            no = pa.array([x == "und" or y < margin for x, y in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, score, no], [*batch.schema.names, *names])

    return docs.mapInArrow(released(judge), schema)


def language_id(docs: DataFrame, learn: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """Learn from the documents that are not held out (of ``learn``, else of ``docs``) and identify every one of ``docs``."""
    learned = fit_dictionaries((docs if learn is None else learn).where(~held_out()))
    return identify(docs, learned, margin)
