"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against all documents before it and its own text before the place. The reference is an index of *contexts*, dealt out in
blocks by hash: the words around an anchor (the least of the eight-word shingles of a window by hash, which equal windows share), that is, all
windows whose anchor it is. A document's contexts meet every block in equi-joins. A context that starts earlier elsewhere is copied whole, and
neighbouring copies from one source join to a longer factor. Where a context is not copied whole a factor has its boundary: the windows there are
looked up one by one. Only the text around shingles that occur more than once is ever looked at, and equal contexts of a batch of documents are
sent once, so that a passage which a third of all documents hold costs a row for each batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import keep, whole_text

WINDOW, GRAM = 20, 8
#: Words of a batch whose contexts are made distinct together, and bytes of a text that are split at a time.
BATCH_WORDS, PIECE = 1 << 20, 1 << 18
#: Fixed multipliers of the hashes, from a seeded generator: odd 64-bit numbers.
ODD = np.random.default_rng(20).integers(1, 1 << 63, 2 * WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The place of a document in the order: rows without an id last, rows of one id by a hash of their texts.
AT, KEY = "none boolean, doc long, tie long", ["none", "doc", "tie"]
#: The same for joins, the part that differs most in front.
BY = ["tie", "doc", "none"]
FACTORS = "array<struct<start:long,length:long,source_id:long,source_start:long>>"


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of the text, some at a time: bytes.split() knows the six white characters of the contract and no others."""
    raw, start = text.encode(), 0
    while start < len(raw):
        blank = BLANK.search(raw, start + PIECE)
        end = blank.start() if blank else len(raw)
        yield raw[start:end].split()
        start = end


def numbers_of(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), np.uint64) for w in words_of(text)]])


def sequences(words: np.ndarray, length: int, first: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    total = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for i in range(length if len(total) else 0):
        total += ODD[first + i] * words[i : i + len(total)]
    return mixed(total)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def anchors(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each anchor, and the first window and the number of windows whose anchor it is; ``grams``: hashes of all shingles of a document.

    The least shingle of a window is the one with the least upper bits of its hash, of equal ones the first.
    """
    reach = WINDOW - GRAM + 1
    if len(grams) < reach:
        return (np.zeros(0, np.int64),) * 3
    low = np.uint64(max(20, len(grams).bit_length()))
    places_ = np.uint64((1 << int(low)) - 1)
    least, width = (grams & ~places_) | np.arange(len(grams), dtype=np.uint64), 1
    while width < reach:  # minima of runs twice as long
        step = min(width, reach - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    at = (least & places_).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[start], start, np.diff(np.concatenate([start, [len(at)]]))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))


def places(docs: DataFrame) -> DataFrame:
    """none, doc, tie: the document's place in the order; text."""
    text = whole_text("text")
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def surveyed(rows: DataFrame) -> DataFrame:
    """Place, number of words, digest of all words, and hashes of the anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, found = [], [], []
            for text in batch.column(3):
                digest, parts = hashlib.sha256(), []
                for words in words_of(text.as_py()):
                    if words:
                        digest.update((b" " if parts else b"") + b" ".join(words))
                        parts.append(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64))
                own = np.concatenate([np.zeros(0, np.uint64), *parts])
                grams = sequences(own, GRAM)
                n.append(len(own))
                digests.append(digest.hexdigest())
                found.append(grams[anchors(grams)[0]])
            sizes = np.array([len(x) for x in found], np.int64)
            grams = lists(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.string()), grams], [*KEY, "n_words", "sha256", "grams"])

    return rows.mapInArrow(run, f"{AT}, n_words long, sha256 string, grams array<long>")


def contexts(rows: DataFrame) -> DataFrame:
    """Contexts around the shingles in ``grams`` (none, doc, tie, text, grams), distinct in a batch: gram, context, place and start of the first, number of windows, their hashes.

    Rows with ``start2`` are copies inside a batch: place, start, number of windows, and place and start of the source.
    """
    names = ["gram", "context", *KEY, "start", "n", "windows", *(f"{c}2" for c in KEY), "start2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ats, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, ats, size
            sizes = np.array([len(p[0]) for p in parts])
            gram, context, start, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
            windows, upto = np.concatenate([p[4] for p in parts]), np.cumsum(n)
            none, id_, tie = (np.array(x) for x in zip(*ats))
            place = np.lexsort((tie, id_, none))
            rank = np.empty(len(ats), np.int64)  # equal places, i.e. a repeated row, have one rank
            rank[place] = np.cumsum(np.concatenate([[0], (none[place][1:] != none[place][:-1]) | (id_[place][1:] != id_[place][:-1]) | (tie[place][1:] != tie[place][:-1])]))
            doc = np.repeat(np.arange(len(ats)), sizes)
            by = np.lexsort((start, rank[doc], context, gram))
            new = np.concatenate([[True], (gram[by][1:] != gram[by][:-1]) | (context[by][1:] != context[by][:-1])]) if len(by) else np.zeros(0, bool)
            source = by[new][np.cumsum(new) - 1] if len(by) else by

            def key(k: np.ndarray) -> list[pa.Array]:
                return [pa.array(x[doc[k]]) for x in (none, id_, tie)] + [pa.array(start[k])]

            kept = np.sort(by[new])
            for i in range(0, len(kept), 8192):
                k = kept[i : i + 8192]
                flat = np.repeat(upto[k] - np.cumsum(n[k]), n[k]) + np.arange(n[k].sum())
                m = len(k)
                yield pa.RecordBatch.from_arrays([signed(gram[k]), signed(context[k]), *key(k), pa.array(n[k]), lists(windows[flat].view(np.int64), n[k]), *[pa.nulls(m, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int64())]], names)
            again, src = by[~new], source[~new]
            other = (rank[doc[again]] != rank[doc[src]]) | (start[again] != start[src])  # a row does not start earlier than itself
            again, src = again[other], src[other]
            for i in range(0, len(again), 65536):
                k, j = again[i : i + 65536], src[i : i + 65536]
                m = len(k)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *key(k), pa.array(n[k]), pa.nulls(m, pa.list_(pa.int64())), *key(j)], names)
            parts, ats, size = [], [], 0

        for batch in batches:
            for *at, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                own = numbers_of(text.as_py())
                grams = sequences(own, GRAM)
                place, start, n = anchors(grams)
                use = np.isin(grams[place].view(np.int64), wanted.values.to_numpy())
                place, start, n = place[use], start[use], n[use]
                first = np.cumsum(n) - n
                flat = np.repeat(start - first, n) + np.arange(n.sum())
                own_windows = sequences(own, WINDOW, WINDOW)[flat]
                # A context is told by its windows and where the anchor lies in them.
                powers = ODD[np.arange(len(flat)) - np.repeat(first, n)]
                total = np.add.reduceat(mixed(own_windows) * powers, first) if len(first) else np.zeros(0, np.uint64)
                context = mixed(total + (place - start).astype(np.uint64) * ODD[-1] + n.astype(np.uint64) * ODD[-2])
                parts.append((grams[place], context, start, n, own_windows))
                ats.append(at)
                size += len(own) + 1
                if size >= BATCH_WORDS:
                    yield from flush()
        if parts:
            yield from flush()

    return rows.mapInArrow(run, f"gram long, context long, {AT}, start long, n long, windows array<long>, none2 boolean, doc2 long, tie2 long, start2 long")


def factors(doc: np.ndarray, start: np.ndarray, n: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of the documents of a batch: copied stretches, each as long as its source goes on.

    Takes for each copied run of windows its document, first window, number of windows, and the source; returns the runs in order, the first run of
    each factor, and where the factors end.
    """
    order = np.lexsort((start, doc))
    doc, start, source, shift, end = doc[order], start[order], source[order], (source_start - start)[order], (start + n)[order] + WINDOW - 1
    goes_on = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (shift[1:] == shift[:-1]) & (start[1:] <= end[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(doc) else np.zeros(0, np.int64)
    return order, first, np.maximum.reduceat(end, first) if len(first) else first


def without_copies(rows: DataFrame) -> DataFrame:
    """Counts, digest and factors of each document, given its copied spans (none, doc, tie, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(4)
            sizes = np.diff(spans.offsets.to_numpy())
            span = {f.name: c for f, c in zip(spans.values.type, spans.flatten().flatten())}
            doc = np.repeat(np.arange(len(sizes)), sizes)
            start, n, source_start, tie2 = (span[c].to_numpy(zero_copy_only=False) for c in ("start", "n", "start2", "tie2"))
            order, first, end = factors(doc, start, n, tie2, source_start)
            at = order[first]
            own, begin = doc[at], start[at]
            source_id = pa.array(span["doc2"].to_numpy(zero_copy_only=False)[at], mask=span["none2"].to_numpy(zero_copy_only=False)[at])
            edge = np.searchsorted(own, np.arange(len(sizes) + 1))
            counts: list[list] = [[], [], []]
            for i, text in enumerate(batch.column(3)):
                a, b = edge[i], edge[i + 1]
                change = np.zeros(int(end[a:b].max()) + 1, np.int64)
                np.add.at(change, begin[a:b], 1)
                np.add.at(change, end[a:b], -1)
                left = np.cumsum(change) == 0
                digest, total, kept = hashlib.sha256(), 0, 0
                for words in words_of(text.as_py()):
                    mask = left[total : total + len(words)].tolist()
                    rest = [*compress(words, mask), *words[len(mask) :]]
                    if rest:
                        digest.update((b" " if kept else b"") + b" ".join(rest))
                    total, kept = total + len(words), kept + len(rest)
                for column, value in zip(counts, (total, total - kept, digest.hexdigest())):
                    column.append(value)
            parse = pa.StructArray.from_arrays([pa.array(begin), pa.array(end - begin), source_id, pa.array(source_start[at])], ["start", "length", "source_id", "source_start"])
            lists_ = pa.ListArray.from_arrays(edge.astype(np.int32), parse)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64()), pa.array(counts[2], pa.string()), lists_], [*KEY, "n_words", "n_removed", "kept_sha256", "factors"])

    return rows.mapInArrow(run, f"{AT}, n_words long, n_removed long, kept_sha256 string, factors {FACTORS}")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Return doc_id, n_words, n_removed, kept_sha256, factors for every row of ``docs`` (doc_id, text; other columns are ignored).

    Of 20 words that are equal to 20 words which start earlier, all are removed; earlier is in a document of smaller id, or before in the same one.
    Stretches are judged on the texts as given. A null text is empty. Rows without an id come last; rows of one id and different texts are parts of
    one another in the order of a hash of their texts; a row that is repeated with its id and text is one document and has the same result each
    time. Words are compared by 64-bit hashes, stretches by those of eight words and of all twenty. No rows give no rows.
    """
    rows = places(docs)
    survey = keep(surveyed(rows), "substring-survey", docs.sparkSession)
    repeated = survey.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    wanted = survey.select(*KEY, F.explode(F.array_distinct("grams")).alias("gram")).join(repeated, "gram").groupBy(*KEY).agg(F.collect_set("gram").alias("grams"))
    found = keep(contexts(rows.join(wanted, BY).select(*KEY, "text", "grams")), "substring-contexts")

    place, source = F.struct(*KEY, "start"), [*(F.col(f"first.{c}").alias(f"{c}2") for c in KEY), F.col("first.start").alias("start2")]
    index = found.where("start2 IS NULL")
    first = index.groupBy("gram", "context").agg(F.min(place).alias("first"))
    shared = first.groupBy("gram").agg((F.count(F.lit(1)) > 1).alias("shared"))  # shingles in several contexts
    judged = index.join(first, ["gram", "context"]).join(shared, "gram").withColumn("copied", F.col("first") != place)
    judged = keep(judged.where("copied OR shared").select("gram", *KEY, "start", "n", "first", "copied", F.when(~F.col("copied"), F.col("windows")).alias("windows")), "substring-judged")
    whole = judged.where("copied").select(*KEY, "start", "n", *source)
    edges = judged.where("NOT copied").select("gram", *KEY, "start", F.posexplode("windows").alias("i", "window"))
    edges = edges.select("gram", "window", *KEY, (F.col("start") + F.col("i")).alias("start"))
    earliest = edges.groupBy("gram", "window").agg(F.min(place).alias("first"))
    single = edges.join(earliest, ["window", "gram"]).where(F.col("first") != place).select(*KEY, "start", F.lit(1).cast("long").alias("n"), *source)
    again = found.where("start2 IS NOT NULL").select(*whole.columns)
    spans = again.unionByName(whole).unionByName(single).groupBy(*KEY).agg(F.collect_set(F.struct(*whole.columns[3:])).alias("spans"))
    spans = keep(spans, "substring-spans")

    cut = without_copies(rows.join(spans, BY).select(*KEY, "text", "spans"))
    clean = survey.join(spans.select(*KEY), BY, "left_anti").select(*KEY, "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast(FACTORS).alias("factors"))
    doc_id = F.when(~F.col("none"), F.col("doc")).alias("doc_id")
    return cut.unionByName(clean).select(doc_id, "n_words", "n_removed", "kept_sha256", F.coalesce("factors", F.array().cast(FACTORS)).alias("factors"))
