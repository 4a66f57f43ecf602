"""Self-join of documents on the Jaccard similarity of their word n-grams: a size-aware heavy-light join.

Documents with the same set are one class, so that copies cost nothing. Sets are light up to a size at which enumerating their subsets of the
size that a partner must share stops being cheaper than scanning inverted lists; the costs are counted from the data. Light sets meet in equal
subsets. Heavy sets meet in inverted lists of their prefixes: with shingles in one global order, rare ones first, two sets that link share one
among the first few. Candidates pass an exact bound (an odd sketch never exceeds the symmetric difference) and are verified on the sets.

A cluster of near copies would fill the lists with pairs of its own. So lists are read twice: first each row with its neighbours only, whose
links give components; then only pairs of rows of different components. No link between components can be missed, and within one none is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import keep, released

#: Bytes of text that are hashed at once; counters of frequent shingles for each task; most frequent shingles that are put last in the order.
CHUNK, COUNTERS, FREQUENT = 256 << 10, 50_000, 65_536
#: Shingles whose hash ends so are counted exactly, for the mean length of a list.
COUNTED = np.uint64(255)
LARGEST_LIGHT = 64
#: Bits of the sketch that goes with every entry of a list; pairs that it rules out are not written.
SHORT = 1024
#: Pairs of a list that are looked at together.
PAIRS = 100_000
_MUL = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTES[_BLANK] = 0


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union; a set holds the distinct ``words``-word shingles of a text."""

    words: int = 5
    percent: int = 80

    def overlap(self, a, b):
        """Least intersection of linked sets of these sizes."""
        return -((-self.percent * (a + b)) // (100 + self.percent))

    def partner(self, n):
        """Least size of a linked set, also the least intersection with it."""
        return -((-self.percent * n) // 100)

    def prefix(self, n: int) -> tuple[int, int]:
        """Shingles to look at as the larger, and as the smaller set of a pair."""
        return n - self.partner(n) + 1, n - self.overlap(n, n) + 1

    def subset_sizes(self, n: int, light: int) -> list[int]:
        """Sizes of the subsets that a light set shares with light sets not smaller than itself."""
        return sorted({self.partner(b) for b in range(n, min(light, 100 * n // self.percent) + 1) if self.partner(b) <= n})


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(_MUL)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_MUL, pow(_MUL, -1, 1 << 64))):
            factors = np.full(n + CHUNK // 4, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after the other and end at ``ends``, and the text of each word."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = powers(n)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[ends] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=total[1:])
    words = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(ends, start, "right")


def shingle_sets(words: np.ndarray, text: np.ndarray, texts: int, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text; of fewer than n words the whole sequence is one."""
    bounds = np.searchsorted(text, np.arange(texts + 1))
    size = max(0, len(words) - n + 1)
    rolled = np.full(size, n, np.uint64)
    for i in range(n):
        rolled = mixed(rolled + words[i : i + size])
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                x = mixed(x + words[i : i + 1])
            yield x
        else:
            yield np.empty(0, np.uint64)


def long_text_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of a text that is too long to be hashed at once, cut at blanks."""
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and not _BLANK[data[to]]:
            to += 1
        found.append(word_hashes(data[at:to], np.array([to - at]))[0])
        at = to
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The set of every text of an Arrow column, nulls as empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, len(texts))
        part = data[offsets[i] : offsets[j]]
        if len(part) > 4 * CHUNK:  # one long text
            words = long_text_words(part)
            yield from shingle_sets(words, np.zeros(len(words), np.int64), 1, n)
        else:
            ends = offsets[i + 1 : j + 1] - offsets[i]
            words, text = word_hashes(part, ends)
            yield from shingle_sets(words, text, j - i, n)
        i = j


def pruned(keys: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` counters: the next largest count is taken from all."""
    if len(keys) <= limit:
        return keys, counts
    counts = counts - np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1]
    return keys[counts > 0], counts[counts > 0]


def shingle_counts(docs: DataFrame, rule: Rule, counters: int = COUNTERS) -> DataFrame:
    """shingle, n, exact: frequent shingles by bounded counters for each task (never too high), and exact counts of a hashed share of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.empty(0, np.uint64), np.empty(0, np.int64))
        exact: list[np.ndarray] = []
        pending: list[np.ndarray] = []
        held = 0

        def fold(kept):
            keys, counts = np.unique(np.concatenate(pending), return_counts=True)
            some = counts > 1
            keys, back = np.unique(np.concatenate((kept[0], keys[some])), return_inverse=True)
            return pruned(keys, np.bincount(back, np.concatenate((kept[1], counts[some]))).astype(np.int64), counters)

        for batch in batches:
            for own in sets_of(batch.column(0), rule.words):
                exact.append(own[(own & COUNTED) == 0])
                pending.append(own)
                held += len(own)
                if held > 2_000_000:
                    kept, held = fold(kept), 0
                    pending.clear()
        if pending:
            kept = fold(kept)
        chosen, n = np.unique(np.concatenate(exact), return_counts=True) if exact else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((kept[0], chosen)).view(np.int64)), pa.array(np.concatenate((kept[1], n)).astype(np.int64)), pa.array(np.repeat([False, True], [len(kept[0]), len(chosen)]))],
            ["shingle", "n", "exact"],
        )

    return docs.select("text").mapInArrow(released(count), "shingle long, n long, exact boolean").groupBy("shingle", "exact").agg(F.sum("n").alias("n"))


def light_limit(rule: Rule, mean_list: float) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the lists of a prefix."""
    best = 0
    for n in range(1, LARGEST_LIGHT + 1):
        subsets = sum(comb(n, c) for c in rule.subset_sizes(n, LARGEST_LIGHT))
        if subsets > rule.prefix(n)[0] * max(1.0, mean_list):
            break
        best = n
    return best


def sketch(own: np.ndarray) -> bytes:
    """Odd sketch: two bits or more for each shingle (SHORT at least), each the parity of the shingles that fall on it."""
    bits = 1 << min(17, max(SHORT.bit_length() - 1, int(2 * len(own)).bit_length()))
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def short_sketch(long: bytes) -> bytes:
    """A sketch folded to SHORT bits."""
    return np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, SHORT // 8), axis=0).tobytes()


def near_by_sketch(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether short sketches (row, word) leave room for a link of sets of these sizes."""
    return np.bitwise_count(a ^ b).sum(axis=1) <= n_a + n_b - 2 * rule.overlap(n_a, n_b)


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the sets. A longer sketch folds to a shorter one."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def subset_keys(own: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A key for each subset of the given sizes."""
    scrambled = mixed(own + np.uint64(1))
    total, found = scrambled.sum(dtype=np.uint64), []
    for c in sizes:
        gone = np.array(list(combinations(range(len(own)), len(own) - c)), np.int64)
        found.append(mixed((total - scrambled[gone].sum(axis=1, dtype=np.uint64)) * np.uint64(2 * c + 1)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


SIGNED = "doc_id long, n long, k1 long, k2 long, lists array<long>, subsets array<long>, sketch binary, short binary"


def signatures(docs: DataFrame, rule: Rule, frequent: np.ndarray, light: int) -> DataFrame:
    """For each document its set's size, 128-bit key, prefix in the global order, light subsets and sketch; the last three once for each set of a task."""
    low = np.zeros(1 << 22, bool)
    low[(frequent >> np.uint64(42)).astype(np.int64)] = True

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                rows: list[list] = [[] for _ in range(7)]
                for own in sets_of(piece.column(1), rule.words):
                    n, key = len(own), xxhash.xxh3_128_digest(own.tobytes())
                    k1, k2 = np.frombuffer(key, np.int64)
                    lists = subsets = small = short = None
                    if n and key not in seen:
                        seen.add(key)
                        as_larger, as_smaller = rule.prefix(n)
                        often = low[(own >> np.uint64(42)).astype(np.int64)]
                        if often.any():
                            some = own[often]
                            often[often] = frequent[np.minimum(np.searchsorted(frequent, some), len(frequent) - 1)] == some
                        order = own[~often]
                        if len(order) < as_larger:
                            order = np.concatenate((order, own[often]))
                        lists = order[: as_larger if n > light else as_smaller if 100 * n // rule.percent > light else 0].view(np.int64)
                        if n <= light:
                            subsets = subset_keys(own, rule.subset_sizes(n, light)).view(np.int64)
                        small = sketch(own)
                        short = short_sketch(small)
                    for column, value in zip(rows, (n, int(k1), int(k2), lists, subsets, small, short)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))], ["doc_id", "n", "k1", "k2", "lists", "subsets", "sketch", "short"])

    return docs.mapInArrow(released(sign), SIGNED)


def by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the sorted rows, each time with all rows of the lists they hold."""
    waiting: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
        if waiting and rows["key"][0] != waiting[-1]["key"][-1]:
            yield {name: np.concatenate([w[name] for w in waiting]) for name in rows}
            waiting = []
        if cut:
            yield {name: np.concatenate([*(w[name] for w in waiting), rows[name][:cut]]) for name in rows}
            waiting = []
            rows = {name: values[cut:] for name, values in rows.items()}
        waiting.append(rows)
    if waiting:
        yield {name: np.concatenate([w[name] for w in waiting]) for name in waiting[0]}


def shared_lists(entries: DataFrame, rule: Rule) -> DataFrame:
    """Entries (key, n, doc_id, pos) that have a neighbour of a possible size in their list. Only the last row of a batch waits for the next."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_kept = None, False
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near = (key[1:] == key[:-1]) & (rule.partner(n[1:]) <= n[:-1])
            stay = np.concatenate((near, [False])) | np.concatenate(([last_kept], near))
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(stay[:-1]))
            last, last_kept = batch.slice(batch.num_rows - 1), bool(stay[-1])
        if last is not None and last_kept:
            yield last

    return entries.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(released(share), entries.schema)


def paired(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller id first."""
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64))], ["a", "b"])


def neighbours(shared: DataFrame, rule: Rule) -> DataFrame:
    """a, b: each row of a list with the row before it and with the first row of its class of sizes, if the sizes allow a link."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # key, class, n, doc_id of the last row, and n, doc_id of its first
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, doc = (batch.column(i).to_numpy() for i in range(3))
            group = np.floor(np.log(n) / np.log(100 / rule.percent)).astype(np.int64)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            first_n, first_doc = n[first], doc[first]
            prev_key, prev_n, prev_doc = np.concatenate((key[:1], key[:-1])), np.concatenate((n[:1], n[:-1])), np.concatenate((doc[:1], doc[:-1]))
            if carry:
                prev_key[0], prev_n[0], prev_doc[0] = carry[0], carry[2], carry[3]
                if carry[:2] == (key[0], group[0]):
                    at = first == 0
                    first_n[at], first_doc[at] = carry[4], carry[5]
            near = (prev_key == key) & (rule.partner(n) <= prev_n) & (prev_doc != doc)
            far = (rule.partner(n) <= first_n) & (first_doc != doc)
            carry = (key[-1], group[-1], n[-1], doc[-1], first_n[-1], first_doc[-1])
            yield paired(np.concatenate((prev_doc[near], first_doc[far])), np.concatenate((doc[near], doc[far])))

    return shared.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(released(pair), "a long, b long").distinct()


def across(shared: DataFrame, labels: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """a, b: all pairs of rows of a list that lie in different components, as far as sizes, places in the order and short sketches allow a link."""
    rows = keep(shared.join(labels, "doc_id", "left").select("key", "n", "doc_id", "pos", F.coalesce("label", "doc_id").alias("label")), "ngram-labelled")
    sketches = classes.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.first("short")).alias("short"))
    several = rows.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("key")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_runs(batches):
            key, n, doc, pos, label, bits, known = (run[c] for c in ("key", "n", "doc_id", "pos", "label", "short", "known"))
            bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(key), -1)
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            lo = np.zeros(len(key), np.int64)  # the first row of the list whose size allows a link
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for a, b in zip(heads, [*heads[1:], len(key)]):
                lo[a:b] = a + np.searchsorted(n[a:b], rule.partner(n[a:b]), "left")
            smaller = pos < n - rule.overlap(n, n) + 1
            upto = np.cumsum(np.arange(len(key)) - lo)
            step = 0
            while step < len(key):
                done = upto[step - 1] if step else 0
                to = max(step + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
                j = np.arange(step, to)
                width = j - lo[j]
                right = np.repeat(j, width)
                left = np.arange(len(right)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[j], width)
                step = to
                ok = smaller[left] & (label[left] != label[right])
                left, right = left[ok], right[ok]
                ok = 1 + np.minimum(n[left] - 1 - pos[left], n[right] - 1 - pos[right]) >= rule.overlap(n[left], n[right])
                left, right = left[ok], right[ok]
                ok = near_by_sketch(bits[left], bits[right], n[left], n[right], rule) | ~known[left] | ~known[right]
                if ok.any():
                    yield paired(doc[left[ok]], doc[right[ok]])

    rows = rows.join(several, "key", "left_semi").join(sketches, "doc_id", "left")
    none = F.lit(bytes(SHORT // 8))
    rows = rows.select("key", "n", "doc_id", "pos", "label", F.coalesce("short", none).alias("short"), F.col("short").isNotNull().alias("known"))
    return rows.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(released(pair), "a long, b long").distinct()


def verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link: first by the bound of the sketches, then by the sets themselves."""
    sketches = signed.where("n > 0").select("doc_id", F.col("n").alias("n"), "sketch")
    first, second = sketches.toDF("a", "n_a", "s_a"), sketches.toDF("b", "n_b", "s_b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")]
            stay = [x is None or y is None or sketch_distance(x, y) <= m + n - 2 * rule.overlap(m, n) for m, n, x, y in zip(*rows)]
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    likely = keep(pairs.join(first, "a").join(second, "b").mapInArrow(released(near), "a long, b long"), "ngram-likely").distinct()
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x.tobytes() for x in sets_of(piece.column(1), rule.words)], pa.binary())], ["doc_id", "own"])

    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(released(build), "doc_id long, own binary")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                stay.append(common > 0 and common >= rule.overlap(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").mapInArrow(released(link), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc_id, label: the smallest id that each id of the links is connected with. Every round each id joins its smallest neighbour's."""
    links = keep(links, "cc-links")
    labels = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("label", F.col("doc_id"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "cc-parents")
        parent = keep(parent.join(parent.toDF("p", "q"), "p", "left").select("a", F.coalesce("q", "p").alias("p")), "cc-grandparents")
        labels = keep(labels.join(parent.toDF("label", "p"), "label", "left").select("doc_id", F.coalesce("p", "label").alias("label")), "cc-labels")
        links = links.join(parent.toDF("a", "p_a"), "a").join(parent.toDF("b", "p_b"), "b")
        links = keep(links.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).where("a < b").distinct(), "cc-links")
    return labels


def ngram_join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Return doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; others are ignored).

    Words are cut at white space and A-Z are lower-cased. A null, empty or blank text has no shingles and is linked with nothing: its component is
    its own id. Rows that repeat a doc_id are one document: links of any of its texts are links of the id. A null doc_id takes no part and has a null
    component. No rows give no rows. Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = keep(shingle_counts(docs, rule), "ngram-counts")
    often = counts.where("NOT exact AND n >= 8").orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()  # at most FREQUENT
    frequent = np.array(sorted(np.int64(r.shingle).astype(np.uint64) for r in often), np.uint64)
    squares = counts.where("exact").agg((F.sum(F.col("n").cast("double") * F.least(F.col("n"), F.lit(64))) / F.sum("n")).alias("m")).first().m
    light = light_limit(rule, squares or 1.0)
    signed = keep(signatures(docs, rule, frequent, light), "ngram-signed")
    ids = F.min("doc_id").alias("doc_id")
    payload = F.first(F.when(F.col("sketch").isNotNull(), F.struct("lists", "subsets", "sketch", "short")), ignorenulls=True).alias("s")
    classes = signed.where("n > 0").groupBy("k1", "k2", "n").agg(ids, payload).where("doc_id IS NOT NULL")
    classes = keep(classes.select("k1", "k2", "n", "doc_id", "s.*"), "ngram-classes")
    lists = classes.select("n", "doc_id", F.posexplode("lists").alias("pos", "key"))
    subsets = classes.select("n", "doc_id", F.lit(0).alias("pos"), F.explode("subsets").alias("key"))
    columns = [F.col("key"), F.col("n").cast("int").alias("n"), "doc_id", F.col("pos").cast("int").alias("pos")]
    shared = keep(shared_lists(lists.select(*columns).unionByName(subsets.select(*columns)), rule), "ngram-shared")
    near = keep(neighbours(shared, rule), "ngram-near")
    links = keep(verified(near, classes, docs, rule), "ngram-links")
    labels = components(links)
    far = keep(across(shared, labels, classes, rule).join(near, ["a", "b"], "left_anti"), "ngram-far")
    links = links.unionByName(verified(far, classes, docs, rule))
    labels = components(links)
    of_class = classes.select("k1", "k2", "doc_id").join(labels, "doc_id", "left").select("k1", "k2", F.coalesce("label", "doc_id").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return signed.select("doc_id", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
