"""Alignment of two tokenizers over the same texts.

Both tokenizations of a text are lists of byte offsets at which tokens end. An interval is divided at a common end near its middle, which is
looked for outward from the middle by bisection in the other tokenizer's ends; both halves are divided in turn, and an interval without a cut
inside is a leaf group. All intervals of a batch of texts are divided together, one level at a time.

Within a group every A token is linked with every B token whose bytes it overlaps. Counts of linked id pairs are those of the whole corpus: each
chunk of documents sends its distinct pairs once, the sums come back once for each chunk, and a chunk adds up the counts of its own documents, so
that a frequent pair costs a row for each chunk and not for each place in which it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import keep
from barline.llm.packing import LATIN

SPACE = "▁"
#: Links of a chunk, bytes of the texts that are aligned together, characters of the words whose ids a worker remembers.
CHUNK_LINKS, BATCH_BYTES, KNOWN = 4_000_000, 1 << 19, 3 << 20
ENCODED = "chunk long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, at array<int>, times array<int>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level entries: printable bytes for themselves, the others in order from U+0100 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A: byte-level BPE (``a``; ``ranks`` may name the same vocabulary as ranks with its pattern, which is quicker for Latin texts). B: a sentencepiece model."""

    def __init__(self, a: str, b: str, ranks: tuple[str, str] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(a)
        self.whole.encode_special_tokens = True
        letters = byte_letters()
        entries = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        # An added token, written in letters that are no byte's, is never among the ids here.
        self.a_bytes = [bytes(letters.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as file:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
            self.quick = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", t)) else t.replace(SPACE, " ").encode() for t in names]
        # Where no entry holds a space after another character, no token crosses from a word to the space behind it.
        self.divisible = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in names)
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}  # a word is treated alike wherever it stands
        self.size = 0
        # As written in a digest: A inside a group and at its end, B inside a group, at its end and at the end of a text.
        self.words = [f"{i}{end}" for size, own in ((n, ",|"), (m, (",", ";", ""))) for end in own for i in range(size)]

    def a_ids(self, part: str) -> np.ndarray:
        if self.quick and LATIN.fullmatch(part):
            return self.quick.encode_to_numpy(part, disallowed_special=()).astype("<i4")
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, "<i4")

    def learn(self, words: list[str]) -> None:
        """Remember for each word the ids by A of a space and the word, by B of the word, to which the model adds the space, and whether both give back these bytes."""
        if not words:
            return
        whole = " " + " ".join(words)
        raw = whole.encode()
        a, b = self.a_ids(whole), np.array(self.pieces.encode(whole[1:]), "<i4")
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            ends = np.cumsum([len(w.encode()) + 1 for w in words])
            a_at, b_at = (4 * np.searchsorted(np.cumsum(size[ids]), ends, "right") for size, ids in ((self.a_size, a), (self.b_size, b)))
            a_raw, b_raw, s, t = a.tobytes(), b.tobytes(), 0, 0
            for word, i, j in zip(words, a_at.tolist(), b_at.tolist()):
                self.known[word] = a_raw[s:i], b_raw[t:j], True
                s, t = i, j
        elif len(words) == 1:
            self.known[words[0]] = a.tobytes(), b.tobytes(), False
        else:
            self.learn(words[: len(words) // 2])
            self.learn(words[len(words) // 2 :])

    def both(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text; None where there is no text, or a tokenization does not give back the bytes of the space and the text."""
        split = [(WORD_EDGE.split(t) if self.divisible else [t]) if t else None for t in texts]
        fresh = {w for words in split if words for w in words if w not in self.known}
        # Spaces at an edge would run together with the space between two words.
        alone = [w for w in fresh if not self.divisible or w[0].isspace() or w[-1] == " "]
        self.learn([*fresh.difference(alone)])
        for w in alone:
            self.learn([w])
        out = []
        for words in split:
            found = [self.known[w] for w in words] if words else []
            use = found and all([x[2] for x in found])
            out.append(tuple(np.frombuffer(b"".join([x[i] for x in found]), "<i4") for i in (0, 1)) if use else None)
        self.size += sum(map(len, fresh))
        if self.size > KNOWN:
            self.known, self.size = {}, 0
        return out


#: One space between a character that is no space and one that is no white space. Neither tokenizer has a token that crosses it.
WORD_EDGE = re.compile(rf"(?<=[^ {SPACE}]) (?=[^\s{SPACE}])")


@lru_cache(maxsize=1)
def tokenizers(*key) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(*key)


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each A token ends where a B token ends. ``last``: index of the last A token of each text, a cut by itself."""
    cut = np.zeros(len(a_ends), bool)
    cut[last] = True
    low, high = np.concatenate([[0], last[:-1] + 1]), last.copy()  # A ends strictly inside an interval: low to high, exclusive
    while True:
        open_ = high > low
        low, high = low[open_], high[open_]
        if not len(low):
            return cut
        middle = (low + high) // 2
        found = np.full(len(low), -1)
        todo, reach, width = np.arange(len(low)), 0, 1
        while len(todo):  # ends at a distance of reach to reach + width - 1 from the middle
            left = np.maximum(low[todo], middle[todo] - reach - width + 1)
            right = np.minimum(high[todo], middle[todo] + reach + width)
            sizes = right - left
            own = np.repeat(np.arange(len(todo)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[own]
            far = np.abs(at - middle[todo][own])
            fresh = far >= reach
            own, at, far = own[fresh], at[fresh], far[fresh]
            place = np.minimum(np.searchsorted(b_ends, a_ends[at]), len(b_ends) - 1)
            common = b_ends[place] == a_ends[at]
            own, at, far = own[common], at[common], far[common]
            order = np.lexsort((at, far, own))
            own, at = own[order], at[order]
            first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
            found[todo[own[first]]] = at[first]
            done = (left <= low[todo]) & (right >= high[todo])
            todo = todo[(found[todo] < 0) & ~done]
            reach, width = reach + width, width * 2
        has = found >= 0
        cut[found[has]] = True
        low, high = np.concatenate([low[has], found[has] + 1]), np.concatenate([found[has], high[has]])


class Aligned:
    """A batch of texts: counts, digests and links of each."""

    def __init__(self, own: Tokenizers, texts: list[str | None]):
        both = own.both(texts)
        use = [x for x in both if x]
        self.used = np.array([x is not None for x in both], bool)
        zero = np.zeros(len(texts), np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = (zero.copy() for _ in range(4))
        self.digests, self.pairs = [""] * len(texts), np.zeros(0, np.int64)
        if not use:
            return
        a, b = (np.concatenate([x[i] for x in use]).astype(np.int64) for i in (0, 1))
        n_a, n_b = np.array([len(x[0]) for x in use]), np.array([len(x[1]) for x in use])
        a_ends, b_ends = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
        last = np.cumsum(n_a) - 1
        cut = cuts(a_ends, b_ends, last)
        # For each byte whether a token of A, a token of B, a group ends there, and how many ended before.
        ends = np.zeros((3, a_ends[-1] + 1), bool)
        for mark, at in zip(ends, (a_ends, b_ends, a_ends[cut])):
            mark[at] = True
        a_before, b_before, groups_before = (np.cumsum(mark, dtype=np.int32) - mark for mark in ends)
        a_group, b_group = groups_before[a_ends], groups_before[b_ends]
        b_last = np.concatenate([b_group[1:] != b_group[:-1], [True]])
        # In the digest a group's A tokens come before its B tokens.
        a_upto, b_first = np.cumsum(np.bincount(a_group)), np.concatenate([[0], np.cumsum(np.bincount(b_group))])
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + b_first[a_group]] = a + len(own.a_bytes) * cut
        b_code = b + len(own.b_bytes) * b_last
        b_code[np.cumsum(n_b) - 1] += len(own.b_bytes)
        code[np.arange(len(b)) + a_upto[b_group]] = b_code + 2 * len(own.a_bytes)
        words = own.words
        upto = np.cumsum(n_a + n_b)
        digests = [hashlib.sha256("".join(map(words.__getitem__, code[s:e].tolist())).encode()).hexdigest() for s, e in zip(upto - n_a - n_b, upto)]
        # Every stretch between two neighbouring ends of either tokenizer is one link.
        stretch = np.flatnonzero(ends[0] | ends[1])
        self.pairs = a[a_before[stretch]] << 32 | b[b_before[stretch]]
        text_ends = a_ends[last]
        self.n_a[self.used], self.n_b[self.used] = n_a, n_b
        self.n_groups[self.used] = np.diff(np.concatenate([[0], a_group[last] + 1]))
        self.n_links[self.used] = np.diff(np.concatenate([[0], np.searchsorted(stretch, text_ends) + 1]))
        for i, d in zip(np.flatnonzero(self.used), digests):
            self.digests[i] = d


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind))


def encoded(docs: DataFrame, key: tuple, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Rows of kind 0: a document with its distinct pairs (places in the chunk's list) and how often each occurs. Rows of kind 1: a part of the chunk's distinct pairs and how often."""
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(*key)
        waiting: list[tuple] = []
        number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, number
            chunk = TaskContext.get().partitionId() << 32 | number
            ids, parts = [d for ds, _ in waiting for d in ds], [x for _, x in waiting]
            pairs, at = np.unique(np.concatenate([x.pairs for x in parts]), return_inverse=True)
            links = np.concatenate([x.n_links for x in parts])
            size = max(1, len(pairs))
            found, times = np.unique(np.repeat(np.arange(len(ids)), links) * size + at.ravel(), return_counts=True)
            per_doc = np.bincount(found // size, minlength=len(ids))
            totals = np.bincount((found % size).astype(np.int64), weights=times, minlength=len(pairs)).astype(np.int64)
            n = len(ids)
            none, empty = pa.nulls(n, pa.list_(pa.int64())), lambda m, t: pa.nulls(m, t)
            numbers = [pa.array(np.concatenate([getattr(x, c) for x in parts]), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            docs_ = [pa.array([chunk] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(ids, pa.int64()), *numbers, pa.array([d for x in parts for d in x.digests]), none, lists(found % size, per_doc, pa.int32()), lists(times, per_doc, pa.int32())]
            whole = pa.Table.from_arrays(docs_, names)
            for i in range(0, n, 256):
                yield from whole.slice(i, 256).combine_chunks().to_batches()
            if len(pairs):
                steps = range(0, len(pairs), 1 << 16)
                sizes = np.array([len(pairs[i : i + (1 << 16)]) for i in steps])
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * m, pa.int64()), pa.array([1] * m, pa.int32()), *[empty(m, pa.int64()) for _ in range(5)], empty(m, pa.string()), lists(pairs, sizes, pa.int64()), empty(m, pa.list_(pa.int32())), lists(totals, sizes, pa.int32())], names)
            waiting, number = [], number + 1

        pending: list[tuple] = []

        def align() -> int:
            nonlocal pending
            waiting.append(([d for d, _ in pending], Aligned(own, [t for _, t in pending])))
            pending = []
            return int(waiting[-1][1].n_links.sum())

        links = size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                pending.append((doc_id, text))
                size += len(text or "") + 16
                if size >= BATCH_BYTES:
                    links, size = links + align(), 0
                    if links >= chunk_links:
                        yield from flush()
                        links = 0
        if pending:
            align()
        if waiting:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def align(docs: DataFrame, a: str, b: str, ranks: tuple[str, str] | None = None, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Return doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text; others are ignored).

    ``a`` is a byte-level BPE file, which encodes a space and the text; ``b`` a sentencepiece model, which adds the space itself. Strings of special
    tokens are plain text. Rows whose text is null or empty, or whose tokens do not join to the space and the text, have no tokens: zeros and an
    empty digest. Rows that repeat an id or a whole row are documents of their own, as are rows without an id; their links count each time. No rows
    give no rows.
    """
    rows = keep(encoded(docs, (a, b, ranks), chunk_links), "alignment", docs.sparkSession)
    own = rows.where("kind = 1").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("n"))
    counts = keep(own.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    highest = counts.groupBy(b_id).agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary
    judged = counts.withColumn("b", b_id).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = own.select(F.col("chunk").alias("of"), "pair").join(judged, "pair")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of a chunk, and corpus counts of its pairs."""
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        sums: dict[str, list] = {"n_best": [], "count_sum": []}
        for at, times in zip(left.column("at"), left.column("times")):
            at, times = at.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            sums["n_best"].append(int((best[at] * times).sum()))
            sums["count_sum"].append(int((n[at] * times).sum()))
        columns = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {k: pa.array(v, pa.int64()) for k, v in sums.items()}
        return pa.table(columns | {"groups_sha256": left.column("groups_sha256")})

    texts = rows.where("kind = 0").drop("kind", "pairs")
    return texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add, OUT)
