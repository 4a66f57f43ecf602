"""Best-fit packing after dominance reduction.

Token lengths are at most one sequence long, so that all pieces of one length are alike: the plan is made on the histogram of lengths, which
has as many entries as a sequence has tokens, whatever the number of documents. The Martello-Toth reduction fixes sets that dominate every
alternative (a piece with its exact complement; a piece nothing fits beside; a piece beside which one other fits, with the largest that fits),
and best-fit in falling order packs the rest. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.common import keep, released

SEQUENCE = 2048
SPECIAL = "<|endoftext|>"
LATIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u017F]*")
#: Rows that are numbered together; the number of buckets follows the number of rows.
BUCKET_ROWS = 50_000


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizer in ``path``.

    ``ranks`` may name the same vocabulary as ranks, with its splitting pattern. Texts in Latin letters, for which both libraries class characters
    alike, are then encoded with it, which takes a fifth of the time; all others, and those with the special token, go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.quick = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.quick and SPECIAL not in text and LATIN.fullmatch(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """One for each Python worker."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def cut_pieces(docs: DataFrame, tokenizer: str, ranks: tuple[str, str] | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Documents end with id 0; longer ones are cut into whole sequences, the first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, ranks)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.ids(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                first = n % sequence or sequence
                bounds = [0, *range(first, n + 1, sequence)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_dominated(counts: dict[int, int], sequence: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Sets that are fixed, as (lengths in a sequence, number of such sequences), and the counts that remain."""
    left, fixed = dict(counts), []
    sizes = sorted(left)

    def take(own: dict[int, int], times: int) -> None:
        fixed.append((own, times))
        for size, n in own.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
                sizes.pop(bisect_left(sizes, size))

    for size in sorted(counts, reverse=True):
        while size in left:
            room, n = sequence - size, left[size]
            least = sizes[0]
            if size == sequence or least > room or sizes == [size] and n == 1:
                take({size: 1}, n)  # nothing fits beside it
            elif room == size and n > 1:
                take({size: 2}, n // 2)  # fills a sequence: no set does better
            elif room != size and room in left:
                take({size: 1, room: 1}, min(n, left[room]))
            else:
                spare = {s: c - (s == size) for s, c in left.items() if s == least or s == sizes[min(1, len(sizes) - 1)] or s == size}
                two = sorted(s for s, c in spare.items() for _ in range(min(2, c)))[:2]
                if len(two) == 2 and sum(two) <= room:
                    break  # more than one other may fit: not decided here
                at = bisect_left(sizes, room + 1) - 1
                best = sizes[at]
                if best == size:
                    if n > 1:
                        take({size: 2}, n // 2)
                    else:
                        at -= 1
                        take({size: 1, sizes[at]: 1} if at >= 0 else {size: 1}, 1)
                else:
                    take({size: 1, best: 1}, min(n, left[best]))
    return fixed, left


def best_fit(counts: dict[int, int], sequence: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit in falling order on counts; sequences with the same content are one entry."""
    free: dict[int, list[tuple[Counter, int]]] = {}
    rooms: list[int] = []

    def put(room: int, own: Counter, times: int) -> None:
        if times:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((own, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                put(sequence, Counter(), -(-n // (sequence // size)))
                at = bisect_left(rooms, size)
            room = rooms[at]
            own, times = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            each = room // size
            full = min(times, n // each)
            put(room - each * size, own + Counter({size: each}), full)
            n -= full * each
            if full < times and n:
                put(room - n * size, own + Counter({size: n}), 1)
                put(room, own, times - full - 1)
                n = 0
            elif full < times:
                put(room, own, times - full)
    return [(dict(own), times) for room in rooms for own, times in free[room] if own]


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, end rank, pieces in each sequence, first sequence, offset in a sequence), by length and rank."""
    fixed, left = reduce_dominated(counts, sequence)
    rows, used, base = [], Counter(), 0
    for own, times in [*fixed, *best_fit(left, sequence)]:
        offset = 0
        for size in sorted(own, reverse=True):
            n = own[size]
            rows.append((size, used[size], used[size] + n * times, n, base, offset))
            used[size] += n * times
            offset += n * size
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Add ``rank``, gapless from 0 within each length. A length with a third of all pieces is numbered in many buckets."""
    buckets = max(1, -(-n // BUCKET_ROWS))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    return pieces.withColumn("own", own).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "bucket")


def pack(docs: DataFrame, tokenizer: str, ranks: tuple[str, str] | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Return doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of ``docs`` (doc_id, text; others are ignored) in its place.

    A null text is empty and has one id, the end. Rows that repeat a doc_id are documents of their own. No rows give no rows. Pieces of one
    length are taken by doc_id within hashed buckets, so that the result does not depend on how the rows are partitioned.
    """
    pieces = keep(cut_pieces(docs, tokenizer, ranks, sequence), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one for each length
    places = plan(counts, sequence)
    total = int(places[:, 2].max(initial=0)) + 1
    starts = places[:, 0] * total + places[:, 1]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = places[np.searchsorted(starts, length * total + rank, "right") - 1]
            nth = rank - at[:, 1]
            sequence_id, offset = at[:, 4] + nth // at[:, 3], at[:, 5] + nth % at[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence_id), pa.array(offset)], [*columns, "sequence_id", "offset"])

    numbered = ranked(pieces, sum(counts.values()))
    return numbered.mapInArrow(released(seat), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
