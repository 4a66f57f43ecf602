"""Exact top-k inner products over a bit-sliced index.

The components of every vector are whole numbers; their upper bits are kept as slices, one bitmap over the rows of a block for each bit of each
component. A query's approximate scores are sums of shifted slices, added with bitmap arithmetic. The k-th largest is found from the most
significant slice of the sum downward; rows that can still reach it, given the bits that were left out, are resolved with exact numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.common import keep

#: Rows of an index block and queries of a query block; low bits left out of the slices.
ROWS, QUERIES, LOW_BITS = 4096, 64, 3
ONE = np.uint64(1)
NONE, ALL = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK = "block long, kind int, part long, ids binary, data binary, width int"


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps (component, bit, word) of the values (row, component) less each component's least one, those least ones, and the number of rows."""
    rows = len(values)
    low = values.min(axis=0)
    shifted = ((values - low) >> LOW_BITS).astype(np.uint64)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    wide = np.uint32 if bits <= 32 else np.uint64
    padded = np.zeros((-(-rows // 64) * 64, values.shape[1]), wide)
    padded[:rows] = shifted
    planes = ((padded.T[:, None, :] >> np.arange(bits, dtype=wide)[None, :, None]) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(planes, axis=-1, bitorder="little")).view(np.uint64), low, rows


def add_shifted(total: np.ndarray, term: np.ndarray, shift: int) -> None:
    """total (bit, query, word) += term (bit, query, word) << shift, with ripple carry; total is wide enough."""
    carry = None
    for i in range(total.shape[0] - shift):
        a = total[shift + i]
        if i < len(term):
            b = term[i]
            if carry is None:
                carry = a & b
                a ^= b
            else:
                x = a ^ b
                spare = (a & b) | (x & carry)
                total[shift + i] = x ^ carry
                carry = spare
        else:
            if carry is None or not carry.any():
                return
            spare = a & carry
            a ^= carry
            carry = spare


def approximate(index: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Slices (bit, query, word) of sum |w| * (x if w > 0 else all ones - x), x the upper bits of the components: never negative."""
    dims, bits, words = index.shape
    size = np.abs(queries)
    width = int(size.sum(axis=1).max(initial=0)).bit_length() + bits + 1
    total = np.zeros((width, len(queries), words), np.uint64)
    flip = np.where(queries < 0, ALL, NONE)
    for d in range(dims):
        plane = index[d][:, None, :] ^ flip[None, :, d, None]
        for shift in range(int(size[:, d].max(initial=0)).bit_length()):
            chosen = np.where((size[:, d] >> shift) & 1, ALL, NONE)
            add_shifted(total, plane & chosen[None, :, None], shift)
    return total


def at_least_kth(total: np.ndarray, live: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Rows (query, word) whose sum is at least the k-th largest sum less the slack; all live rows if there are no more than k."""
    width, queries, _ = total.shape
    above, tied = np.zeros_like(live), live.copy()
    kth = np.zeros(queries, dtype=object)
    for i in range(width - 1, -1, -1):  # from the most significant slice
        inside = tied & total[i]
        enough = (np.bitwise_count(above | inside).sum(axis=1) >= k)[:, None]
        kth = kth + np.where(enough[:, 0], 1 << i, 0).astype(object)
        above = np.where(enough, above, above | inside)
        tied = np.where(enough, inside, tied & ~total[i])
    bound = [max(0, int(t) - int(s)) for t, s in zip(kth, slack)]
    more, same = np.zeros_like(live), live.copy()
    for i in range(width - 1, -1, -1):
        one = np.array([ALL if (b >> i) & 1 else NONE for b in bound], np.uint64)[:, None]
        more |= same & total[i] & ~one
        same &= ~(total[i] ^ one)
    few = (np.bitwise_count(live).sum(axis=1) <= k)[:, None]
    return np.where(few, live, more | same)


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs."""
    if values.size and int(np.abs(values).max()) * int(np.abs(query).max()) * len(query) >= 1 << 63:
        values, query = values.astype(object), query.astype(object)
    return (values @ query).astype(np.int64)  # raises where a Python integer is beyond a long


class Block:
    """An index block: ids and exact numbers of its rows, and the slices over them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.index, self.low, self.rows = slices_of(values)
        full = np.zeros(self.index.shape[2] * 64, np.uint8)
        full[: self.rows] = 1
        self.live = np.packbits(full, bitorder="little").view(np.uint64)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and ids and scores of its k best rows of this block (more if they tie), rows with its own id left out."""
        total = approximate(self.index, queries)
        slack = np.abs(queries).sum(axis=1)  # each component is off by less than one unit of the slices
        found = at_least_kth(total, np.repeat(self.live[None, :], len(ids), axis=0), k + 1, slack)
        for q, own in enumerate(ids):
            rows = np.flatnonzero(np.unpackbits(found[q].view(np.uint8), bitorder="little"))
            rows = rows[self.ids[rows] != own]
            scores = exact_scores(self.values[rows], queries[q])
            if len(rows) > k:
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            yield int(own), self.ids[rows], scores


def whole_numbers(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite, or the vector is empty."""
    numbers = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = (F.size(vector) > 0) & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(usable, numbers)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """Return query_id, rank (from 1), vec_id, score: for each row of ``queries`` its k best rows of ``vectors`` by inner product.

    Both have vec_id and q, an array of whole numbers, or null for rows that take no part; other columns are ignored. Ties go to the smaller vec_id;
    rows with the query's own vec_id are not among its results; rows with a null vec_id or of another length than the query take no part. Rows that
    are equal in vec_id and q are one row; different vectors of one vec_id are rows of their own, and as queries share one list. A query with fewer
    than k candidates has as many ranks. Components lie within 2^61; a score beyond a long is an error. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("q").isNotNull()
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "q").where(usable).dropDuplicates()
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "q").where(usable).dropDuplicates()
    vectors = keep(vectors.withColumn("width", F.size("q")), "bsi-vectors")
    widths = {r.width: r.n for r in vectors.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # vectors of an index have one or few lengths
    blocks = {w: max(1, -(-n // rows)) for w, n in widths.items()}
    per_width = F.create_map(*[F.lit(x) for w, n in blocks.items() for x in (w, n)]) if blocks else F.create_map(F.lit(0), F.lit(1))
    queries = queries.withColumn("width", F.size("q")).where(F.col("width").isin(list(blocks)))
    n_queries = queries.count()
    groups = max(1, -(-n_queries // query_rows))

    def packed(kind: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch])
                    block, part, width = (table.column(c)[0].as_py() for c in ("block", "part", "width"))
                    ids = table.column("vec_id").to_numpy().astype(np.int64).tobytes()
                    data = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                    yield pa.RecordBatch.from_pydict({"block": [block], "kind": [kind], "part": [part], "ids": [ids], "data": [data], "width": [width]}, schema=OUT)

        def whole(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches(pack(iter([table.combine_chunks().to_batches()[0]])))

        return whole

    OUT = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("width", pa.int32())])
    place = F.pmod(F.xxhash64("vec_id", "q"), per_width[F.col("width")]).cast("long")
    index = vectors.withColumn("block", place).withColumn("part", F.lit(0).cast("long")).groupBy("width", "block").applyInArrow(packed(0), BLOCK)
    asked = queries.withColumn("block", F.lit(0).cast("long")).withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.lit(groups)).cast("long")).groupBy("width", "part").applyInArrow(packed(1), BLOCK)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (per_width[F.col("width")] - 1).cast("long"))))
    both = index.unionByName(asked.select(*index.columns)).repartition("width", "block").sortWithinPartitions("width", "block", "kind", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block = None
        for batch in batches:
            for r in batch.to_pylist():
                ids, values = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.int64).reshape(-1, r["width"])
                if r["kind"] == 0:
                    key, block = (r["width"], r["block"]), Block(ids, values)
                elif key == (r["width"], r["block"]):  # else the block has no rows
                    found = list(block.search(ids, values, k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64)), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]).astype(np.int64))],
                        ["query_id", "vec_id", "score"],
                    )

    best = both.mapInArrow(search, "query_id long, vec_id long, score long").dropDuplicates()
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
