"""Follow next-pointers from a start row by pointer doubling: log2(length) joins instead of a walk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barline.session import checkpoint_ready


def reachable(nodes: DataFrame, keys: Sequence[str], node: str = "pos", nxt: str = "next_pos") -> DataFrame:
    """Rows (keys, node) met when starting at the smallest node of each key and following ``nxt`` to its end.

    ``nodes`` holds one row per (keys, node); ``nxt`` is larger than ``node`` or null. After round k the set
    holds the first 2^k nodes of each chain and every pointer jumps 2^k nodes, so no task sees a whole key.
    """
    checkpoint_ready(nodes.sparkSession)
    keys = list(keys)
    jump = nodes.select(*keys, node, nxt).where(F.col(nxt).isNotNull()).checkpoint()
    reached = nodes.groupBy(*keys).agg(F.min(node).alias(node)).checkpoint()
    while True:
        fresh = reached.join(jump, [*keys, node]).select(*keys, F.col(nxt).alias(node)).checkpoint()
        if fresh.isEmpty():
            return reached
        reached = reached.unionByName(fresh).checkpoint()
        far = jump.select(*keys, F.col(node).alias(nxt), F.col(nxt).alias("_far"))
        jump = (
            jump.join(far, [*keys, nxt])
            .select(*keys, node, F.col("_far").alias(nxt))
            .checkpoint()
        )
