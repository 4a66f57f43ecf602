"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (domain, language, source, say) carries target weights. Budgets go down the tree; a node that cannot use its share, because its
leaves hold fewer tokens in all allowed epochs, leaves the rest to its siblings, and only what the siblings cannot take is short at the ancestor.
Each leaf then takes a token-prefix of its seeded epochs: whole epochs first, then the start of one more in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.common import WORDS, keep, whole_text

#: Hex digits of the seeded order that are added up first; a leaf with a third of all rows is added up in 16 to this power parts.
DIGITS = 3


def seeded_order(seed: int, epoch: Column | int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]).cast("binary"))


def share_out(nodes: DataFrame, parents: list[str], budget: str, room: str, weight: str, name: str) -> DataFrame:
    """Share each parent's budget among its children by weight; what a child has no room for goes to its siblings.

    Children in order of room for their weight are full as long as the rest of the budget gives them more than they have room for.
    """
    order = Window.partitionBy(*parents).orderBy(F.col(room) / F.col(weight), name) if parents else Window.partitionBy(F.lit(1)).orderBy(F.col(room) / F.col(weight), name)
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.col(budget) - F.coalesce(F.sum(room).over(earlier), F.lit(0))
    weights = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(earlier), F.lit(0.0))
    nodes = nodes.withColumn("_level", rest / weights)  # for a weight of one, if all before are full
    level = F.first(F.when(F.col(room) > F.col("_level") * F.col(weight), F.col("_level")), ignorenulls=True).over(whole)
    given = F.least(F.col(room).cast("double"), F.coalesce(F.col(weight) * level, F.col(room).cast("double")))
    return nodes.withColumn(f"{name}_budget", given).drop("_level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[str], budget: float, epochs: int) -> DataFrame:
    """``leaves`` (levels.., tokens) with ``budget``: what each leaf is to give. weights[i] is SQL over the first i + 1 levels, above zero."""
    leaves = leaves.withColumn("_room", F.col("tokens") * epochs).withColumn("_budget", F.lit(float(budget)))
    for i, (level, weight) in enumerate(zip(levels, weights)):
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("_room").alias("_node_room"), F.first("_budget").alias("_parent")).withColumn("_weight", F.expr(weight))
        shared = share_out(nodes, levels[:i], "_parent", "_node_room", "_weight", level).select(*levels[: i + 1], F.col(f"{level}_budget").alias("_given"))
        leaves = leaves.join(shared, levels[: i + 1]).withColumn("_budget", F.col("_given")).drop("_given")
    return leaves.select(*levels, "tokens", F.col("_budget").alias("budget"))


def mix(docs: DataFrame, levels: dict[str, str], weights: list[str], share: float = 0.5, epochs: int = 2, seed: int = 17, columns: list[str] | None = None) -> DataFrame:
    """Return the chosen rows of ``docs`` (doc_id, text and what the SQL of ``levels`` reads), once for each epoch they are in: ``columns``, levels, epoch, tokens.

    ``share`` is the total budget as a share of all tokens (words between white space). A null value of a level is the node ''. A leaf without
    tokens gives all its rows, in epoch 0: they cost nothing. Rows without words go with the prefix they lie in. A leaf's prefix ends before the
    first row that would exceed its budget. Rows that are equal in doc_id and text are in the order together; rows without an id are told apart by their texts. No rows give no rows.
    """
    spark = docs.sparkSession
    columns = ["doc_id"] if columns is None else columns
    names = list(levels)
    tokens = F.regexp_count(whole_text("text"), F.lit(WORDS)).cast("long")
    own = [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(f"_{n}") for n, c in levels.items()]
    renamed = {f"_{n}": n for n in [*names, "tokens"]}
    counted = [F.col("doc_id").alias("_id"), F.md5(whole_text("text").cast("binary")).alias("_digest"), *own, tokens.alias("_tokens")]
    narrow = keep(docs.select(*counted), "mix-rows").withColumnsRenamed(renamed)
    # Wide rows are read again and not written: they may hold the texts.
    rows = narrow.withColumn("_row", F.struct(F.col("_id").alias("doc_id"))) if columns == ["doc_id"] else docs.select(F.struct(*columns).alias("_row"), *counted).withColumnsRenamed(renamed)
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    leaves = keep(leaf_budgets(leaves, names, weights, total * share, epochs), "mix-budgets")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1)).cast("int")
    leaves = leaves.select(*names, whole.alias("_whole"), F.greatest(F.lit(0), F.floor(F.col("budget") - whole * F.col("tokens") + F.lit(1e-6))).cast("long").alias("_rest"), F.col("tokens").alias("_leaf"))
    full = rows.join(leaves, names).where("_whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)))

    def in_order(own: DataFrame) -> DataFrame:
        own = own.join(leaves, names).where("_rest > 0 AND _leaf > 0").withColumn("epoch", F.col("_whole"))
        return own.withColumn("_order", seeded_order(seed, F.col("epoch"), "_id", "_digest")).withColumn("_bucket", F.substring("_order", 1, DIGITS))

    part = in_order(rows)
    sums = in_order(narrow).groupBy(*names, "_bucket").agg(F.sum("tokens").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*names, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("tokens").over(Window.partitionBy(*names, "_bucket").orderBy("_order", "tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    part = part.withColumn("_inside", inside).join(sums, [*names, "_bucket"]).where(F.col("_before") + F.col("_inside") <= F.col("_rest"))
    wanted = ["_row", *names, "epoch", "tokens"]
    out = full.select(*wanted).unionByName(part.select(*wanted))
    shadow = [n for n in (*names, "epoch", "tokens") if n not in columns]
    return out.select("_row.*", *shadow)
