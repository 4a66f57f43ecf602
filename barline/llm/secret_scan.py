"""Secret scan: a random forest takes the false positives from candidate strings.

Candidates are long runs of key characters with a digit or mixed case. Their features are length, character transitions (how usual each character
is after the one before it, counted over all documents as they are written), dictionary coverage (how much of the letters are words that the
documents use), and how often labelled findings in the same directory and with the same neighbouring words were secrets, counted over all of them.
The forest learns from a sample of the labelled findings and scores every candidate. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import keep, neighbours, unit, whole_text

#: Bound of the labelled findings that the forest is fitted on, by a seeded sample.
LABELLED = 20_000
#: Occurrences from which a word is in the dictionary; shortest letter run that is looked up.
COMMON, LETTERS = 5, 3
TREES, DEPTH, SEED = 30, 6, 11
#: Parts of the texts. The rates of a labelled finding come from the other parts.
FOLDS = 10
FEATURES = ["length", "digits", "upper", "distinct", "transition", "coverage", "dir_rate", "before_rate", "after_rate"]
#: Keyed strings: what may stand between a name and its value, and runs of key characters. Runs are possessive and texts take linear time.
RUN = r"[A-Za-z0-9_+/=~-]{16,}+"
GAP = r"(?:[^A-Za-z0-9_+/=~-]++|[A-Za-z0-9_+/=~-]{1,15}+(?![A-Za-z0-9_+/=~-]))*+"


def symbol(c: Column) -> Column:
    """Lower-case letters as they are; other letters, digits and signs as one symbol each."""
    return F.when(c.between("a", "z"), c).when(c.between("A", "Z"), F.lit("A")).when(c.between("0", "9"), F.lit("0")).when(c.rlike(r"\p{L}"), F.lit("é")).otherwise(F.lit("-"))


def transitions(word: str) -> Column:
    """Pairs of neighbouring symbols of a word, with ^ in front, each pair a string of two."""
    chars = F.concat(F.array(F.lit("^")), F.transform(F.filter(F.split(word, ""), lambda c: c != ""), symbol))
    return F.element_at(F.transform(F.array(chars), lambda own: neighbours(own, lambda a, b: F.concat(a, b))), 1)  # the symbols are bound once


def findings(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, h, nth, path, candidate, before, after: one row for each candidate of each distinct (doc_id, text)."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.expr(path).cast("string"), F.lit("")).alias("path"), whole_text("text").alias("text"))
    # The text after a candidate is looked at ahead and not consumed, so that a candidate in it is found as well.
    pattern = F.lit(f"(?s)\\G({GAP})({RUN})(?=(.{{0,24}}))")  # \\G: a search that failed once is not begun again further on
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("g"), F.regexp_extract_all(text, pattern, 2).alias("m"), F.regexp_extract_all(text, pattern, 3).alias("a"))
    own = F.transform(zipped, lambda x: F.struct(F.right(x["g"], F.lit(48)).alias("lead"), x["m"].alias("candidate"), x["a"].alias("follow")))
    rows = rows.where(text.rlike(RUN)).select("doc_id", "path", F.xxhash64("text").alias("h"), F.posexplode(own).alias("nth", "x")).select("doc_id", "h", "nth", "path", "x.*")
    rows = rows.where(F.col("candidate").rlike("[0-9]") | (F.col("candidate").rlike("[a-z]") & F.col("candidate").rlike("[A-Za-z][A-Z]")))
    before = F.regexp_extract(F.lower("lead"), r"([\p{L}_]+)[^\p{L}_]*$", 1)
    after = F.regexp_extract(F.lower("follow"), r"^[^\p{L}_]*([\p{L}_]+)", 1)
    return rows.select("doc_id", "h", "nth", "path", "candidate", before.alias("before"), after.alias("after"), "lead", "follow").dropDuplicates(["doc_id", "h", "nth"])


def written_runs(docs: DataFrame) -> DataFrame:
    """run, n: runs of letters, digits and key signs of all texts, as they are written, counted."""
    runs = F.regexp_extract_all(whole_text("text"), F.lit(r"[\p{L}\p{N}_+/=~-]++"), F.lit(0))
    return docs.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def words(written: DataFrame) -> DataFrame:
    """word, n: lower-case letter runs of all texts, counted."""
    runs = F.regexp_extract_all(F.lower("run"), F.lit(rf"\p{{L}}{{{LETTERS},}}+"), F.lit(0))
    return written.select("n", F.explode(runs).alias("word")).groupBy("word").agg(F.sum("n").alias("n"))


def transition_table(written: DataFrame) -> DataFrame:
    """pair, surprise: minus the logarithm of a symbol's chance after the one before it; at most 32 * 31 rows."""
    pairs = written.select("n", F.explode(transitions("run")).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    return pairs.withColumn("first", F.substring("pair", 1, 1)).join(F.broadcast(first), "first").select("pair", (-F.log((F.col("n") + 0.5) / (F.col("total") + 16))).alias("surprise"))


def measured(found: DataFrame, written: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The findings with length, digits, upper, distinct, transition and coverage."""
    key = ["doc_id", "h", "nth"]
    table = keep(transition_table(written), "secret-transitions")
    unseen = 12.0
    pairs = found.select("candidate").distinct().select("candidate", F.explode(transitions("candidate")).alias("pair"))
    surprise = pairs.join(F.broadcast(table), "pair", "left").groupBy("candidate").agg(F.avg(F.coalesce("surprise", F.lit(unseen))).alias("transition"))
    runs = F.regexp_extract_all(F.lower("candidate"), F.lit(rf"\p{{L}}{{{LETTERS},}}+"), F.lit(0))
    parts = found.select("candidate").distinct().select("candidate", F.explode(runs).alias("word"))
    known = parts.join(vocabulary.where(F.col("n") >= COMMON).select("word", F.lit(1).alias("known")), "word", "left").groupBy("candidate").agg(F.sum(F.char_length("word") * F.coalesce("known", F.lit(0))).alias("covered"))
    per_candidate = keep(surprise.join(known, "candidate", "left"), "secret-candidates")
    size = F.char_length("candidate")
    found = found.join(per_candidate, "candidate")
    return found.select(
        *key, "path", "candidate", "before", "after", "lead", "follow", size.cast("double").alias("length"), (F.char_length(F.regexp_replace("candidate", "[^0-9]", "")) / size).alias("digits"),
        (F.char_length(F.regexp_replace("candidate", "[^A-Z]", "")) / size).alias("upper"), (F.size(F.array_distinct(F.split("candidate", ""))) / F.least(size, F.lit(40))).alias("distinct"),
        "transition", (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
    )


def rated(rows: DataFrame, column: str, rate: float) -> DataFrame:
    """``rows`` with ``<column>_rate``: how often labelled findings with this value were secrets, drawn to the mean ``rate``.

    All labelled findings count. For a labelled row those of its own tenth of the texts are left out, and so its own label and those of copies of its
    text; without the single label only, rows of one value would differ by their labels alone, and a tree could read these off.
    """
    part = F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("h"), F.lit(FOLDS))).otherwise(-1 - F.pmod(F.xxhash64("h", "nth"), F.lit(FOLDS)))
    rows = rows.withColumn("part", part)
    counts = keep(rows.where("label IS NOT NULL").groupBy(column, "part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")), "secret-counts")
    total = counts.groupBy(column).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    others = counts.join(total, column).select(column, "part", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_s") - F.col("s")).alias("s"))
    whole = total.select(column, F.explode(F.sequence(F.lit(-FOLDS).cast("long"), F.lit(-1).cast("long"))).alias("part"), F.col("all_n").alias("n"), F.col("all_s").alias("s"))
    rates = keep(others.unionByName(whole).select(column, "part", ((F.col("s") + 5 * rate) / (F.col("n") + 5)).alias(f"{column}_rate")), "secret-rates")
    return rows.join(rates, [column, "part"], "left").withColumn(f"{column}_rate", F.coalesce(f"{column}_rate", F.lit(rate))).drop("part")


def scan(docs: DataFrame, labelled: str, path: str = "''", threshold: float = 0.5, limit: int = LABELLED) -> DataFrame:
    """Return doc_id, nth, path, length, candidate_sha256, score, secret: one row for each candidate of ``docs`` (doc_id, text, columns of ``path``).

    ``labelled`` is SQL over a finding (path, candidate, lead, follow, before, after) for its label: true, false, or null where it has none; in use,
    a look-up of reviewed findings. ``path`` is SQL for a document's path. The forest is fitted on at most about ``limit`` labelled findings, while
    rates are counted over all of them. A text that is null, empty or without candidates gives no rows, as do no documents. Rows that repeat a doc_id and text are one document. If all labels are
    alike or there are none, every score is their mean (0 if there are none).
    """
    found = keep(findings(docs, path), "secret-findings")
    written = keep(written_runs(docs.select("text")), "secret-runs")
    vocabulary = keep(words(written), "secret-words")
    rows = measured(found, written, vocabulary).withColumn("label", F.expr(labelled).cast("double"))
    name = F.substring_index("path", "/", -1)
    rows = keep(rows.withColumn("dir", F.left("path", F.char_length("path") - F.char_length(name))), "secret-measured")
    stats = rows.agg(F.count("label").alias("n"), F.avg("label").alias("rate")).first()
    rate = stats.rate or 0.0
    for column in ("dir", "before", "after"):
        rows = rated(rows, column, rate)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(keep(rows, "secret-features"))
    if 0 < rate < 1:
        own = rows.where(F.col("label").isNotNull() & (unit("h", "nth") <= limit / max(1, stats.n))).select("x", "label")
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(own)
        score = vector_to_array("probability")[1]
        rows = model.transform(rows)
    else:
        score = F.lit(float(rate))
    return rows.select("doc_id", "nth", "path", F.col("length").cast("long").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), score.alias("score"), (score >= threshold).alias("secret"))
