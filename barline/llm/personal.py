"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates are the matches of the base patterns, valid or not, and of looser ones. Four labelers vote on each (for, against, none): the pattern
with its check, a gazetteer, the words in front, and the shape. Votes are counted by pattern of votes, which bounds what the driver sees;
expectation-maximisation estimates how reliable each labeler is for each kind; a logistic regression over votes and features learns from the
posteriors and scores all candidates. Valid base matches stay whatever the score; others are added when it is high. All of it is DataFrame work.

A labeler that says nothing has no part in the likelihood: the base pattern cannot match a loose form, so its silence there is no vote against it.
Reliabilities are learnt on the base matches, valid or not; loose candidates are judged by them at even odds, and weigh as much as the base ones of
their kind in the classifier, since base matches outnumber them by a factor that says nothing about them.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.common import keep, whole_text

KINDS = ["email", "ip", "card", "phone"]
VOTES = ["v_pattern", "v_gazetteer", "v_context", "v_shape"]
FEATURES = ["size", "digits", "groups"]
#: Score from which a candidate that is not a valid base match is added.
THRESHOLD = 0.9
#: Before any vote is counted a labeler is taken to be right in RIGHT of RIGHT + WRONG cases.
RIGHT, WRONG = 9.0, 1.0

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: For each base kind: what cannot begin a match, taken in whole runs, and the match. Quantifiers are possessive, so that long texts take linear time.
BASE = {
    "email": (rf"(?:[^{_LOCAL}]++|[{_LOCAL}]++(?!@[{_HOST}]++\.[{_HOST}]))*+", rf"[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"),
    "ip": (r"(?:[^0-9]++|[0-9]++(?!\.[0-9]++\.[0-9]++\.[0-9]))*+", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[^0-9]++|[0-9](?![ -]?[0-9]))*+", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"(?:[^+]++|\+(?![0-9][ ().0-9-]+[0-9]))*+", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Looser forms of the kinds, of bounded length.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}} ?(?:\(at\)|\[at\]| at ) ?[{_HOST}]{{1,63}} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{{2,10}}(?![A-Za-z])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Texts without this cannot hold a match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
LOOSE_NEEDS = {"email": r"(?:\(dot\)|\[dot\]| dot )", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Gazetteer: top-level domains, calling codes, first digits of card issuers, and words before a span that speak for or against it.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|it|nl|uk|us|eu|ch|at|be|info|biz|dev|example"
CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|62)"
FOR = {"email": "mail|e-mail|email|contact|write|correo|courriel", "ip": "ip|host|server|address|client|from|adresse", "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment", "phone": "phone|tel|call|mobile|fax|telefon|ring|whatsapp"}
AGAINST = "version|release|isbn|order|invoice|serial|sku|build|doi|hash|section"


def found(text: Column, kind: str, gap: str, match: str, base: bool) -> Column:
    """Matches as structs: kind, base, code points before the match since the last one, the last characters there, the match."""
    pattern = F.lit(rf"(?s)\G({gap})({match})")  # \G: a search that failed once is not begun again further on
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("g"), F.regexp_extract_all(text, pattern, 2).alias("m"))
    return F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.char_length(x["g"]).alias("gap"), F.right(x["g"], F.lit(40)).alias("tail"), x["m"].alias("match")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), found: an array of arrays of matches, one for each pattern."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,base:boolean,gap:int,tail:string,match:string>>")
    each = [F.when(text.contains(NEEDS[k]), found(text, k, *BASE[k], True)).otherwise(none) for k in KINDS]
    each += [F.when(text.rlike(LOOSE_NEEDS[k]), found(text, k, ".*?", m, False)).otherwise(none) for k, m in LOOSE.items()]
    return docs.select("doc_id", whole_text("text").alias("text")).select("doc_id", F.xxhash64("text").alias("h"), F.array(*each).alias("found"))


def located(rows: DataFrame) -> DataFrame:
    """One row for each candidate of each distinct (doc_id, h), with start, end and the labelers' votes."""
    each = rows.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.posexplode("found").alias("pattern", "own")).select("doc_id", "h", "pattern", F.posexplode("own").alias("i", "c")).select("doc_id", "h", "pattern", "i", "c.*")
    size = F.char_length("match")
    upto = F.sum(F.col("gap") + size).over(Window.partitionBy("doc_id", "h", "pattern").orderBy("i"))
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.char_length(digits)
    valid = {
        "email": F.lit(True), "ip": F.col("match").rlike(rf"^{PART}(?:\.{PART}){{3}}$"), "card": n.between(12, 19) & F.call_function("luhn_check", F.when(n.between(12, 19), digits).otherwise(F.lit("1"))),
        "phone": n.between(9, 15),
    }
    ok = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in valid.items()])
    tail = F.lower("tail")
    speaks = F.coalesce(*[F.when(F.col("kind") == k, tail.rlike(rf"\b(?:{w})\b[^\n]{{0,12}}$")) for k, w in FOR.items()])
    gazetteer = F.coalesce(
        F.when(F.col("kind") == "email", F.when(F.lower("match").rlike(rf"(?:\.|dot.? ?)(?:{DOMAINS})$"), 1).otherwise(-1)), F.when(F.col("kind") == "phone", F.when(F.col("match").rlike("^" + CALLING), 1).when(F.col("match").startswith("+"), -1).otherwise(0)),
        F.when(F.col("kind") == "card", F.when(digits.rlike(ISSUERS), 1).otherwise(-1)), F.when(F.col("match").rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\.") | (F.col("match").contains(":") & ~F.col("match").rlike("^(?:[23][0-9A-Fa-f]{3}|[Ff][CcDd][0-9A-Fa-f]{2}|[Ff][Ee]80):")), -1).otherwise(1),
    )
    shape = F.coalesce(
        F.when(F.col("kind") == "email", F.when(size.between(6, 64), 1).otherwise(-1)), F.when(F.col("kind") == "phone", F.when(n.between(9, 13), 1).otherwise(-1)),
        F.when(F.col("kind") == "card", F.when(F.col("match").rlike(r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{5})$"), 1).otherwise(-1)), F.when(F.col("match").contains(":"), F.when(F.col("match").rlike("[A-Fa-f]"), 1).otherwise(0)).when(size.between(7, 15), 1).otherwise(0),
    )
    pattern = F.when(F.col("base") & ok, 1).when(F.col("base"), -1).otherwise(0)
    context = F.when(speaks, 1).when(tail.rlike(rf"\b(?:{AGAINST})\b[^\n]{{0,12}}$"), -1).otherwise(0)
    return each.select(
        "doc_id", "h", "kind", "base", "i", (F.col("base") & ok).alias("valid"), (upto - size).alias("start"), upto.alias("end"),
        pattern.alias("v_pattern"), gazetteer.alias("v_gazetteer"), context.alias("v_context"), shape.alias("v_shape"),
        F.least(F.lit(7), F.floor(size / 5)).cast("int").alias("size"), F.round(n * 4 / size).cast("int").alias("digits"), F.least(F.lit(4), F.size(F.split("match", "[ ().@-]+"))).alias("groups"),
    )


def reliabilities(counts: dict[tuple, int], rounds: int = 60) -> tuple[dict[tuple, float], dict[str, list[dict[int, tuple[float, float]]]]]:
    """Posterior of each (kind, votes..), and for each kind and labeler the chances of a vote (given that there is one) under no and yes.

    Learnt on the candidates on which the pattern speaks (base matches), with their own share of true ones. The others are judged by what was learnt,
    at even odds, so that a hundred times as many base matches do not carry a loose span that its own votes do not.
    """
    posterior = {key: 1 / (1 + math.exp(-1.5 * sum(key[1:]))) for key in counts}
    chances: dict[str, list[dict[int, tuple[float, float]]]] = {}
    for _ in range(rounds):
        for kind in {key[0] for key in counts}:
            own = [key for key in counts if key[0] == kind]
            seen = [(key, counts[key], posterior[key]) for key in own if key[1]]
            chances[kind] = [vote_chances([(key[1 + i], n, p) for key, n, p in seen if key[1 + i]]) for i in range(len(VOTES))]
            odds = math.log((sum(n * p for _, n, p in seen) + 1) / (sum(n * (1 - p) for _, n, p in seen) + 1))
            for key in own:
                x = (odds if key[1] else 0.0) + sum(math.log(c[v][1] / c[v][0]) for c, v in zip(chances[kind], key[1:]) if v)
                posterior[key] = 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))
    return posterior, chances


def vote_chances(cast: list[tuple[int, int, float]]) -> dict[int, tuple[float, float]]:
    """Chance of a vote for (1) and against (-1) under no and yes, from (vote, rows, posterior) of the votes that a labeler cast."""
    yes, no = sum(n * p for _, n, p in cast), sum(n * (1 - p) for _, n, p in cast)
    up_yes, up_no = sum(n * p for v, n, p in cast if v == 1), sum(n * (1 - p) for v, n, p in cast if v == 1)
    up = ((up_no + WRONG) / (no + RIGHT + WRONG), (up_yes + RIGHT) / (yes + RIGHT + WRONG))
    return {1: up, -1: (1 - up[0], 1 - up[1])}


def scored(spans: DataFrame) -> DataFrame:
    """``score`` for each combination of kind, base, votes and features that occurs; there is a bounded number of them."""
    spark = spans.sparkSession
    keys = ["kind", "base", *VOTES, *FEATURES]
    combos = keep(spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "pii-combinations")
    counts = {tuple(r[:-1]): r.n for r in combos.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect()}  # at most 4 * 3^4
    posterior, _ = reliabilities(counts)
    if not counts:
        return combos.withColumn("score", F.lit(0.0)).drop("n")
    table = spark.createDataFrame([(*key, p) for key, p in posterior.items()], "kind string, " + ", ".join(f"{v} int" for v in VOTES) + ", p double")
    weight = F.col("n") / F.sum("n").over(Window.partitionBy("kind", "base"))
    rows = combos.withColumn("w", weight).join(F.broadcast(table), ["kind", *VOTES])
    names = [f"is_{k}" for k in KINDS] + [f"{k}_{v}" for k in KINDS for v in VOTES] + FEATURES
    flags = [F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"is_{k}") for k in KINDS]
    flags += [F.when(F.col("kind") == k, F.col(v).cast("double")).otherwise(0.0).alias(f"{k}_{v}") for k in KINDS for v in VOTES]
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(rows.select("*", *flags))
    train = rows.select("x", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), (F.col("w") * F.col("p")).alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("w") * (1 - F.col("p"))).alias("w")))).alias("t")).select("x", "t.y", "t.w")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=100, regParam=1e-4).fit(train)
    return model.transform(rows).select(*keys, vector_to_array("probability")[1].alias("score"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by kind in the order of KINDS."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Return doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs`` (doc_id, text; others are ignored).

    Counts and the digest are of the valid base matches; ``spans`` has these and the added ones, which overlap no base span and no earlier added one.
    Positions are code points, ends exclusive. A null text is empty and has no spans (the digest is that of an empty string). Rows that repeat a
    doc_id are judged by their own texts. No rows give no rows.
    """
    rows = keep(candidates(docs), "pii-candidates")
    spans = keep(located(rows), "pii-spans")
    model = scored(spans)
    judged = spans.join(F.broadcast(model), ["kind", "base", *VOTES, *FEATURES])  # at most 4 * 2 * 3^4 * 8 * 5 * 5 rows
    chosen = judged.where(F.col("valid") | (~F.col("base") & (F.col("score") >= threshold)))
    order = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("valid"), "kind")
    behind = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.min(F.when(F.col("valid"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    chosen = chosen.withColumn("clear", F.col("valid") | ((behind <= F.col("start")) & (ahead.isNull() | (ahead >= F.col("end"))))).where("clear")
    span = F.struct("kind", F.col("start"), F.col("end"))
    per_text = chosen.groupBy("doc_id", "h").agg(F.collect_list(F.when(F.col("valid"), span)).alias("base"), F.collect_list(span).alias("all"))
    per_text = per_text.select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *[of_kind(k).alias(f"n_{k}") for k in KINDS],
        spelled(F.col("base")).alias("base"), spelled(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )
    out = rows.select("doc_id", "h").join(per_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))
