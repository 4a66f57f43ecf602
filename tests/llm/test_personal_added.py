"""Loose spellings planted into a table of base matches are found by the votes; words that speak against a span keep it out."""

from pyspark.sql import functions as F

from barline.llm.personal import VOTES, personal_data, reliabilities

FIRST = 10_000_000
NAMES = ["john.doe", "ana_maria", "k.o", "info", "s.lee77", "team-x", "vera", "r.b.c", "x9", "office"]


def planted():
    """(doc_id, text, the loose span or None) of every planted text."""
    good = []
    for i, name in enumerate(NAMES):
        good += [(f"please write to ", f"{name} (at) example (dot) com"), ("my mail is ", f"{name} [at] uni-{i} [dot] org"), ("reach ", f"{name} at host{i} dot net")]
        good += [("call ", f"(555) 12{i}-4567"), ("tel ", f"555-01{i}-9{i}88"), ("our fax ", f"20{i}.555.01{i}9")]
        good += [("server ", f"2001:db8:0:{i}a:1:2:3:f{i}"), ("client ", f"fe80:0:0:0:a{i}b:c:d:{i}")]
    bad = [(f"{word} ", f"555-12{i}-45{i}7") for i in range(10) for word in ("order", "invoice", "serial", "isbn")]
    rows = [(lead + span + " and more", (len(lead), len(lead + span))) for lead, span in good] + [(lead + span + " was shipped", None) for lead, span in bad]
    return [(FIRST + i, text, at) for i, (text, at) in enumerate(rows)]


def recall(out, rows):
    spans = {r.doc_id: {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s} for r in out.where(F.col("doc_id") >= FIRST).collect()}
    hits = [at in spans[d] for d, _, at in rows if at]
    wrong = [d for d, _, at in rows if at is None and spans[d]]
    return sum(hits) / len(hits), len(wrong)


def test_planted_spans_in_a_whole_table(spark):
    rows = planted()
    extra = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(extra)
    found, wrong = recall(personal_data(docs), rows)
    assert found >= 0.9 and wrong == 0
    found, wrong = recall(personal_data(extra), rows)  # without any base match
    assert found >= 0.9 and wrong == 0


def test_a_few_loose_spans_among_many_base_matches(spark):
    rows = [(i, f"mail user{i}@example.com now") for i in range(300)] + [(FIRST, "contact john.doe (at) example (dot) com")]
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "found": F.lit("x"), "kind": F.lit(None), "score": F.lit(0)})
    out = {r.doc_id: r for r in personal_data(clash).collect()}
    assert len(out) == 301 and out[FIRST].n_added == 1 and out[FIRST].spans == "email:8:39"
    assert all(out[i].n_email == 1 and out[i].n_added == 0 for i in range(300))


def test_silence_is_no_vote():
    many = {("email", 1, 1, 0, 1): 100_000}
    quiet = {("email", 0, 1, 1, 1): 1, ("email", 0, -1, -1, -1): 1}
    posterior, chances = reliabilities(many | quiet)
    assert posterior["email", 0, 1, 1, 1] > 0.99 and posterior["email", 0, -1, -1, -1] < 0.01
    assert len(chances["email"]) == len(VOTES) and all(abs(sum(c[v][side] for v in (1, -1)) - 1) < 1e-12 for c in chances["email"] for side in (0, 1))
