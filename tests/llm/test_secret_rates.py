"""Rates of findings are counted over all labels, by directory; transitions over the texts as they are written."""

from pyspark.sql import functions as F

from barline.llm import secret_scan
from tests.llm.helpers import sha


def test_directories_tell_findings_apart(spark):
    rows = [(i, f"value {sha(str(i))[:32]} end", ("live" if i % 2 else "mock") + f"/{i}.txt") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string")
    for limit in (200, 20_000):
        out = secret_scan.scan(docs, "CASE WHEN pmod(h, 4) <> 0 THEN path LIKE 'live/%' END", "at", limit=limit).collect()
        assert len(out) > 390 and sum(r.secret == (r.doc_id % 2 == 1) for r in out) >= 0.95 * len(out)


def test_rates_count_all_labels_but_those_of_the_own_text(spark):
    rows = [(h, n, "w", None if h % 5 == 0 else float(h % 3 == 0)) for h in range(200) for n in range(2)]
    out = secret_scan.rated(spark.createDataFrame(rows, "h long, nth long, word string, label double"), "word", 0.25)
    part = dict(spark.range(200).select("id", F.pmod(F.xxhash64("id"), F.lit(secret_scan.FOLDS))).collect())
    for r in out.collect():
        own = [y for h, _, _, y in rows if y is not None and (r.label is None or part[h] != part[r.h])]
        assert abs(r.word_rate - (sum(own) + 5 * 0.25) / (len(own) + 5)) < 1e-9
    assert out.count() == len(rows)


def test_transitions_know_capitals_digits_and_signs(spark):
    docs = spark.createDataFrame([("Aa9-Bb x7 " + "Q" * 60 + "q",), (None,)], "text string")
    table = {r.pair for r in secret_scan.transition_table(secret_scan.written_runs(docs)).collect()}
    assert {"^A", "Aa", "a0", "0-", "-A", "^x", "x0", "AA", "Aq"} <= table
