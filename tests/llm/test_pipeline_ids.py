"""Rows without an id and rows that share one: the pipeline drops only rows whose texts are copies."""

import random
from collections import Counter

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by(spark, stage, rows, parts):
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], SCHEMA).repartition(parts)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_copies_by_text_whatever_the_id(spark):
    rows = [
        (None, "red one"), (None, "blue two"), (None, "blue  two"), (None, None), (7, "one text of seven"), (7, "another text of seven"), (3, "one text of  seven"), (7, "another text of seven"), (9, "alone"), (None, "alone"),
    ]
    want = Counter([(None, "red one"), (None, "blue  two"), (None, None), (3, "one text of  seven"), (7, "another text of seven"), (9, "alone")])
    assert kept_by(spark, p.copies, rows, 1) == kept_by(spark, p.copies, rows, 5) == want


def test_near_copies_by_text_whatever_the_id(spark):
    rng = random.Random(2)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = lambda words: " ".join([*words[:118], f"x{rng.randrange(10**6)}", "y"])
    a, b, c = text(), text(), text()
    alone = [" ".join(text()) for _ in range(4)]
    # The second text of 7 is nobody's copy, though its first one is; two near copies without an id leave one of them.
    rows = [(7, near(a)), (7, alone[0]), (3, near(a)), (None, near(a)), (None, alone[1]), (None, alone[2]), (8, near(b)), (8, near(b)), (8, alone[3]), (None, near(c)), (None, near(c))]
    got = kept_by(spark, p.near_copies, rows, 1)
    assert got == kept_by(spark, p.near_copies, rows, 5)
    assert all(got[r] == 1 for r in [(7, alone[0]), (3, rows[2][1]), (None, alone[1]), (None, alone[2]), (8, alone[3])])
    assert sum(got[r] for r in rows[6:8]) == 1 and sum(got[r] for r in rows[9:]) == 1 and got.total() == 7
