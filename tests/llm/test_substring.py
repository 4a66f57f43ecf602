"""Substring deduplication against a brute-force version."""

import hashlib
import random
from collections import Counter

import pytest

from barline.llm import substring
from barline.llm.queries import QUERIES
from barline.llm.substring import dedup_substrings, words_of
from tests.llm.helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows of distinct ids: every window against a set of those before it."""
    seen, out = set(), Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, drop in zip(words, gone) if not drop]
        out[d, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


def rows_of(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def made(seed):
    """Texts of few words, passages shared in part, and repetition inside a text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 50)
            text[rng.randint(0, len(text)) : 0] = passage[a : a + rng.choice([15, 19, 20, 21, 40])]
        if i % 9 == 0:
            text += ["la"] * rng.randint(15, 60)
        if i % 7 == 0:
            text += text[: rng.randint(10, 50)]
        rows.append((i, rng.choice([" ", "  ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize("seed, batch", [(1, 1 << 20), (2, 1 << 20), (3, 200)])
def test_passages_shared_in_part(spark, seed, batch, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_WORDS", batch)
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, at string").repartition(5)
    out = dedup_substrings(docs)
    assert rows_of(out) == brute(rows)
    texts = {d: t.encode().split() for d, t in rows}
    for r in out.collect():  # factors are what they say
        for f in r.factors:
            assert texts[r.doc_id][f.start : f.start + f.length] == texts[f.source_id][f.source_start : f.source_start + f.length]
            assert (f.source_id, f.source_start) < (r.doc_id, f.start) and f.length >= 20


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert rows_of(QUERIES["op13_substring_dedup"](spark, SF)) == want and sum(r[2] for r in want) > 0


def test_odd_documents(spark):
    docs, rows = odd_docs(spark)
    own = {r[:2] for r in rows}
    want = brute(own)
    want[next(k for k in want if k[0] == 7)] += 1  # the repeated row has the same result each time
    assert rows_of(dedup_substrings(docs)) == want
    assert dedup_substrings(no_docs(spark)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (5, "x " + text), (None, text), (None, text), (None, "y " + text)], "doc_id long, text string")
    out = dedup_substrings(docs).collect()
    own = [r for r in out if r.doc_id == 5]
    assert len(out) == 6 and [r.n_removed for r in out if r.doc_id is None] == [30] * 3
    assert sorted((r.n_words, r.n_removed) for r in own) in ([(30, 0), (30, 0), (31, 30)], [(30, 30), (30, 30), (31, 0)])


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 7)
    for text in ["", " ", "a", "abc def  ghi jklmnopqrstuvwxyz\tx ", "x" * 50, "é" * 20 + "  é"]:
        assert [w for ws in words_of(text) for w in ws] == text.encode().split()
