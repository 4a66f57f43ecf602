"""The licence scan against every cosine of every passage, and a walk up each path."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barline.llm import licences
from barline.llm.queries import FILED, QUERIES


def terms(text):
    words = re.findall(r"[^\W_]+(?:[.][0-9]+)*", text.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute(rows):
    """(doc_id, path) -> licence, cosine, origin, directory from rows of (doc_id, path, passages, tag)."""
    shapes = {(name, i): terms(t) for name, own in licences.TEMPLATES.items() for i, t in enumerate(own)}
    sets = {tuple(r.passages) for r in rows if r.passages}
    bags = [terms(p) for own in sets for p in own] + list(shapes.values())
    known = {t for bag in shapes.values() for t in bag}
    df = Counter(t for bag in bags for t in bag if t in known)
    idf = {t: math.log(1 + len(bags) / n) for t, n in df.items()}

    def vector(bag):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items() if t in known}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    templates = {k: vector(bag) for k, bag in shapes.items()}

    def nearest(passages):
        best = []
        for v in map(vector, map(terms, passages)):
            for (name, _), u in templates.items():
                cosine = round(sum(x * u[t] for t, x in v.items() if t in u), 9)
                if cosine > 0:
                    best.append((not (cosine >= licences.THRESHOLD and name not in licences.GENERIC), -cosine, name))
        return min(best, default=(True, 0.0, None))

    judged = {}
    for r in rows:
        _, far, name = nearest(r.passages or [])
        own, cosine = (r.tag, 1.0) if r.tag else (name if -far >= licences.THRESHOLD else None, -far)
        judged[r.doc_id, r.path] = (own, cosine)
    files = {}
    for (_, path), (own, _) in sorted(judged.items(), key=lambda x: (x[0][1], x[1][0] or "")):
        folder, _, name = path.rpartition("/")
        if own and re.match(r"(LICEN[SC]E|COPYING)([._-].*)?$", name.upper()):
            files.setdefault(folder, own)
    out = {}
    for (doc_id, path), (own, cosine) in judged.items():
        folder, origin, where = path, "own" if own else "none", None
        while not own and folder:
            folder = folder.rpartition("/")[0]
            if folder in files:
                own, origin, where = files[folder], "inherited", folder
                break
        out[doc_id, path] = (own, cosine if origin == "own" else None, origin, where)
    return out


@pytest.mark.parametrize("path", [FILED, "concat_ws('/', lang, CASE WHEN doc_id % 3 = 0 THEN 'COPYING' ELSE concat(doc_id, '/x') END)"])
def test_equal_to_all_cosines_and_a_walk_up(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cue = F.col("text").rlike(licences.CUES)
    seen = docs.select("doc_id", F.expr(path).alias("path"), F.when(cue, licences.passages(F.col("text"))).alias("passages"), F.when(cue, licences.tagged(F.col("text"), list(licences.TEMPLATES))).alias("tag")).collect()
    want = brute(seen)
    got = {(r.doc_id, r.path): (r.licence, r.cosine, r.origin, r.licence_dir) for r in licences.scan(docs, path).collect()}
    assert got.keys() == want.keys()
    for key, (licence, cosine, origin, where) in want.items():
        assert got[key][0] == licence and got[key][2:] == (origin, where), key
        assert got[key][1] == pytest.approx(cosine, abs=2e-6) if cosine is not None else got[key][1] is None
    assert Counter(x[2] for x in got.values())["inherited"] > 0


def test_names_of_licence_files(spark):
    rows = [(i, "Released under the MIT License.", f"d{i}/{n}") for i, n in enumerate(["LICENSE", "licence.md", "COPYING.LESSER", "LICENSE-MIT", "licensed.py", "my_LICENSE", "COPYING2"])]
    rows += [(100 + i, "plain", f"d{i}/sub/x") for i in range(7)]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, at string"), "at")
    assert sorted(r.doc_id for r in out.where("origin = 'inherited'").collect()) == [100, 101, 102, 103]


def test_query_returns_every_document(spark):
    out = QUERIES["op6_licences"](spark, "/root/testdata/sf0.001").count()
    assert out == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
