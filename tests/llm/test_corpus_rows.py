"""Row-wise and grouping operators on odd documents and against brute force."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import licences, secret_scan
from barline.llm.exact_dedup import absorb, digest_log, exact_dedup
from barline.llm.language import language_id
from barline.llm.mixing import leaf_budgets, mix
from barline.llm.personal import personal_data, reliabilities
from barline.llm.queries import FILED, PATH, QUERIES, REVIEWED
from barline.llm.shards import shard_by_bytes
from barline.llm.topk import top_k, whole_numbers
from barline.session import scratch_path
from tests.llm.helpers import base_spans, crc, no_docs, odd_docs, sha

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        t = t or ""
        groups[sha("".join(c for c in t if c not in " \t\n\v\f\r"))].append((-len(t), d is None, d))
    return sorted(((d, min(own)[2], len(own), d == min(own)[2], key) for key, own in groups.items() for _, _, d in own), key=str)


@pytest.mark.parametrize("digest", [None, lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)).cast("string")])
def test_dedup_with_good_and_clashing_digests(spark, digest):
    docs, rows = odd_docs(spark)
    out = exact_dedup(docs) if digest is None else exact_dedup(docs, digest)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_dedup([r[:2] for r in rows])
    assert exact_dedup(no_docs(spark)).count() == 0


def test_dedup_state_goes_on(spark):
    log, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    docs = spark.createDataFrame([(3, "a b"), (2, "ab"), (5, "x")], "doc_id long, text string")
    digest_log(docs).write.parquet(log)
    assert sorted(r["size"] for r in absorb(spark, log, state, files_per_trigger=1).collect()) == [1, 2]
    digest_log(spark.createDataFrame([(1, "a  b"), (4, "y")], "doc_id long, text string")).write.mode("append").parquet(log)
    after = {r.digest: (r.best.n, -r.best.neg_id, r["size"]) for r in absorb(spark, log, state, files_per_trigger=1).collect()}
    assert after == {sha("ab"): (4, 1, 3), sha("x"): (1, 5, 1), sha("y"): (1, 4, 1)}


def test_language_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count() > 100
    assert out.where("NOT score BETWEEN 0 AND 1").count() == 0
    docs, _ = odd_docs(spark)
    assert sorted(r.doc_id for r in language_id(docs).where("lang_pred = 'und'").collect()) == [4, 5, 6, 10]
    assert language_id(docs.where("lang IS NULL")).where("lang_pred <> 'und' OR NOT rejected").count() == 0
    assert language_id(no_docs(spark)).count() == 0


def check_shards(rows, texts, shards, tolerance):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, crc(t)) for d, t in texts)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / shards
    assert max(size.values()) <= mean + tolerance


@pytest.mark.parametrize("sample, ranges", [(16384, 2048), (64, 16)])
def test_shards_are_near_equal(spark, sample, ranges):
    docs, rows = odd_docs(spark)
    check_shards(shard_by_bytes(docs, 16, sample, ranges).collect(), [r[:2] for r in rows], 16, 10**6)
    texts = texts_of(spark)
    largest = max(len((t or "").encode()) for _, t in texts)
    check_shards(shard_by_bytes(spark.createDataFrame(texts, "doc_id long, text string"), 16, sample, ranges).collect(), texts, 16, 2 * largest)
    hot = [(i, "same text") for i in range(3000)] + [(3000 + i, f"text {i}") for i in range(3000)]
    out = shard_by_bytes(spark.createDataFrame(hot, "doc_id long, text string"), 16, sample, ranges).collect()
    check_shards(out, hot, 16, 200)
    assert shard_by_bytes(no_docs(spark)).count() == 0


def test_personal_data_base_spans(spark):
    docs, rows = odd_docs(spark)
    hard = [
        (50, "a@b.c_d@e.fg x@y a.b@-.-.z @@ u@v..w 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 9.9.9"), (51, "4785 3805-9239 1139, 4785380592391139 4 4-4--4 0000 0000 0000"), (52, "+1 (499) 555-6503 +12 ++1 2 3 +1.2-3 4567890123456789 +49-(30)--12345 é+33 1 23 45 67 8"),
        (53, "é" * 5 + "a" * 3000 + " " + "1." * 3000 + "@" + "+1" * 500), (54, "x@y." * 800 + "z"),
    ]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(hard, "doc_id long, text string")).unionByName(spark.createDataFrame(texts_of(spark), "doc_id long, text string"))
    want = Counter((d, sha(base_spans(t))) for d, t in [*[r[:2] for r in rows], *hard, *texts_of(spark)])
    out = personal_data(docs).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in out) == want
    for r in out:
        own = [s.split(":") for s in r.spans.split(",") if s]
        assert Counter(k for k, _, _ in own).total() == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert personal_data(no_docs(spark)).count() == 0


def test_reliabilities_find_the_good_labelers():
    counts = {("email", 1, 1, 0, 1): 90, ("email", -1, -1, 0, 1): 80, ("email", 1, -1, 0, 1): 10, ("email", -1, 1, 0, -1): 5}
    posterior, chances = reliabilities(counts)
    assert posterior["email", 1, 1, 0, 1] > 0.9 > 0.5 > posterior["email", -1, -1, 0, 1]
    assert chances["email"][0][1][1] > chances["email"][3][1][1] - chances["email"][3][1][0]


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        (1, "code\nReleased under the MIT License.", "a/LICENSE"), (2, "plain", "a/b/x"), (3, "Licensed under the Apache License, Version 2.0.", "a/b/c/COPYING"), (4, None, "a/b/c/d/e"), (5, "plain", "z"), (6, "", None),
        (7, "This work is licensed under the GNU General Public License, version 3.", "q/one"), (8, "plain", "q/two"), (2, "plain", "a/b/x"), (9, "the licensed bar", "z/y"),
    ]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("own", F.lit(1)).withColumn("lines", F.lit("x")), "at")
    got = Counter((r.doc_id, r.licence, r.origin, r.licence_dir) for r in out.collect())
    assert got == Counter([(1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "own", None), (4, "Apache-2.0", "inherited", "a/b/c"), (5, None, "none", None), (6, None, "none", None), (7, "GPL-3.0", "own", None), (8, None, "none", None), (9, None, "none", None)])  # the header of q/one is its own
    docs, rows = odd_docs(spark)
    assert licences.scan(docs, FILED).count() == len(rows)
    assert licences.scan(no_docs(spark), FILED).count() == 0


def test_secret_forest_separates_what_was_reviewed(spark):
    out = QUERIES["op1_secrets"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, s) for r in docs.where("text RLIKE 'token = '").collect() for s in (sha(x.split('"')[0]) for x in r.text.split('token = "')[1:])}
    got = out.collect()
    secrets = {(r.doc_id, r.candidate_sha256) for r in got if r.secret}
    assert want and len(want & secrets) >= 0.95 * len(want) and len(secrets - want) <= 0.05 * len(want) + 1
    odd, _ = odd_docs(spark)
    for df in (odd, no_docs(spark)):
        assert all(0 <= r.score <= 1 for r in secret_scan.scan(df, REVIEWED, PATH).collect())


def brute_share(children, budget):
    """Water-filling: children (room, weight)."""
    given, left = [0.0] * len(children), budget
    live = set(range(len(children)))
    while live and left > 1e-9:
        weight = sum(children[i][1] for i in live)
        step = min(left / weight, min((children[i][0] - given[i]) / children[i][1] for i in live))
        for i in live:
            given[i] += step * children[i][1]
        left -= step * weight
        live = {i for i in live if children[i][0] - given[i] > 1e-9}
    return given


def test_budgets_are_redistributed_among_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 20), ("b", "y", 5), ("c", "z", 400)]
    weight = {"a": 1.0, "b": 2.0, "c": 1.0}
    out = leaf_budgets(spark.createDataFrame(leaves, "p string, q string, tokens long"), ["p", "q"], ["CASE p WHEN 'b' THEN 2.0D ELSE 1.0D END", "1.0D"], 700.0, 1)
    top = dict(zip(weight, brute_share([(sum(t for p, _, t in leaves if p == k), w) for k, w in weight.items()], 700.0)))
    want = {}
    for k in weight:
        own = [(p, q, t) for p, q, t in leaves if p == k]
        want |= {(p, q): g for (p, q, _), g in zip(own, brute_share([(t, 1.0) for *_, t in own], top[k]))}
    got = {(r.p, r.q): r.budget for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)
    assert math.isclose(sum(got.values()), 700.0)


def test_mix_of_odd_documents(spark):
    docs, rows = odd_docs(spark)
    out = mix(docs, {"tongue": "lang", "origin": "source"}, ["1.0D", "1.0D"], share=1.0, epochs=1, columns=docs.columns)
    assert out.columns == [*docs.columns, "tongue", "origin", "epoch", "tokens"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, t) for d, t, *_ in rows)  # the whole budget takes every row once
    twice = mix(docs, {"tongue": "lang"}, ["1.0D"], share=2.0, epochs=2).collect()
    assert Counter(r.doc_id for r in twice if r.tokens)[9] == 2
    assert mix(no_docs(spark), {"tongue": "lang"}, ["1.0D"]).count() == 0


def test_rows_without_an_id_are_mixed_by_their_texts(spark):
    rows = [(None, f"{i} b c d e f g h i {i}") for i in range(1000)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")), {"tongue": "lang"}, ["1.0D"], share=0.5, epochs=1, columns=["doc_id", "text"]).collect()
    assert len(out) == 500 and len({r.text for r in out}) == 500


def test_numbers_are_no_letters(spark):
    rows = [(1, "½ 12"), (2, "²"), (3, "Ⅷ 3"), (4, "the ½ of it and all the rest of the words")]
    learn = spark.createDataFrame([(i, "the rest of all the words and it", "en") for i in range(40)] + [(None, f"das ist ein Satz mit Wort {i}", "de") for i in range(40)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id(spark.createDataFrame(rows, "doc_id long, text string"), learn).collect()}
    assert all(out[i] == ("und", 0.0) for i in (1, 2, 3)) and out[4][0] == "en"


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [3e6, 0.0]), (2, [-3e6, 1.0]), (3, [2e6, 5.0]), (4, [1.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", whole_numbers("embedding").alias("q"))
    out = top_k(df, df.where("vec_id = 0"), k=4).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 3145728000000), (3, 2097152000000), (4, 1536 * 1024), (2, -3145728000000)]


def test_long_passages_and_runs_take_linear_time(spark):
    text = "Licensed under the Apache License, Version 2.0. " + " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text + "\nkey = " + "aB3" * 7_000, "a/x")], "doc_id long, text string, at string")
    start = time.monotonic()
    assert licences.terms(F.col("text")) is not None and docs.select(F.size(licences.terms(F.col("text")))).first()[0] > 40_000
    assert docs.select(F.size(secret_scan.transitions("text"))).first()[0] == len(docs.first().text)
    assert time.monotonic() - start < 30


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, []), (500, vectors[7][1]), (501, vectors[7][1]), (7, vectors[7][1]), (600, [0.0] * 6), (None, vectors[7][1]), (700, [1.0, 2.0]), (800, [float("-inf")] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").select("vec_id", whole_numbers("embedding").alias("q"), F.lit(1).alias("score"), F.lit(2).alias("block"))
    out = top_k(df, df.where("vec_id % 100 = 0"), k=5, rows=64, query_rows=3).collect()
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in usable if i % 100 == 0):
        own = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:5]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(own)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    assert top_k(df.limit(0), df.limit(0)).count() == 0
