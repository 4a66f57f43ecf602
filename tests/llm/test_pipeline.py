"""The pipeline against brute-force versions of its stages."""

from collections import Counter

import corpus_pipeline as p
from barline.llm.common import keep
from tests.llm.helpers import brute_components, no_docs, odd_docs, sha

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        out = keep(stage(spark, docs, SF), "test-stage")
        before, after = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] if "text" in x.columns else None for x in (docs, out))
        if name != "packing":
            assert out.columns == columns and set(after) <= set(before) and len(after) == len(set(after))
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name == "copies":
            assert Counter(sha("".join(t.split())) for _, t in after) == Counter({sha("".join(t.split())) for _, t in before})
        if name == "near copies":
            assert {d for d, _ in after} == {c for _, _, c in brute_components(before, 5, 80)}
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in before}
        docs = out


def test_run_is_its_stages_one_after_the_other(spark):
    assert p.run(spark, SF).count() > 0


def test_stages_take_odd_and_no_documents(spark):
    odd, _ = odd_docs(spark)
    for docs in (odd, no_docs(spark)):
        for _, stage in p.STAGES:
            docs = keep(stage(spark, docs, SF), "odd-stage")
        assert docs.count() >= 0
