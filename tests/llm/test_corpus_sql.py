"""Queries that SQL can express, against their SQL; results of the others are whole."""

import pytest

from barline.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, connect(SF), SF, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["op4_ngram_join", "op5_personal_data", "op6_licences", "op7_language", "op9_sharding"])
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    want = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(want)
