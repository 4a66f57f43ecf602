"""IP addresses whose parts are zero, written in any length."""

from collections import Counter

from barline.llm.personal import personal_data
from tests.llm.helpers import base_spans, sha


def test_parts_may_be_zero(spark):
    good = ["10.0.0.1", "0.0.0.0", "000.1.2.3", "192.168.0.1", "127.0.0.1", "255.0.00.000", "0010.020.0255.1", "0" * 2000 + ".1.1.1"]
    bad = ["256.0.0.0", "0.0.0.256", "0300.0.0.1", "0" * 2000 + "999.1.1.1"]
    rows = [(i, f"host {t} up") for i, t in enumerate([*good, *bad])]
    out = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_ip for r in out} == {i: int(i < len(good)) for i in range(len(rows))}
    assert Counter((r.doc_id, r.base_sha256) for r in out) == Counter((i, sha(base_spans(t))) for i, t in rows)
