"""Whitening against plain linear algebra on exact numbers."""

import math

import numpy as np
import pytest

from barline.llm.whitening import components, whiten
from barline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def check(rows, vectors, k=32):
    """rows of whiten() for (vec_id, vector) in ``vectors``, all usable and of one length."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = {}
    for (i, _), v in zip(vectors, x):
        deviation.setdefault(i, []).append(int(((n * v - s) ** 2).sum()))
    centred = (n * x - s).astype(float) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(k, int((values > 1e-10 * values[0]).sum()))
    assert {r.component for r in rows} == set(range(1, rank + 1)) and {r.n for r in rows} == {n} and len(rows) == n * rank
    for i, want in deviation.items():
        assert sorted(r.deviation for r in rows if r.vec_id == i and r.component == 1) == sorted(want)
    for r in rows:
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(covariance), rel_tol=1e-9)
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and max(error) <= 1e-9
    for c in range(1, rank + 1):  # single eigenvalues: the same numbers but for the sign
        gap = min([abs(values[c - 1] - v) for j, v in enumerate(values) if j != c - 1], default=1.0)
        if gap > 1e-3 * values[0]:
            want = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
            got = {r.vec_id: r.whitened for r in rows if r.component == c}
            own = np.array([got[i] for i, _ in vectors])
            assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-7


def test_whole_table(spark):
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    check(rows, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()])


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=5) * (1 + i % 3)]) for i in range(60)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (70, [0.0] * 5), (71, [300.0, -200.0, 0.0, 1.0, 2.0])]
    bad = [(80, None), (81, []), (82, [1.0, None, 0.0, 0.0, 0.0]), (83, [float("nan")] * 5), (84, [float("inf")] + [0.0] * 4), (85, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, x string, w int")
    check(whiten(df).collect(), good)
    check(whiten(df.repartition(7), k=3).collect(), good, k=3)
    twice = good[:60] + [good[3], good[3]]  # a repeated row counts each time
    rows = whiten(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 62 * 5 and {r.n for r in rows} == {62} and len({(r.vec_id, r.component, r.whitened) for r in rows}) == 60 * 5


def test_large_entries(spark):
    big = [(1, [1e9, 0.5]), (2, [-3e9, 0.25]), (3, [2e9, 1.0])]
    rows = whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=1).collect()
    want = np.array([1e9, -3e9, 2e9]) / np.sqrt(14e18 / 3)
    own = np.array([r.whitened for r in sorted(rows)])
    assert np.abs(np.abs(own) - np.abs(want)).max() < 1e-9
    assert [r.deviation for r in rows] == [None] * 3  # beyond a long


def test_no_spread_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten(spark.createDataFrame(rows, kind)).count() == 0
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in flat) == [(1, 1, 128 * 128, 1.0, 1.0), (2, 1, 128 * 128, 1.0, 1.0)]


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 1.0], [4.0, 3.0, 2.0, 1.0], [1.0], [7.0, 7.0 - 1e-13, 1e-3, 0.0], [2.0] * 40])
def test_components_of_close_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))[0]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, axes = components(matrix, 32)
    assert np.allclose(found, [v for v in values if v][:32], rtol=1e-12, atol=1e-13 * values[0])
    assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12 * values[0]
