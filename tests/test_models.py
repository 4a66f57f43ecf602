import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barline.functions import xs
from barline.operators import models
from barline.operators.gates import gate


def test_walk_forward_finds_a_signal(spark):
    rng = np.random.default_rng(0)
    n = 90
    parts = []
    for s in ("a", "b"):
        x = rng.normal(size=n)
        parts.append(pd.DataFrame({"symbol": s, "pos": range(n), "ts": pd.date_range("2024-01-01", periods=n), "x": x, "z": rng.normal(size=n), "label": (x + rng.normal(0, 0.5, n) > 0).astype(int)}))
    rows = spark.createDataFrame(pd.concat(parts))
    got = models.walk_forward_fit(rows, ["x", "z"], train=40, step=25).toPandas()
    assert len(got) == 2 * n and (got.loc[got["pos"] < 40, "probability"] == 0.5).all()
    late = got[got["pos"] >= 40]
    assert ((late["probability"] > 0.5) == (late["label"] == 1)).mean() > 0.75
    assert ((got["probability"] >= 0.55) == (got["signal"] == 1)).all()


def test_single_class_fold_is_skipped(spark):
    rows = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1), float(i), 1 if i < 12 else 0) for i in range(20)], "symbol string, pos long, ts timestamp, x double, label int")
    got = models.walk_forward_fit(rows, ["x"], train=5, step=5).toPandas()
    assert (got.loc[got["pos"] < 15, "probability"] == 0.5).all()


def test_accept_and_drop_correlated(spark):
    scores = spark.createDataFrame([("a", 0.03, 0.9, 0.3), ("b", -0.04, -0.8, 0.2), ("c", 0.03, 0.5, 0.3), ("d", 0.03, 0.2, 0.3), ("e", 0.05, 1.0, 0.9)], "factor string, rank_ic double, icir double, turnover double")
    ok = xs.accept(scores)
    assert sorted(r["factor"] for r in ok.collect()) == ["a", "b", "c"]
    corr = spark.createDataFrame([("a", "b", -0.8), ("a", "c", 0.3), ("b", "c", 0.9)], "a string, b string, corr double")
    assert xs.drop_correlated(ok, corr) == ["a", "c"]


def test_gate(spark):
    rows = spark.createDataFrame([("x", 1.2, 0.8), ("y", 0.2, 0.8), ("z", 0.2, 0.1), ("n", None, 0.8)], "name string, sharpe double, share double")
    out = gate(rows, {"sharpe": F.col("sharpe") >= 1, "share": F.col("share") >= 0.7}, ["share"])
    got = {r["name"]: (r["status"], r["failed_checks"]) for r in out.collect()}
    assert got == {"x": ("PROMOTED", []), "y": ("WATCHLIST", ["sharpe"]), "z": ("KILLED", ["share", "sharpe"]), "n": ("WATCHLIST", ["sharpe"])}


def test_factor_scores_equal_pandas(spark):
    """Rank IC, ICIR, turnover and coverage against wide pandas frames, with gaps, ties and a split rank plan."""
    rng = np.random.default_rng(6)
    days, names = pd.date_range("2024-01-01", periods=70), [f"s{i:02d}" for i in range(25)]
    x = pd.DataFrame(rng.integers(0, 9, (70, 25)).astype(float), days, names).mask(rng.random((70, 25)) < 0.05)
    y = pd.DataFrame(rng.normal(size=(70, 25)), days, names) + 0.05 * x.fillna(0)
    y = y.mask(rng.random((70, 25)) < 0.02)
    valid = x.notna() & y.notna()
    rx, ry = x.where(valid).rank(axis=1), y.where(valid).rank(axis=1)
    ic = rx.corrwith(ry, axis=1)[valid.sum(axis=1) >= 20].dropna()
    turnover = x.where(valid).rank(axis=1, pct=True).diff().abs().mean(axis=1).mean()
    long = pd.DataFrame({"x": x.stack(future_stack=True), "fwd": y.stack(future_stack=True)}).reset_index(names=["ts", "symbol"]).assign(factor="f")
    df = spark.createDataFrame(long).select("factor", "symbol", "ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "fwd")])
    got = xs.factor_ic(df, "fwd", lambda c: F.floor(F.unix_date(F.to_date(c)) / 7)).first()
    np.testing.assert_allclose(got["rank_ic"], ic.mean())
    np.testing.assert_allclose(got["icir"], ic.mean() / ic.std(ddof=0) * np.sqrt(252))
    np.testing.assert_allclose(got["turnover"], turnover)
    np.testing.assert_allclose(got["coverage"], valid.sum(axis=1)[valid.sum(axis=1) >= 20].mean() / 25)
    assert got["days"] == len(ic)
