"""Rolling values in arrays against the window operators, and bars from sorted prices, with blocks, batches and ranges small enough to be cut."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import factors, ts, xs
from barline.functions.scalar import ratio, safe_div
from barline.operators import bars as ob, labels
from barline.plans.arrays import in_arrays
from barline.plans.blocks import in_blocks

PAIRS = {
    "sum": (lambda w: ts.ts_sum("x", 3, w), lambda s: s["x"].sum(3)),
    "mean": (lambda w: ts.ts_mean("x", 4, w), lambda s: s["x"].mean(4)),
    "std": (lambda w: ts.ts_std("y", 5, w), lambda s: s["y"].std(5)),
    "low": (lambda w: ts.ts_min("y", 5, w), lambda s: s["y"].min(5)),
    "high": (lambda w: ts.ts_max("y", 5, w), lambda s: s["y"].max(5)),
    "cov": (lambda w: ts.ts_cov("x", "y", 4, w), lambda s: s["x"].cov(s["y"], 4)),
    "corr": (lambda w: ts.ts_corr("y", "flat", 4, w), lambda s: s["y"].corr(s["flat"], 4)),
    "decay": (lambda w: ts.decay_linear("x", 4, w), lambda s: s["x"].decay(4)),
    "rank": (lambda w: ts.ts_rank("x", 6, w), lambda s: s["x"].percentile(6, 6)),
    "pct": (lambda w: ts.rolling_percentile("x", 9, w, 4), lambda s: s["x"].percentile(9, 4)),
    "delta": (lambda w: ts.delta("x", 4, w), lambda s: s["x"] - s["x"].lag(4)),
    "next": (lambda w: ratio(F.lead("x", 2).over(w), F.col("x")) - 1, lambda s: s["x"].lead(2).ratio(s["x"]) - 1),
    "some_mean": (lambda w: F.avg("x").over(w.rowsBetween(-4, 0)), lambda s: s["x"].some_mean(5)),
    "some_std": (lambda w: F.stddev_pop("x").over(w.rowsBetween(-4, 0)), lambda s: s["x"].some_std(5)),
    "some_max": (lambda w: F.max("x").over(w.rowsBetween(-4, 0)), lambda s: s["x"].some_max(5)),
    "some_min": (lambda w: F.min("x").over(w.rowsBetween(-4, 0)), lambda s: s["x"].some_min(5)),
    "gap": (lambda w: F.when(F.lag("x").over(w) > 0, F.col("x") / F.lag("x").over(w) - 1).otherwise(0.0), lambda s: s["x"].gap(s["x"].lag())),
    "share": (lambda w: safe_div(F.col("y"), F.col("x")), lambda s: s["y"].safe_div(s["x"])),
}


@pytest.mark.parametrize("block", [5, 64])
def test_arrays_equal_windows(spark, block):
    rng = np.random.default_rng(3)
    parts = [pd.DataFrame({"symbol": s, "pos": range(n), "x": rng.integers(0, 6, n).astype(float), "y": rng.normal(size=n), "flat": np.repeat(np.arange(n // 8 + 1), 8)[:n] % 2.0}) for s, n in (("hot", 300), ("b", 40), ("c", 2))]
    df = spark.createDataFrame(pd.concat(parts)).withColumn("x", F.when(F.hash("symbol", "pos") % 7 != 0, F.col("x"))).repartition(5).cache()
    got = in_arrays(df, lambda s: {n: f(s) for n, (_, f) in PAIRS.items()}, ["x", "y", "flat"], list(PAIRS), back=9, fwd=2, block=block)
    want = in_blocks(df, lambda r, w: r.withColumns({n: f(w) for n, (f, _) in PAIRS.items()}), back=9, fwd=2, block=block)
    got, want = (t.select("symbol", "pos", *PAIRS).toPandas().sort_values(["symbol", "pos"]).reset_index(drop=True) for t in (got, want))
    assert len(got) == 342
    for n in PAIRS:
        assert got[n].notna().sum() > 100, n
        np.testing.assert_allclose(got[n], want[n], rtol=1e-9, atol=1e-12, err_msg=n)


def test_factor_values_need_no_window_frames(spark):
    """A frame evaluated for each row and factor took most of the time."""
    rows = [("a", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), 10.0, 11.0, 9.0, 10.0 + i % 3, 5.0) for i in range(70)]
    plan = factors.with_factors(spark.createDataFrame(rows, "symbol string, pos long, ts timestamp, open double, high double, low double, close double, volume double"))
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 70


def test_bars_of_cut_ranges(spark):
    """One key holds most prices, one bar hundreds of them; prices and volumes are missing, one price is NaN."""
    rng = np.random.default_rng(5)
    n = 900
    key, day = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 9, n)), rng.integers(0, 60, n)
    day[:250], key[:250] = 17, 1
    px = [None if i % 11 == 0 else float("nan") if i == 400 else float(v) for i, v in enumerate(rng.integers(1, 50, n))]
    rows = [(int(k), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(d)), i, p, None if i % 5 == 0 else 1.0) for i, (k, d, p) in enumerate(zip(key, day, px))]
    df = spark.createDataFrame(rows, "key long, at timestamp, n long, px double, volume double").withColumn("ts", F.date_trunc("week", "at")).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ob.numbered_bars(df, ["at", "n"], rows=60).orderBy("key", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = F.struct("at", "n", "px")
    want = df.groupBy("key", "ts").agg(F.min(order)["px"].alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max(order)["px"].alias("close"), F.sum("volume").alias("volume")).orderBy("key", "ts").collect()
    same = lambda row: tuple(str(x) for x in row)
    assert [same(r)[:7] for r in got] == [same(r) for r in want]
    assert [r["pos"] for r in got] == [i for k in sorted(set(key)) for i in range(len({r["ts"] for r in want if r["key"] == k}))]


def test_pairs_of_factors_on_different_rows(spark):
    """Daily rank correlations of factors with own gaps against pandas, in arrays and by ranges."""
    rng = np.random.default_rng(9)
    days, names = 40, ["f", "g", "h"]
    x = pd.DataFrame(rng.integers(0, 6, (days * 12, 3)).astype(float), columns=names)
    x["g"] = x["g"].mask(rng.random(len(x)) < 0.2)
    x["h"] = x["f"] + x["h"]
    x["ts"], x["symbol"] = np.repeat(pd.date_range("2024-01-01", periods=days), 12), np.tile([f"s{i}" for i in range(12)], days)
    df = spark.createDataFrame(x).select("symbol", "ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    want = {}
    for a, b in (("f", "g"), ("f", "h"), ("g", "h")):
        both = x[x[a].notna() & x[b].notna()]
        want[a, b] = np.nanmean([d[a].rank().corr(d[b].rank()) for _, d in both.groupby("ts")])
    for key_rows in (1 << 20, 5):
        got = {(r["a"], r["b"]): r["corr"] for r in xs.factor_corr(df, names, key_rows=key_rows).collect()}
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[p] for p in want], list(want.values()))


def test_scores_of_factors_by_ranges(spark):
    """Times worked out in a task and times that go by ranges give the same scores; one factor is constant, one has gaps."""
    rng = np.random.default_rng(12)
    x = pd.DataFrame({"symbol": [f"s{i % 30}" for i in range(3000)], "ts": np.repeat(pd.date_range("2024-01-01", periods=100), 30), "f": rng.integers(0, 9, 3000) * 1.0, "g": rng.normal(size=3000), "k": 1.0, "fwd": rng.normal(size=3000)})
    df = spark.createDataFrame(x).withColumns({"g": F.when(F.hash("symbol", "ts") % 5 != 0, F.col("g")), "fwd": F.when(F.hash("ts", "symbol") % 9 != 0, F.col("fwd"))}).cache()
    scores = [xs.factor_ic(df, ["f", "g", "k"], "fwd", min_days=0, min_coverage=0.0, key_rows=n).toPandas().sort_values("factor").reset_index(drop=True) for n in (1 << 20, 20)]
    pd.testing.assert_frame_equal(*scores)
    data = df.toPandas()
    both = data[data["g"].notna() & data["fwd"].notna()]
    ics = [d["g"].rank().corr(d["fwd"].rank()) for _, d in both.groupby("ts") if len(d) >= 20]
    got = scores[0].set_index("factor").loc["g"]
    np.testing.assert_allclose(got["rank_ic"], np.mean(ics))
    share = both.assign(p=both.groupby("ts")["g"].rank(pct=True)).pivot(index="ts", columns="symbol", values="p")
    np.testing.assert_allclose(got["turnover"], share.diff().abs().mean(axis=1).mean())


def test_features_need_no_window_frames(spark):
    rows = [("a", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), 11.0, 9.0, 10.0 + i % 3, 5.0) for i in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, pos long, ts timestamp, high double, low double, close double, volume double")
    out = labels.technical_features(bars)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 19


def test_features_after_a_close_of_zero(spark):
    """A return on a zero close is infinite; it used to fail the query."""
    rows = [("a", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), 11.0, 9.0, 0.0 if i == 25 else 10.0, 5.0) for i in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, pos long, ts timestamp, high double, low double, close double, volume double")
    got = {r["pos"]: r for r in labels.technical_features(bars).collect()}
    assert got[26]["ret_1"] == 0.0 and np.isnan(got[26]["vol_5"]) and got[35]["vol_5"] == 0.0 and len(got) == 19
