"""Block, rank, as-of and chain plans against pandas, with blocks and groups small enough to be cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import ts
from barline.operators.labels import sector_thresholds
from barline.plans.asof import asof
from barline.plans.blocks import in_blocks, islands, number_rows, running
from barline.plans.chain import reachable
from barline.plans.ranks import average_rank, expanding_quantile, order_statistics, quantiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    parts = []
    for s, n in (("hot", 400), ("b", 60), ("c", 3)):
        x = rng.integers(0, 12, n).astype(float)
        x[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"symbol": s, "pos": range(n), "x": x, "y": rng.normal(size=n)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return rows.repartition(7).cache()


def wide(df, *cols):
    return df.toPandas().sort_values(["symbol", "pos"]).reset_index(drop=True)[["symbol", "pos", *cols]]


def test_number_rows(df, frame):
    got = wide(number_rows(df.drop("pos").join(df.select("symbol", "y", F.col("pos").alias("p")), ["symbol", "y"]), ["symbol"], ["p"], rows=9), "p")
    assert (got["pos"] == got["p"]).all() and len(got) == len(frame)


def test_numbers_in_one_global_order(spark):
    """Many rows of one time, one key with a third of the rows, times of two orders in a week."""
    rng = np.random.default_rng(8)
    keys = np.where(rng.random(900) < 0.34, "hot", [f"k{i % 200}" for i in range(900)])
    rows = pd.DataFrame({"symbol": keys, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 3, 900) * 36, unit="h"), "n": range(900)})
    df = spark.createDataFrame(rows).repartition(5)
    got = number_rows(df, [], ["ts", "symbol", "n"], pos="seq", rows=50).toPandas().sort_values("seq")
    assert got["seq"].tolist() == list(range(900)) and got["n"].tolist() == rows.sort_values(["ts", "symbol", "n"])["n"].tolist()
    own = number_rows(df, ["symbol"], ["ts", "n"], rows=50).toPandas().sort_values(["symbol", "ts", "n"])
    assert own["pos"].tolist() == own.groupby("symbol").cumcount().tolist()
    assert number_rows(df.limit(0), ["symbol"], ["ts"]).count() == 0


@pytest.mark.parametrize("block", [2, 5, 64])
def test_rolling_equals_pandas(df, frame, block):
    fns = {
        "mean": lambda w: ts.ts_mean("y", 6, w), "std": lambda w: ts.ts_std("y", 6, w), "rank": lambda w: ts.ts_rank("x", 6, w),
        "delay": lambda w: ts.delay("y", 4, w), "sum": lambda w: ts.ts_sum("x", 3, w), "corr": lambda w: ts.ts_corr("y", "pos", 6, w),
        "fill": lambda w: ts.ffill("x", 2, w), "pct": lambda w: ts.rolling_percentile("x", 9, w, 4),
    }
    got = wide(in_blocks(df, lambda r, w: r.withColumns({n: f(w) for n, f in fns.items()}), back=8, block=block), *fns)
    g = frame.sort_values(["symbol", "pos"]).groupby("symbol", sort=True)
    roll = lambda c, n, m=None: g[c].rolling(n, min_periods=m)
    want = {
        "mean": roll("y", 6).mean(), "std": roll("y", 6).std(), "rank": roll("x", 6).rank(pct=True), "sum": roll("x", 3).sum(),
        "pct": roll("x", 9, 4).rank(pct=True),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series.to_numpy(), atol=1e-9, err_msg=name)
    np.testing.assert_allclose(got["delay"].astype(float), g["y"].shift(4).to_numpy())
    np.testing.assert_allclose(got["fill"].astype(float), g["x"].ffill(limit=2).to_numpy())
    corr = frame.sort_values(["symbol", "pos"]).groupby("symbol").apply(lambda p: p["y"].rolling(6).corr(p["pos"].astype(float)), include_groups=False)
    np.testing.assert_allclose(got["corr"].astype(float), corr.to_numpy(), atol=1e-9)


def test_no_look_ahead(df):
    """Dropping later rows leaves rolling values unchanged."""
    fns = {"m": lambda w: ts.ts_mean("y", 5, w), "d": lambda w: ts.decay_linear("y", 5, w), "r": lambda w: ts.ts_rank("y", 5, w)}
    run = lambda d: wide(in_blocks(d, lambda r, w: r.withColumns({n: f(w) for n, f in fns.items()}), back=5, block=8), *fns)
    full, cut = run(df), run(df.where("pos < 40"))
    pd.testing.assert_frame_equal(full[full["pos"] < 40].reset_index(drop=True), cut)


@pytest.mark.parametrize("block", [3, 50])
def test_running_equals_pandas(df, frame, block):
    specs = {
        "s": ("sum", F.col("x")), "c": ("count", F.col("x")), "p": ("product", 1 + F.col("y") / 100), "hi": ("max", F.col("x")),
        "lo": ("min", F.col("x")), "last": ("last", F.col("x")), "nxt": ("next", F.col("x")),
    }
    got = wide(running(df, specs, block=block), *specs)
    f = frame.sort_values(["symbol", "pos"])
    g = f.groupby("symbol")
    want = {
        "s": f["x"].fillna(0).groupby(f["symbol"]).cumsum().where(g["x"].transform(lambda v: v.notna().cumsum()) > 0),
        "c": g["x"].transform(lambda v: v.notna().cumsum()), "p": (1 + f["y"] / 100).groupby(f["symbol"]).cumprod(),
        "hi": g["x"].transform(lambda v: v.cummax().ffill()), "lo": g["x"].transform(lambda v: v.cummin().ffill()),
        "last": g["x"].ffill(), "nxt": g["x"].bfill(),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series.to_numpy().astype(float), atol=1e-9, err_msg=name)
    past = wide(running(df, {"s": ("last", F.col("y"))}, block=block, inclusive=False), "s")
    np.testing.assert_allclose(past["s"].astype(float), g["y"].shift(1).to_numpy())


def test_islands(spark):
    flags = [1, 1, 0, 0, 1, 0, 1, 1, 1, 0]
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "symbol string, pos long, f int")
    got = islands(rows, F.col("f"), block=3).orderBy("pos").toPandas()["run_id"].tolist()
    assert got == [1, 1, 2, 2, 3, 4, 5, 5, 5, 6]


@pytest.mark.parametrize("key_rows", [10, 10_000])
def test_ranks_and_quantiles(df, frame, key_rows):
    """The plan that splits large groups and the plain one give the same, pandas-equal, values."""
    got = wide(average_rank(df, ["symbol"], "x", "r", rows=7, key_rows=key_rows), "r")
    want = frame.sort_values(["symbol", "pos"]).groupby("symbol")["x"].rank(pct=True).to_numpy()
    np.testing.assert_allclose(got["r"].astype(float), want)
    q = quantiles(df, ["symbol"], "y", {"a": 0.1, "b": 0.5, "c": 0.99}, rows=7).toPandas().set_index("symbol").sort_index()
    for name, level in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        np.testing.assert_allclose(q[name], frame.groupby("symbol")["y"].quantile(level).to_numpy())
    whole = quantiles(df, [], "y", {"m": 0.3}, rows=7).first()["m"]
    assert whole == pytest.approx(frame["y"].quantile(0.3))


def test_order_statistic(df, frame):
    got = quantiles(df, ["symbol"], "y", {"a": 0.65}, order_stat=True).toPandas().set_index("symbol")["a"]
    for s, part in frame.groupby("symbol"):
        assert got[s] == sorted(part["y"])[int(np.floor(0.65 * (len(part) - 1)))]


def test_expanding_quantile(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 150).astype(float)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, x double").repartition(5)
    got = expanding_quantile(rows, "x", 0.9, min_n=10, fan=3, block=16).orderBy("pos").toPandas()["threshold"]
    want = pd.Series(x).shift(1).expanding(min_periods=10).quantile(0.9)
    np.testing.assert_allclose(got.astype(float), want.to_numpy())


@pytest.mark.parametrize("direction,equal", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof(spark, direction, equal):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "t": rng.integers(0, 50, 60), "i": range(60)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 25), "u": rng.integers(0, 50, 25)}).drop_duplicates()
    right["v"] = range(len(right))
    got = asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["v"], direction, equal)
    got = got.toPandas().sort_values("i")["v"].astype(float).to_numpy()
    want = pd.merge_asof(
        left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", direction=direction, allow_exact_matches=equal
    ).sort_values("i")["v"].to_numpy()
    np.testing.assert_allclose(got, want)


def test_chain(spark):
    nxt = {0: 3, 1: 2, 2: 9, 3: 5, 5: 9, 9: None}
    rows = [("a", n, t) for n, t in nxt.items()] + [("b", 4, None)]
    got = reachable(spark.createDataFrame(rows, "k string, pos long, next_pos long"), ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("a", 3), ("a", 5), ("a", 9), ("b", 4)]


def test_window_below_two_is_rejected():
    with pytest.raises(ValueError):
        ts.check_window(1)


@pytest.mark.parametrize("width", [1e-3, 0.0, 0.3])
def test_order_statistics_by_brackets(spark, width):
    """Brackets that miss the wanted place, that hold it, ties, a NaN, a null and groups of one row; none of the values is sorted as a whole where the bracket holds."""
    rng = np.random.default_rng(8)
    parts = {"a": np.round(rng.normal(size=3000), 2), "b": rng.normal(size=7), "c": np.array([4.0]), "d": np.full(500, -1.5), "e": np.append(rng.normal(size=40), np.nan)}
    rows = [(k, float(v)) for k, x in parts.items() for v in x] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r["k"]: r for r in order_statistics(df, ["k"], "x", {"lo": 0.35, "hi": 0.65, "all": 1.0}, rows=11, width=width).collect()}
    assert sorted(got) == sorted(parts)
    for k, x in parts.items():
        x = np.sort(x)
        want = [x[int(np.floor(q * (len(x) - 1)))] for q in (0.35, 0.65, 1.0)]
        np.testing.assert_equal([got[k]["lo"], got[k]["hi"], got[k]["all"], got[k]["n_values"]], [*want, len(x)])


def test_order_statistics_sort_no_whole_key(spark, monkeypatch):
    """A large key needs its bracket alone; before, every value was dealt out and sorted."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    monkeypatch.setattr("barline.plans.ranks.value_positions", lambda *a, **b: pytest.fail("sorted as a whole"))
    x = np.sort(np.arange(20_000) * 7919 % 20_011)
    got = sector_thresholds(df, "x", ["k"], 0.3).first()
    assert (got["lower"], got["upper"]) == (x[int(np.floor(0.35 * 19_999))], x[int(np.floor(0.65 * 19_999))])
