import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import stats
from barline.operators.metrics import return_metrics


def test_normal_quantile(spark):
    ps = [1e-6, 0.001, 0.02, 0.1, 0.5, 0.77, 0.975, 0.999, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select(stats.normal_quantile(F.col("p")).alias("z")).toPandas()["z"]
    np.testing.assert_allclose(rows, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-7, atol=1e-9)


def test_sharpe_hurdle(spark):
    got = spark.range(1).select(*[c.alias(n) for n, c in stats.sharpe_hurdle(F.lit(14), F.lit(3197)).items()]).first()
    g, nd, n = 0.5772156649, NormalDist(), 14
    error = math.sqrt(252 / 3197)
    want = ((1 - g) * nd.inv_cdf(1 - 1 / n) + g * nd.inv_cdf(1 - 1 / (n * math.e))) * error
    assert got["expected_best"] == pytest.approx(want, rel=1e-7)


def returns(spark, n=160, seed=2):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 0.01, n) * (1 + np.sin(np.arange(n) / 9) ** 2)
    t0 = pd.Timestamp("2020-01-01")
    pdf = pd.DataFrame({"symbol": "a", "pos": range(n), "ts": [t0 + pd.Timedelta(days=i) for i in range(n)], "ret": r})
    return r, spark.createDataFrame(pdf).repartition(3)


def plain_har(r, horizon, lag, min_train, refit):
    """Refit by ordinary least squares on all usable earlier rows."""
    s = pd.Series(r)
    rv = lambda n: (s**2).rolling(n).mean() * 252
    x = pd.concat([rv(1), rv(5), rv(22)], axis=1)
    y = rv(horizon).shift(-horizon)
    out, coef, start = {}, None, 21
    for t in range(start, len(s)):
        rows = [i for i in range(start, t - lag + 1) if i <= t - lag and not np.isnan(y[i])]
        if len(rows) >= min_train and (coef is None or (t - start) % refit == 0):
            coef = np.linalg.lstsq(np.column_stack([np.ones(len(rows)), x.loc[rows]]), y.loc[rows], rcond=None)[0]
        if coef is not None:
            out[t] = max(float(np.r_[1.0, x.loc[t]] @ coef), 1e-6)
    return out


@pytest.mark.parametrize("lag", [1, 10])
def test_har_equals_least_squares(spark, lag):
    r, df = returns(spark)
    got = stats.har_forecast(df, horizon=10, label_lag=lag, min_train=40, refit_every=7).where("forecast IS NOT NULL").toPandas().set_index("pos")["forecast"]
    want = plain_har(r, 10, lag, 40, 7)
    assert sorted(got.index) == sorted(want)
    np.testing.assert_allclose(got.sort_index(), [want[k] for k in sorted(want)], rtol=1e-5)


def test_har_default_does_not_look_ahead(spark):
    _, df = returns(spark)
    kw = {"horizon": 10, "min_train": 40, "refit_every": 7}
    full = stats.har_forecast(df, **kw).where("pos < 120").select("pos", F.round("forecast", 9)).orderBy("pos").collect()
    cut = stats.har_forecast(df.where("pos < 120"), **kw).select("pos", F.round("forecast", 9)).orderBy("pos").collect()
    assert full == cut


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0.5, 1, 300)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, value double")
    run = lambda df: stats.bootstrap_ci(df, [], "value", F.floor(F.col("i") / 50), ["i"], reps=200).first()
    a, b = run(rows), run(rows.repartition(7))
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)
    half = 1.96 * v.std() / math.sqrt(len(v))
    assert a["ci_low"] == pytest.approx(v.mean() - half, abs=0.03) and a["ci_high"] == pytest.approx(v.mean() + half, abs=0.03)


def test_return_metrics_with_total_loss(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("a", 1, -1.0), ("a", 2, 0.2)], "symbol string, pos long, ret double")
    got = return_metrics(rows, ["symbol"]).first()
    assert (got["total_return"], got["cagr"], got["max_drawdown"]) == (-1.0, -1.0, -1.0)
