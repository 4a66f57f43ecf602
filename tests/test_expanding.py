"""The expanding quantile over many blocks, with ties and rising values, in a fixed number of passes however many values there are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from barline.plans.ranks import expanding_quantile


@pytest.mark.parametrize("kind", ["ties", "rising"])
def test_blocks_equal_pandas_without_a_pass_per_digit(spark, monkeypatch, kind):
    passes, old = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: passes.append(1) or old(self, *a, **k))
    rng = np.random.default_rng(8)
    x = np.where(rng.random(600) < 0.4, 5.0, rng.integers(0, 12, 600)) if kind == "ties" else np.arange(600) + rng.normal(0, 30, 600)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, x double").repartition(3)
    got = expanding_quantile(rows, "x", 0.9, min_n=20, block=64).orderBy("pos").toPandas()["threshold"]
    want = pd.Series(x).shift(1).expanding(min_periods=20).quantile(0.9)
    np.testing.assert_allclose(got.astype(float), want.to_numpy())
    assert not passes
