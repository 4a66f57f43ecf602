"""The exits of a block walked in arrays against the fold over each candidate's next bars, with nulls, NaN and every setting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import trades as tr
from barline.plans.blocks import in_blocks

SCHEMA = "symbol string, pos long, ts timestamp, low double, high double, close double, signal int, block boolean, barred boolean"
SETTINGS = [tr.exit_params(0.03, 0.02), tr.exit_params(0.02, 0.04, time_stop=5, break_even=0.01), tr.exit_params(0.05, 0.04, lock_at=0.015, lock_trail=0.008)]


def odd_bars(spark, n=150):
    import datetime as dt

    rng = np.random.default_rng(9)
    odd = lambda x: None if rng.random() < 0.04 else float("nan") if rng.random() < 0.02 else float(x)
    rows = []
    for s in range(3):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.012, n)))
        for i, c in enumerate(close):
            signal = None if rng.random() < 0.03 else int(rng.random() < 0.85)
            rows.append((f"s{s}", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), odd(c * 0.994), odd(c * 1.006), odd(c), signal, bool(rng.random() < 0.03), bool(rng.random() < 0.1)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mode", ["intrabar", "close"])
@pytest.mark.parametrize("p", SETTINGS)
def test_walk_equals_fold(spark, p, mode):
    bars, bar = odd_bars(spark), F.struct("pos", "low", "high", "close", "signal", "block")
    whole = in_blocks(bars, lambda r, w: r.withColumn("_next", F.collect_list(bar).over(w.rowsBetween(1, 10_000))), block=10_000).where("signal = 1 AND NOT barred")
    mark = F.greatest("high", "close") if mode == "intrabar" else F.col("close")
    start = F.struct(mark.alias("mark"), F.lit(0), F.lit(False), F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")).cast(tr._STATE)
    want = whole.select("symbol", "pos", tr._fold(F.col("_next"), start, F.col("close"), {k: F.lit(v) for k, v in p.items()}, mode).alias("s"))
    want = sorted(str((r.symbol, r.pos, r.s.exit_pos, r.s.exit_price, r.s.reason)) for r in want.collect())
    for horizon, block in ((4, 16), (32, 4096)):
        got = tr.label_exits(bars, p, mode=mode, horizon=horizon, block=block).collect()
        assert sorted(str((r.symbol, r.entry_pos, r.exit_pos, r.exit_price, r.reason)) for r in got) == want


def test_no_frame_of_bars_for_each_row(spark):
    rows = odd_bars(spark)
    walked = tr._walked_exits(rows, SETTINGS[0], ["symbol", "pos", "ts", "close"], ["symbol"], "intrabar", 32, 4096)
    plan = walked._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
