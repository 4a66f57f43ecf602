"""Exit labelling and chaining against a bar-by-bar walk over random bars."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators.trades import chain_trades, exit_params, label_exits


def walk(bars, p, cooldown=0, same_day=False):
    """One position at a time, tested bar by bar; a direct reading of the rules."""
    trades, entry, last_exit, blocked = [], None, None, None
    for i, b in bars.iterrows():
        exited = False
        if entry is not None:
            held += 1
            prior = max(mark, entry[1])
            base = entry[1] * (1 - p["stop_loss"])
            fixed = max(base, entry[1]) if even else base
            stop = max(fixed, prior * (1 - (p["lock_trail"] if locked else p["trailing"])))
            reason = None
            if b.low <= stop:
                reason, price = ("stop_loss" if stop == fixed else "trailing_stop"), stop
            else:
                mark = max(prior, b.high, b.close)
                even = even or b.close >= entry[1] * (1 + p["even_at"])
                locked = locked or b.close >= entry[1] * (1 + p["lock_at"])
                if held >= p["time_stop"]:
                    reason, price = "time_stop", b.close
                elif b.signal == 0:
                    reason, price = "signal_exit", b.close
            if reason:
                trades.append((entry[0], b.pos, round(price, 9), reason))
                entry, last_exit, exited, blocked = None, i, True, b.day
        free = last_exit is None or i > last_exit + cooldown
        if entry is None and b.signal == 1 and not exited and free and not (same_day and blocked == b.day):
            entry, mark, held, even, locked = (b.pos, b.close), max(b.high, b.close), 0, False, False
    if entry is not None:
        trades.append((entry[0], None, None, None))
    return trades


def random_bars(seed, n=140):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.012, n)))
    spread = np.abs(rng.normal(0, 0.006, n))
    on = np.repeat(rng.integers(0, 4, n // 7 + 1) > 0, 7)[:n].astype(int)
    t0 = pd.Timestamp("2024-01-01")
    return pd.DataFrame({
        "symbol": f"s{seed}", "pos": range(n), "ts": [t0 + pd.Timedelta(hours=4 * i) for i in range(n)], "open": close, "close": close,
        "high": close * (1 + spread), "low": close * (1 - spread), "signal": on, "day": [i // 6 for i in range(n)],
    })


SETTINGS = [
    (exit_params(0.03, 0.02), 0, False), (exit_params(0.01, 0.5), 0, False), (exit_params(0.02, 0.03, time_stop=9), 2, False),
    (exit_params(0.03, 0.04, break_even=0.01), 0, False), (exit_params(0.05, 0.04, lock_at=0.015, lock_trail=0.008), 1, False), (exit_params(0.03, 0.02), 0, True),
]


@pytest.mark.parametrize("p,cooldown,same_day", SETTINGS)
def test_chain_equals_walk(spark, p, cooldown, same_day):
    frames = [random_bars(s) for s in range(4)]
    bars = spark.createDataFrame(pd.concat(frames)).repartition(5)
    # A horizon of 4 bars forces several rounds for long trades; blocks of 16 cut every series.
    labels = label_exits(bars, p, horizon=4, block=16).cache()
    days = None
    if same_day:
        last = bars.groupBy("symbol", "day").agg(F.max("pos").alias("day_last"))
        days = bars.join(last, ["symbol", "day"]).select("symbol", F.col("pos").alias("exit_pos"), "day_last")
    taken = chain_trades(labels, cooldown=cooldown, no_same_day=same_day, exit_days=days, block=16)
    got = taken.withColumn("exit_price", F.round("exit_price", 9)).select("symbol", "entry_pos", "exit_pos", "exit_price", "reason").collect()
    for f in frames:
        want = walk(f, p, cooldown, same_day)
        mine = sorted(tuple(r)[1:] for r in got if r["symbol"] == f["symbol"].iloc[0])
        assert mine == [tuple(int(v) if isinstance(v, (np.integer, int)) else v for v in t) for t in want]


def test_sweep_equals_single_runs(spark):
    from barline.operators.joins import with_params

    bars = spark.createDataFrame(random_bars(11))
    grid = [dict(exit_params(s, t, n), pid=i) for i, (s, t, n) in enumerate([(0.03, 0.02, None), (0.01, 0.05, 6)])]
    names = [k for k in grid[0] if k != "pid"]
    both = label_exits(with_params(bars, grid), names, keys=["symbol", "pid"], horizon=5)
    for g in grid:
        p = {k: v for k, v in g.items() if k != "pid"}
        one = label_exits(bars, p).select("entry_pos", "exit_pos", "reason").collect()
        many = both.where(F.col("pid") == g["pid"]).select("entry_pos", "exit_pos", "reason").collect()
        assert sorted(one) == sorted(many)


def test_close_mode_tests_closes_only(spark):
    rows = [("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), c, c, c * 0.5, c, 1) for i, c in enumerate([100.0, 101.0, 99.5, 98.0, 97.0])]
    bars = spark.createDataFrame(rows, "symbol string, pos long, ts timestamp, open double, high double, low double, close double, signal int")
    first = label_exits(bars, exit_params(0.05, 0.02), mode="close").where("entry_pos = 0").first()
    assert (first["exit_pos"], first["exit_price"], first["reason"]) == (3, 98.0, "risk_exit")
