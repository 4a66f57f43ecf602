"""Book trades whose runs are cut by blocks against a walk from bar to bar."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barline.operators.sleeves import book_trades


def walk(bars):
    out, entry, last = [], None, None
    for _, _, ts, close, signal in bars:
        if signal == 1:
            entry, last = entry or (ts, close), close
        elif entry:
            out.append((*entry, ts, close, last))
            entry = None
    return [*out, (*entry, None, None, last)] if entry else out


def test_runs_over_blocks(spark):
    rng = random.Random(3)
    rows, want = [], []
    for s in range(4):
        on, own = rng.random() < 0.5, []
        for i in range(90 + s):
            on = on if rng.random() < 0.85 else not on
            own.append((f"s{s}", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rng.choice([None, 1.0, 2.0, 3.5]) if not on else float(i + 1), None if not on and rng.random() < 0.2 else int(on)))
        rows += own
        want += [(f"s{s}", *t) for t in walk(own)]
    bars = spark.createDataFrame(rows, "symbol string, pos long, ts timestamp, close double, signal int").repartition(5)
    columns = ["symbol", "entry_ts", "entry_price", "exit_ts", "exit_price", "last_price"]
    # A null signal after a flat one begins another flat run, as a flat bar does.
    for block in (8, 4096):
        got = [tuple(r) for r in book_trades(bars, F.lit(10.0), block=block).select(*columns).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
