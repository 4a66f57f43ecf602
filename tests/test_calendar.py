"""Small calendar and key operators on rows with gaps, nulls and repeats."""

import datetime as dt

from barline.operators import calendar as cal_ops, joins

DAY = dt.date(2024, 3, 4)


def test_reaction_moves_to_a_trading_day(spark):
    open_ = [0, 1, 2, 3, 4, 8, 9]  # a week, a closed Monday, two days
    cal = spark.createDataFrame([(DAY + dt.timedelta(days=k), i) for i, k in enumerate(open_)], "day date, ci long")
    at = lambda day, hour: dt.datetime.combine(DAY, dt.time(hour)) + dt.timedelta(days=day)
    rows = {1: at(0, 15), 2: at(0, 16), 3: at(4, 17), 4: at(7, 9), 5: at(-30, 9), 6: at(9, 18), 7: None}
    out = cal_ops.reaction_trading_day(spark.createDataFrame([*rows.items(), (2, rows[2])], "event_id long, ts timestamp"), cal).collect()
    assert len(out) == 8
    assert {r.event_id: r.reaction and (r.reaction - DAY).days for r in out} == {1: 0, 2: 1, 3: 8, 4: 8, 5: 0, 6: None, 7: None}


def test_scale_volume(spark):
    bars = spark.createDataFrame([("a", 4.0), ("b", None), ("c", 0.0)], "symbol string, volume double")
    assert [r.volume for r in cal_ops.scale_volume(bars, 0.5).orderBy("symbol").collect()] == [2.0, 0.0, 0.0]
    assert cal_ops.scale_volume(bars, 1.0) is bars


def test_keys_in_one_table_only(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (2, None, 0), (None, "y", 0), (3, "z", 0)], "k long, s string, extra int")
    b = spark.createDataFrame([(3, "z", 9), (2, None, 9), (3, "z", 9)], "k long, s string, extra int")
    assert {tuple(r) for r in joins.only_in(a, b, ["k", "s"]).collect()} == {(1, "x"), (None, "y")}
    assert [tuple(r) for r in joins.restrict(a, b, ["k", "s"]).collect()] == [(3, "z", 0)]
