"""Drawdowns inside named date ranges and the checks made of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.operators import gates

RANGES = {"first": ("2020-01-02", "2020-01-04"), "second": ("2020-02-01", "2020-02-03"), "never": ("2030-01-01", "2030-02-01")}


def rows(spark):
    day = lambda m, d: dt.datetime(2020, m, d)
    calm = [(day(1, 1), -0.5), (day(1, 2), 0.1), (day(1, 3), -0.1), (day(1, 4), -0.1), (day(2, 1), 0.0), (day(2, 2), -0.2)]
    wild = [(day(1, 2), 0.2), (day(1, 3), -0.5), (day(1, 4), 0.9), (day(2, 1), 0.0), (day(2, 2), -0.1), (day(2, 3), 0.3)]  # a drawdown is counted from the first equity of the range on
    made = [(v, t, i, r) for v, own in (("calm", calm), ("wild", wild), ("late", [(day(2, 3), 0.1)])) for i, (t, r) in enumerate(own)]
    return spark.createDataFrame(made + [("out", day(5, 5), 0, -0.9)], "variant string, ts timestamp, pos long, ret double")


def test_drawdowns_start_anew_in_each_range(spark):
    got = {r.variant: r.crisis for r in gates.crisis_drawdowns(rows(spark), RANGES).collect()}
    assert set(got) == {"calm", "wild", "late"} and set(got["late"]) == {"second"}
    assert got["calm"] == {"first": pytest.approx(0.81 - 1), "second": pytest.approx(-0.2)} and got["wild"]["first"] == pytest.approx(-0.5)


def test_a_range_without_rows_on_either_side_fails(spark):
    table = gates.crisis_drawdowns(rows(spark), RANGES)
    base = table.where("variant = 'wild'").select("crisis")
    table = table.withColumn("base_crisis", base.scalar())
    out = gates.gate(table, gates.crisis_checks(["first", "second"]), ["beats_baseline_drawdown_first"])
    got = {r.variant: (r.failed_checks, r.status) for r in out.collect()}
    assert got["calm"] == (["beats_baseline_drawdown_second"], "WATCHLIST")
    assert got["late"] == (["beats_baseline_drawdown_first"], "KILLED") and got["wild"][1] == "KILLED"
    (row,) = table.where("variant = 'calm'").select(F.coalesce(gates.crisis_checks(["never"])["beats_baseline_drawdown_never"], F.lit(False)).alias("ok")).collect()
    assert not row.ok
