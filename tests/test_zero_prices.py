"""Queries on hourly bars against their SQL where closes, and two in a row, are zero."""

import datetime

import pytest

from barline.queries import QUERIES, oracle
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Two users with an event an hour for 60 hours; the first one's price is zero at hours 30, 40 and 41."""
    folder = tmp_path_factory.mktemp("zeros")
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (100 * u + h, start + datetime.timedelta(hours=h, minutes=u), u, "click", 0.0 if u == 1 and h in (30, 40, 41) else 10.0 + (7 * h + u) % 11, f'{{"k": {(13 * h + u) % 100}}}')
        for u in (1, 2) for h in range(60)
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{folder}/events.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view events as select * replace (ts::timestamp as ts) from read_parquet('{folder}/events.parquet/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["class_metrics", "confusion", "entry_expectancy", "hourly_labels", "joint_metrics", "signal_quality"])
def test_zero_close_matches_sql(spark, zeros, name):
    folder, con = zeros
    compare(spark, con, folder, QUERIES[name], oracle()[name])
