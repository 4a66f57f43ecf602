"""The walk of a key in a task against pointer doubling, and the number of jobs it takes."""

import numpy as np

from barline.operators.trades import chain_trades


def test_walk_equals_doubling(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", p, None if rng.random() < 0.02 else int(p + rng.integers(1, 9))) for s in range(6) for p in range(0, 40 * s + 3) if rng.random() < 0.6]
    exits = spark.createDataFrame(rows, "symbol string, entry_pos long, exit_pos long").repartition(4).cache()
    group = "test-chain-walk"
    spark.sparkContext.setJobGroup(group, group)
    walked = sorted(chain_trades(exits, cooldown=1, block=16).collect(), key=str)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(walked) > 30 and walked == sorted(chain_trades(exits, cooldown=1, block=16, key_rows=30).collect(), key=str)
    assert jobs < 12  # doubling takes several for each round
