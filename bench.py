"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from barline.queries import QUERIES
from barline.session import local_session

HEADLINE = [
    "ts_mean", "rolling_pct", "cs_rank", "factor_ic", "factor_table", "topn_book", "return_metrics", "exit_labels", "chained_trades",
    "triple_barrier", "tech_features", "asof_pred", "next_bar", "news_bundles", "leaderboard", "param_marginals", "effect_test", "price_moves",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
