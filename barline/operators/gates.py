"""Decision tables: named checks over metric rows and the status that follows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators import metrics
from barline.session import cut


def gate(metrics: DataFrame, checks: dict[str, Column], kill_unless: list[str]) -> DataFrame:
    """Evaluate named checks; PROMOTED when all hold, KILLED when one of ``kill_unless`` fails, else WATCHLIST."""
    table = metrics.select("*", F.map_from_arrays(F.array(*[F.lit(n) for n in checks]), F.array(*[F.coalesce(c, F.lit(False)) for c in checks.values()])).alias("checks"))
    failed = F.sort_array(F.map_keys(F.map_filter("checks", lambda _, ok: ~ok)))
    dead = F.lit(False)
    for name in kill_unless:
        dead = dead | ~F.col("checks")[name]
    status = F.when(F.size("failed_checks") == 0, "PROMOTED").when(dead, "KILLED").otherwise("WATCHLIST")
    return table.withColumn("failed_checks", failed).withColumn("status", status)


def sleeve_checks(hurdle: float | Column) -> dict[str, Column]:
    """Checks of a volatility sleeve against its always-short baseline (columns with prefix ``base_``)."""
    c = F.col
    return {
        "mean_sharpe_at_least_1_0": c("mean_sharpe") >= 1.0,
        "profitable_windows_at_least_70pct": c("profitable_fraction") >= 0.70,
        "full_history_worst_dd_within_25pct": F.abs("max_drawdown") <= 0.25,
        "clears_multiple_testing_hurdle": c("mean_sharpe") > hurdle,
        "beats_baseline_sharpe_full_history": c("sharpe") > c("base_sharpe"),
        "beats_baseline_drawdown": c("max_drawdown") > c("base_max_drawdown"),
    }


def crisis_drawdowns(rows: DataFrame, slices: Mapping[str, tuple[str, str]], key: str = "variant") -> DataFrame:
    """key, crisis: the worst drawdown inside each named date range as a map; a range without rows is no entry, a key without any no row."""
    inside = cut(metrics.slice_rows(rows, dict(slices)))
    per = metrics.return_metrics(inside, [key, "slice"])
    return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slice", F.round("max_drawdown", 9)))).alias("crisis"))  # one entry for each range


def crisis_checks(names: Iterable[str], own: str = "crisis", base: str = "base_crisis") -> dict[str, Column]:
    """A check for each range: a smaller drawdown than the baseline's there. It fails where either has no rows in the range."""
    return {f"beats_baseline_drawdown_{n}": F.col(own)[n] > F.col(base)[n] for n in names}


def lag_sensitivity(a: DataFrame, b: DataFrame, key: str = "variant") -> DataFrame:
    """Metrics of the same sleeves at two signal lags side by side."""
    cols = ["total_return", "sharpe", "max_drawdown"]
    left = a.select(key, *[F.col(x).alias(f"{x}_settled") for x in cols])
    right = b.select(key, *[F.col(x).alias(f"{x}_lag1") for x in cols])
    return left.join(right, key)
