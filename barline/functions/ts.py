"""Per-symbol rolling operators. Each takes columns and the ordered window of ``in_blocks``.

A rolling value is null until ``n`` non-null rows are in the frame. Windows below 2 are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barline.functions.scalar import ratio


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def check_window(n: int) -> int:
    if int(n) != n or n < 2:
        raise ValueError(f"window must be an integer >= 2, got {n}")
    return int(n)


def _frame(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def _full(agg, x: Column, w, n: int) -> Column:
    f = _frame(w, check_window(n))
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def ts_mean(x, n: int, w) -> Column:
    return _full(F.avg, _col(x), w, n)


def ts_std(x, n: int, w) -> Column:
    return _full(F.stddev_samp, _col(x), w, n)


def ts_min(x, n: int, w) -> Column:
    return _full(F.min, _col(x), w, n)


def ts_max(x, n: int, w) -> Column:
    return _full(F.max, _col(x), w, n)


def ts_sum(x, n: int, w) -> Column:
    return _full(F.sum, _col(x), w, n)


def _tie_rank(frame: Column, x: Column) -> Column:
    """Share-of-frame rank of ``x``; equal values share the mean of their ranks."""
    less = F.size(F.filter(frame, lambda v: v < x))
    same = F.size(F.filter(frame, lambda v: v == x))
    return (less + (same + 1) / 2) / F.size(frame)


def ts_rank(x, n: int, w) -> Column:
    return rolling_percentile(x, n, w, min_periods=n)


def rolling_percentile(x, n: int, w, min_periods: int | None = None) -> Column:
    """Percentile rank of the last value among the non-null values of the frame."""
    x = _col(x)
    need = max(60, n // 4) if min_periods is None else min_periods
    frame = F.collect_list(x).over(_frame(w, check_window(n)))
    return F.when(x.isNotNull() & (F.size(frame) >= need), _tie_rank(frame, x))


def delay(x, n: int, w) -> Column:
    return F.lag(_col(x), check_window(n)).over(w)


def delta(x, n: int, w) -> Column:
    x = _col(x)
    return x - F.lag(x, check_window(n)).over(w)


def decay_linear(x, n: int, w) -> Column:
    """Weighted mean with weights n, n-1, .. 1 on the current and earlier rows."""
    x = _col(x)
    total = n * (n + 1) / 2
    out = x * F.lit(check_window(n) / total)
    for back in range(1, n):
        out = out + F.lag(x, back).over(w) * F.lit((n - back) / total)
    return out


def _both(agg, x: Column, y: Column, w, n: int) -> Column:
    f = _frame(w, check_window(n))
    pair = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return F.when(F.count(pair).over(f) == n, agg(x, y).over(f))


def ts_corr(x, y, n: int, w) -> Column:
    """Rolling correlation; null where either side does not move inside the frame."""
    x, y = _col(x), _col(y)
    f = _frame(w, check_window(n))
    moves = (F.min(x).over(f) < F.max(x).over(f)) & (F.min(y).over(f) < F.max(y).over(f))
    spread = F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f)
    return F.when(moves, F.try_divide(_both(F.covar_pop, x, y, w, n), spread))


def ts_cov(x, y, n: int, w) -> Column:
    return _both(F.covar_samp, _col(x), _col(y), w, n)


def ffill(x, limit: int, w) -> Column:
    """Carry the last value forward over at most ``limit`` missing rows."""
    return F.last(_col(x), ignorenulls=True).over(w.rowsBetween(-limit, 0))


def simple_return(x, w, n: int = 1) -> Column:
    x = _col(x)
    return ratio(x, F.lag(x, n).over(w)) - 1


def forward_return(x, h: int, w) -> Column:
    x = _col(x)
    return ratio(F.lead(x, h).over(w), x) - 1


def realized_variance(r, n: int, w, periods: int = 252) -> Column:
    r = _col(r)
    return ts_mean(r * r, n, w) * F.lit(periods)


def crossing(x, level: float, w) -> Column:
    """At or above the level now, below it on the row before."""
    x = _col(x)
    return F.coalesce((x >= level) & (F.lag(x).over(w) < level), F.lit(False))


def mean_partial(x, n: int, w) -> Column:
    """Trailing mean that starts with however many rows there are."""
    return F.avg(_col(x)).over(_frame(w, n))
