"""Row-wise helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def finite(x: Column) -> Column:
    """Infinite and NaN values become null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), None).otherwise(x)


def sanitize(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def log_(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def safe_div(a: Column, b) -> Column:
    """a / b, null where |b| <= 1e-12; a literal zero divisor is rejected when the plan is built."""
    if isinstance(b, (int, float)):
        if abs(b) < 1e-12:
            raise ValueError("division by a zero literal")
        return a / F.lit(float(b))
    return F.when(F.abs(b) > 1e-12, a / b)


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles divide: by zero it is infinite with the sign of ``a``, or NaN where ``a`` is zero too, and never an error."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low), high)


def whole_shares(notional: Column, price: Column) -> Column:
    return F.when(price > 0, F.floor(notional / price)).otherwise(F.lit(0)).cast("bigint")


def choose(x: Column, mapping: dict, default=None) -> Column:
    """Map a small fixed set of values to others."""
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def hash_unit(*parts: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) from the text of the parts; stable under re-partitioning."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def corr_of(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over complete pairs; null where either side is constant."""
    pair = x.isNotNull() & y.isNotNull()
    px, py = F.when(pair, x), F.when(pair, y)
    moves = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when(moves, F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py)))


def beta_of(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x as an aggregate; null where x is constant."""
    pair = x.isNotNull() & y.isNotNull()
    px, py = F.when(pair, x), F.when(pair, y)
    return F.when(F.min(px) < F.max(px), F.try_divide(F.covar_pop(py, px), F.var_pop(px)))
