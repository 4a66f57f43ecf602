"""Ready factor shapes. Each takes the series of a block as arrays and returns the value that is then ranked per time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barline.plans.arrays import Series, in_arrays

REACH = 64  # the widest shape looks 61 rows back
INPUTS = ("open", "high", "low", "close", "volume")

LIBRARY = {
    "reversal_5": lambda s: s["close"].lag(5) - s["close"],
    "reversal_1": lambda s: -s["ret"],
    "reversal_sum_5": lambda s: -s["ret"].sum(5),
    "momentum_20": lambda s: s["close"] - s["close"].lag(20),
    "momentum_60": lambda s: s["close"].safe_div(s["close"].lag(60)),
    "mean_return_20": lambda s: s["ret"].mean(20),
    "volume_ratio_20": lambda s: s["vr"],
    "price_volume_corr_10": lambda s: -s["close"].corr(s["volume"], 10),
    "volume_price_move_5": lambda s: (s["volume"] - s["volume"].lag(5)) * (s["close"] - s["close"].lag(5)),
    "close_in_range": lambda s: (s["close"] - s["low"]).safe_div(s["high"] - s["low"]),
    "low_volatility_20": lambda s: -s["ret"].std(20),
    "volatility_ratio": lambda s: s["ret"].std(5).safe_div(s["ret"].std(60)),
    "range_position_20": lambda s: (s["close"] - s["low"].min(20)).safe_div(s["high"].max(20) - s["low"].min(20)),
    "vwap_gap": lambda s: s["vwap"] - s["close"],
    "reversal_rank_20": lambda s: -s["close"].percentile(20, 20),
    "decayed_return_10": lambda s: s["ret"].decay(10),
    "return_volume_cov_10": lambda s: -s["ret"].cov(s["vr"], 10),
}


def with_factors(bars: DataFrame, names: Sequence[str] | None = None, horizon: int = 5, digits: int | None = None) -> DataFrame:
    """The bars with ret, vwap, fwd{horizon} and factor columns, the factors rounded to ``digits`` so that ties are the same everywhere."""
    names = list(names or LIBRARY)

    def made(s: dict[str, Series]) -> dict[str, Series]:
        close = s["close"]
        s = s | {"ret": close.ratio(close.lag()) - 1, "vr": s["volume"].safe_div(s["volume"].mean(20))}
        total = s["high"] + s["low"] + close
        s["vwap"] = total.like(total.v / 3)
        values = {n: LIBRARY[n](s) for n in names}
        if digits is not None:
            values = {n: x.round(digits) for n, x in values.items()}
        return values | {"ret": s["ret"], "vwap": s["vwap"], f"fwd{horizon}": close.lead(horizon).ratio(close) - 1}

    return in_arrays(bars, made, INPUTS, ["ret", "vwap", f"fwd{horizon}", *names], back=REACH, fwd=horizon)
