"""Cross-section, element-wise and factor queries (X and E family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import factors, ts, xs
from barline.functions.scalar import log_, safe_div
from barline.operators import books
from barline.plans.blocks import in_blocks, number_rows
from barline.queries import fixtures as fx
from barline.plans.ranks import average_ranks
from barline.queries.registry import query, view
from barline.session import cut, written
from barline.queries.timeseries import _DECAY, _frame, _full, with_returns


def returns(spark, d):
    """Bars with ret, vwap and the forward returns over 1 and 5 bars."""

    def add(rows, w):
        return with_returns(rows, w).withColumns(
            {"fwd1": ts.forward_return("close", 1, w), "fwd5": ts.forward_return("close", 5, w)}
        )

    return in_blocks(fx.bars(spark, d), add, back=1, fwd=5)


def _avg_rank(x: str, keys: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
    )


@query("cs_rank", "bars_r", f"""
SELECT symbol, ts, round(r, 6) AS value FROM (
  SELECT symbol, ts, {_avg_rank('ret', 'ts')} / count(*) OVER (PARTITION BY ts) AS r FROM bars_r WHERE ret IS NOT NULL
  UNION ALL SELECT symbol, ts, NULL FROM bars_r WHERE ret IS NULL)""")
def cs_rank(spark, d):
    out = xs.cs_rank(returns(spark, d), "ret", "value")
    return out.select("symbol", "ts", F.round("value", 6).alias("value"))


@query("cs_zscore", "bars_r", """
SELECT symbol, ts, round(CASE WHEN s > 0 THEN (ret - m) / s END, 6) AS value FROM (
  SELECT symbol, ts, ret, avg(ret) OVER (PARTITION BY ts) AS m, stddev_samp(ret) OVER (PARTITION BY ts) AS s FROM bars_r)""")
def cs_zscore(spark, d):
    out = xs.cs_zscore(returns(spark, d), "ret", "value")
    return out.select("symbol", "ts", F.round("value", 6).alias("value"))


@query("winsorize", "bars_r", """
WITH q AS (SELECT ts, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM bars_r WHERE ret IS NOT NULL GROUP BY ts)
SELECT symbol, ts, round(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END, 6) AS value FROM bars_r LEFT JOIN q USING (ts)""")
def winsorize(spark, d):
    out = xs.winsorize(returns(spark, d), "ret", "value")
    return out.select("symbol", "ts", F.round("value", 6).alias("value"))


@query("elementwise", "bars_r", """
SELECT symbol, ts, round(CASE WHEN ret > 0 THEN ln(ret) END, 6) AS log_ret, round(abs(ret), 6) AS abs_ret,
  sign(ret)::INTEGER AS sign_ret, 1.5::DOUBLE AS const FROM bars_r""")
def elementwise(spark, d):
    return returns(spark, d).select(
        "symbol", "ts", F.round(log_(F.col("ret")), 6).alias("log_ret"), F.round(F.abs("ret"), 6).alias("abs_ret"),
        F.signum("ret").cast("int").alias("sign_ret"), F.lit(1.5).alias("const"),
    )


@query("safe_div", "bars_r", """
SELECT symbol, ts, round(close + 2, 6) AS added, round(close - low, 6) AS taken, round(-1 * ret, 6) AS flipped,
  round(CASE WHEN abs(high - low) > 1e-12 THEN (close - low) / (high - low) END, 6) AS ratio, round(close / 7, 6) AS scaled FROM bars_r""")
def safe_division(spark, d):
    c = F.col
    return returns(spark, d).select(
        "symbol", "ts", F.round(c("close") + 2, 6).alias("added"), F.round(c("close") - c("low"), 6).alias("taken"),
        F.round(-1 * c("ret"), 6).alias("flipped"),
        F.round(safe_div(c("close") - c("low"), c("high") - c("low")), 6).alias("ratio"),
        F.round(safe_div(c("close"), 7.0), 6).alias("scaled"),
    )


@query("market_return", "bars_r", "SELECT ts, round(avg(ret), 6) AS mkt FROM bars_r GROUP BY ts")
def market_return(spark, d):
    return books.market_return(returns(spark, d)).select("ts", F.round("mkt", 6).alias("mkt"))


view("ens", "bars_r", f"""
SELECT symbol, ts, round(avg(CASE f WHEN 'momentum_20' THEN r ELSE -r END), 9) AS x FROM (
  SELECT symbol, ts, f, {_avg_rank('v', 'ts, f')} / count(*) OVER (PARTITION BY ts, f) AS r FROM (
    SELECT symbol, ts, unnest(['momentum_20', 'reversal_5', 'vwap_gap']) AS f,
      unnest([close - lag(close, 20) OVER (PARTITION BY symbol ORDER BY pos), lag(close, 5) OVER (PARTITION BY symbol ORDER BY pos) - close, vwap - close]) AS v
    FROM bars_r) WHERE v IS NOT NULL) GROUP BY symbol, ts HAVING count(*) = 3""")

SIGNS = {"momentum_20": 1.0, "reversal_5": -1.0, "vwap_gap": -1.0}


def factor_values(spark, d, names=None, digits=None):
    """Bars with factor columns and the forward return over five bars."""
    return factors.with_factors(fx.bars(spark, d), names, 5, digits)


@query("rank_ensemble", "ens", "SELECT symbol, ts, round(x, 6) AS ensemble FROM ens")
def rank_ensemble(spark, d):
    out = xs.rank_ensemble(factor_values(spark, d, list(SIGNS)), SIGNS)
    return out.where("ensemble IS NOT NULL").select("symbol", "ts", F.round("ensemble", 6).alias("ensemble"))


view("wcal", "bars", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ci FROM (SELECT DISTINCT ts FROM bars)")


def week_calendar(bars):
    return number_rows(bars.select("ts").distinct(), [], ["ts"], pos="ci")


@query("topn_book", "bars_r ens wcal", """
WITH s AS (SELECT e.symbol, c.ci, e.x FROM ens e JOIN wcal c USING (ts)),
p AS (SELECT ci, symbol FROM (SELECT *, row_number() OVER (PARTITION BY ci ORDER BY x DESC, symbol) AS r, count(*) OVER (PARTITION BY ci) AS n
  FROM s WHERE ci % 5 = 0 AND ci < (SELECT max(ci) FROM wcal)) WHERE r <= 5 AND n >= 5),
g AS (SELECT c.ci, sum(coalesce(b.ret, 0)) / 5.0 AS gross FROM p JOIN wcal c ON c.ci BETWEEN p.ci + 1 AND p.ci + 5
  LEFT JOIN bars_r b ON b.symbol = p.symbol AND b.ts = c.ts GROUP BY c.ci),
t AS (SELECT ci, sum(abs(w)) AS turnover FROM (SELECT ci, symbol, sum(w) AS w FROM (
    SELECT ci, symbol, 0.2::DOUBLE AS w FROM p UNION ALL SELECT ci + 5, symbol, -0.2::DOUBLE FROM p) GROUP BY ci, symbol)
  WHERE ci % 5 = 0 AND ci < (SELECT max(ci) FROM wcal) GROUP BY ci)
SELECT c.ts, round(coalesce(gross, 0), 6) AS gross, round(coalesce(turnover, 0), 6) AS turnover,
  round(coalesce(gross, 0) - coalesce(turnover, 0) * 0.0005::DOUBLE, 6) AS net FROM wcal c LEFT JOIN g USING (ci) LEFT JOIN t USING (ci)""")
def topn_book(spark, d):
    values = cut(factor_values(spark, d, list(SIGNS)))
    scores = xs.rank_ensemble(values, SIGNS).select("symbol", "ts", F.round("ensemble", 9).alias("x"))
    out = books.topn_book(scores, values, week_calendar(values), n=5, every=5, bps=5.0)
    return out.select("ts", *[F.round(c, 6).alias(c) for c in ("gross", "turnover", "net")])


@query("decile_means", "bars_r", """
WITH p AS (SELECT open / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS gap, fwd5 FROM bars_r),
v AS (SELECT * FROM p WHERE gap IS NOT NULL AND fwd5 IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(gap, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM v),
b AS (SELECT greatest(len(list_filter(edges, lambda q: q < gap)) - 1, 0) AS bucket, avg(fwd5) AS mean, count(*) AS n FROM v, e GROUP BY 1)
SELECT bucket::INTEGER AS bucket, round(mean, 6) AS mean, n, (SELECT bool_and(mean >= prev OR prev IS NULL) FROM (SELECT mean, lag(mean) OVER (ORDER BY bucket) AS prev FROM b)) AS monotone,
  round((SELECT arg_max(mean, bucket) - arg_min(mean, bucket) FROM b), 6) AS top_minus_bottom FROM b""")
def decile_means(spark, d):
    gaps = in_blocks(
        fx.bars(spark, d),
        lambda r, w: r.withColumns(
            {"gap": F.col("open") / F.lag("close").over(w) - 1, "fwd5": ts.forward_return("close", 5, w)}
        ),
        back=1,
        fwd=5,
    )
    out = xs.deciles(gaps, "gap", "fwd5")
    return out.select(
        F.col("bucket").cast("int").alias("bucket"), F.round("mean", 6).alias("mean"), "n", "monotone",
        F.round("top_minus_bottom", 6).alias("top_minus_bottom"),
    )


# Factor values in SQL, written independently of the Spark library above.
_P = "OVER (PARTITION BY symbol ORDER BY pos)"
_CORR = (
    f"CASE WHEN min(close) OVER {_frame(10)} < max(close) OVER {_frame(10)} AND min(volume) OVER {_frame(10)} < max(volume) OVER {_frame(10)} "
    f"THEN {_full('corr', 'close', 10, 'volume')} END"
)
_SQL_FACTORS = {
    "reversal_5": f"lag(close, 5) {_P} - close",
    "reversal_1": "-ret",
    "reversal_sum_5": f"-({_full('sum', 'ret', 5)})",
    "momentum_20": f"close - lag(close, 20) {_P}",
    "momentum_60": f"close / lag(close, 60) {_P}",
    "mean_return_20": _full("avg", "ret", 20),
    "volume_ratio_20": "vr",
    "price_volume_corr_10": f"-({_CORR})",
    "volume_price_move_5": f"(volume - lag(volume, 5) {_P}) * (close - lag(close, 5) {_P})",
    "close_in_range": "CASE WHEN high - low > 1e-12 THEN (close - low) / (high - low) END",
    "low_volatility_20": f"-({_full('stddev_samp', 'ret', 20)})",
    "volatility_ratio": f"CASE WHEN ({_full('stddev_samp', 'ret', 60)}) > 1e-12 THEN ({_full('stddev_samp', 'ret', 5)}) / ({_full('stddev_samp', 'ret', 60)}) END",
    "range_position_20": f"CASE WHEN ({_full('max', 'high', 20)}) - ({_full('min', 'low', 20)}) > 1e-12 THEN (close - ({_full('min', 'low', 20)})) / (({_full('max', 'high', 20)}) - ({_full('min', 'low', 20)})) END",
    "vwap_gap": "vwap - close",
    "reversal_rank_20": f"-(CASE WHEN count(close) OVER {_frame(20)} = 20 THEN (len(list_filter(l20, lambda e: e < close)) + (len(list_filter(l20, lambda e: e = close)) + 1) / 2.0) / 20 END)",
    "decayed_return_10": f"(ret * 10 + {_DECAY}) / 55",
    "return_volume_cov_10": f"-({_full('covar_samp', 'ret', 10, 'vr')})",
}
view("bars_v", "bars_r", f"""
SELECT *, CASE WHEN abs(vm) > 1e-12 THEN volume / vm END AS vr FROM (
  SELECT *, {_full('avg', 'volume', 20)} AS vm, list(close) OVER {_frame(20)} AS l20 FROM bars_r)""")
view("fac", "bars_v", "SELECT symbol, ts, fwd5, " + ", ".join(f"{e} AS {n}" for n, e in _SQL_FACTORS.items()) + " FROM bars_v")
view("fac_long", "fac", "SELECT symbol, ts, fwd5, factor, x FROM (FROM fac) UNPIVOT INCLUDE NULLS (x FOR factor IN (" + ", ".join(_SQL_FACTORS) + "))")


@query("factor_library", "fac_long", f"""
SELECT symbol, ts, factor, round({_avg_rank('x', 'factor, ts')} / count(*) OVER (PARTITION BY factor, ts), 4) AS value
FROM (SELECT symbol, ts, factor, round(x, 9) AS x FROM fac_long WHERE x IS NOT NULL)""")
def factor_library(spark, d):
    """Percentile rank per week of every library factor (values rounded so that ties are the same everywhere); shares are positive, so that a floor rounds them."""
    names = list(factors.LIBRARY)
    ranked = average_ranks(rounded_values(spark, d, names), ["ts"], {f"r_{n}": n for n in names})
    values = [F.struct(F.lit(n).alias("factor"), F.col(f"r_{n}").alias("value")) for n in names]
    return ranked.select("symbol", "ts", F.explode(F.array(*values)).alias("v")).where("v.value IS NOT NULL").select("symbol", "ts", "v.factor", (F.floor(F.col("v.value") * 10000.0 + 0.5) / 10000.0).alias("value"))


def rounded_values(spark, d, names):
    """Factor columns, rounded so that ties are the same everywhere."""
    return factor_values(spark, d, names, 9).select("symbol", "ts", "fwd5", *names)


def _ic_sql(source: str, keys: str, min_symbols: int, min_days: int, coverage: float) -> str:
    return f"""
v AS (SELECT * FROM {source} WHERE x IS NOT NULL AND fwd5 IS NOT NULL),
r AS (SELECT {keys}, symbol, ts, {_avg_rank('x', f'{keys}, ts')} AS rx, {_avg_rank('fwd5', f'{keys}, ts')} AS ry, count(*) OVER (PARTITION BY {keys}, ts) AS n FROM v),
i AS (SELECT {keys}, ts, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic, max(n) AS n FROM r GROUP BY {keys}, ts HAVING max(n) >= {min_symbols}),
c AS (SELECT ts, row_number() OVER (ORDER BY ts) AS ci FROM (SELECT DISTINCT ts FROM {source})),
p AS (SELECT {keys}, symbol, ci, rx / n AS p FROM r JOIN c USING (ts)),
t AS (SELECT {keys}, avg(t) AS turnover FROM (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.ci, avg(abs(a.p - b.p)) AS t FROM p a
  JOIN p b ON b.symbol = a.symbol AND b.ci = a.ci - 1 AND {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} GROUP BY ALL) GROUP BY {keys}),
s AS (SELECT {keys}, count(DISTINCT symbol) AS ns FROM {source} GROUP BY {keys}),
m AS (SELECT {keys}, avg(ic) AS rank_ic, stddev_pop(ic) AS sd, avg(CASE WHEN ic > 1e-12 THEN 1.0::DOUBLE WHEN ic <= 1e-12 THEN 0.0::DOUBLE END) AS ic_positive, count(ic) AS days, count(*) AS usable, avg(n) AS n FROM i GROUP BY {keys}),
o AS (SELECT {keys}, rank_ic, CASE WHEN sd > 0 THEN rank_ic / sd * sqrt(252) ELSE 0 END AS icir, ic_positive, coalesce(turnover, 1) AS turnover, n / ns AS coverage, days
  FROM m JOIN s USING ({keys}) LEFT JOIN t USING ({keys}) WHERE usable >= {min_days} AND days >= {min_days} AND n / ns >= {coverage}::DOUBLE)"""


_SCORE_COLS = ("rank_ic", "icir", "ic_positive", "turnover", "coverage")
_SCORE_SQL = ", ".join(f"round({c}, 4) AS {c}" for c in _SCORE_COLS)


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in _SCORE_COLS], "days")


view("one_long", "fac", "SELECT symbol, ts, fwd5, 'reversal_5' AS factor, round(reversal_5, 9) AS x FROM fac")


@query("factor_ic", "one_long", "WITH " + _ic_sql("one_long", "factor", 5, 60, 0.3).lstrip() + f" SELECT factor, {_SCORE_SQL}, days FROM o")
def factor_ic(spark, d):
    """Flagship: weekly rank IC of a five-bar reversal factor against the five-bar forward return."""
    out = xs.factor_ic(rounded_values(spark, d, ["reversal_5"]), ["reversal_5"], "fwd5", min_symbols=5, min_coverage=0.3)
    return _rounded(out, "factor")


view("all_long", "fac_long", "SELECT symbol, ts, fwd5, factor, round(x, 9) AS x FROM fac_long")


@query("factor_table", "all_long", "WITH " + _ic_sql("all_long", "factor", 5, 60, 0.3).lstrip() + f" SELECT factor, {_SCORE_SQL}, days FROM o")
def factor_table(spark, d):
    """Scores of the whole library in one plan."""
    return _rounded(library_scores(spark, d), "factor")


def library_scores(spark, d):
    names = list(factors.LIBRARY)
    return xs.factor_ic(rounded_values(spark, d, names), names, "fwd5", min_symbols=5, min_coverage=0.3)


_ALL_PAIRS = [(a, b) for i, a in enumerate(factors.LIBRARY) for b in list(factors.LIBRARY)[i + 1 :]]
view("pairs", "fac", "SELECT symbol, ts, p.a AS a, p.b AS b, round(p.x, 9) AS x, round(p.y, 9) AS y FROM (SELECT symbol, ts, unnest(["
    + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'x': {a}, 'y': {b}}}" for a, b in _ALL_PAIRS) + "]) AS p FROM fac)")
_CORR_SQL = f"""
pr AS (SELECT a, b, ts, {_avg_rank('x', 'a, b, ts')} AS rx, {_avg_rank('y', 'a, b, ts')} AS ry FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL),
pc AS (SELECT a, b, ts, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS c FROM pr GROUP BY a, b, ts),
fc AS MATERIALIZED (SELECT a, b, round(CASE WHEN count(*) < 30 THEN 0 ELSE coalesce(avg(c), 0) END, 6) AS corr FROM pc GROUP BY a, b)"""


@query("factor_corr", "pairs", "WITH " + _CORR_SQL.lstrip() + " SELECT a, b, corr FROM fc")
def factor_corr(spark, d):
    """Every pair of the library's factors."""
    names = list(factors.LIBRARY)
    return xs.factor_corr(rounded_values(spark, d, names), names).select("a", "b", F.round("corr", 6).alias("corr"))


#: Limits of the acceptance query; looser than the defaults, which no factor of made-up prices passes.
ACCEPT = {"min_ic": 0.005, "min_icir": 0.1, "max_turnover": 0.45}


@query("accepted_factors", "all_long pairs", "WITH " + _ic_sql("all_long", "factor", 5, 60, 0.3).lstrip() + "," + _CORR_SQL + f""",
q AS MATERIALIZED (SELECT factor, row_number() OVER (ORDER BY abs(round(icir, 6)) DESC, factor) AS place, abs(rank_ic) >= {ACCEPT['min_ic']} AND abs(icir) >= {ACCEPT['min_icir']} AND turnover <= {ACCEPT['max_turnover']} AS strong FROM o),
l AS MATERIALIZED (SELECT q.*, coalesce((SELECT list(CASE WHEN a = factor THEN b ELSE a END) FROM fc WHERE abs(corr) > 0.7 AND (a = factor OR b = factor)), []) AS linked FROM q),
w AS (SELECT 0::BIGINT AS place, []::VARCHAR[] AS kept UNION ALL SELECT l.place, CASE WHEN l.strong AND NOT list_has_any(w.kept, l.linked) THEN list_append(w.kept, l.factor) ELSE w.kept END FROM w JOIN l ON l.place = w.place + 1)
SELECT factor, place::INTEGER AS place, strong, list_contains((SELECT kept FROM w ORDER BY place DESC LIMIT 1), factor) AS accepted FROM q""", recursive=True)
def accepted_factors(spark, d):
    """Greedy choice of strong factors that are not correlated with a stronger one."""
    names = list(factors.LIBRARY)
    values = written(rounded_values(spark, d, names), "factors")
    corr = xs.factor_corr(values, names, cheap=True).withColumn("corr", F.round("corr", 6))
    return xs.accepted_factors(xs.factor_ic(values, names, "fwd5", min_symbols=5, min_coverage=0.3, cheap=True), corr, **ACCEPT)


view("period_long", "all_long wcal", """
SELECT a.*, CASE WHEN ci < floor(0.6::DOUBLE * n) THEN 'train' WHEN ci < floor(0.8::DOUBLE * n) THEN 'validation' ELSE 'test' END AS period
FROM all_long a JOIN wcal USING (ts), (SELECT count(*) AS n FROM wcal)""")


@query("ic_decay", "period_long", "WITH " + _ic_sql("period_long", "factor, period", 5, 20, 0.0).lstrip() + """,
w AS (SELECT factor, max(rank_ic) FILTER (period = 'validation') AS v, max(rank_ic) FILTER (period = 'test') AS t FROM o GROUP BY factor)
SELECT count(*) AS factors, round(avg(v), 6) AS mean_validation_ic, round(avg(t), 6) AS mean_test_ic, round(median(t), 6) AS median_test_ic,
  round((avg(v) - avg(t)) / avg(v), 4) AS decay, (avg(v) - avg(t)) / avg(v) > 0.5 AS killed, round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END), 4) AS test_positive
FROM w WHERE v IS NOT NULL AND t IS NOT NULL""")
def ic_decay(spark, d):
    """How much of the validation IC is left in the test period, over the whole library."""
    from barline.operators.labels import period_of

    names = list(factors.LIBRARY)
    values = written(rounded_values(spark, d, names), "factors")
    series = xs.ic_from(xs.scored_times(values, names, "fwd5", shares=False), names, 5)
    series = series.join(period_of(week_calendar(values), "ci").select("ts", "period"), "ts")
    scored = series.groupBy("factor", "period").agg(F.avg("ic").alias("rank_ic"), F.count("ic").alias("days")).where("days >= 20")
    wide = scored.groupBy("factor").agg(
        F.max(F.when(F.col("period") == "validation", F.col("rank_ic"))).alias("v"),
        F.max(F.when(F.col("period") == "test", F.col("rank_ic"))).alias("t"),
    ).where("v IS NOT NULL AND t IS NOT NULL")
    decay = (F.avg("v") - F.avg("t")) / F.avg("v")
    return wide.agg(
        F.count("*").alias("factors"), F.round(F.avg("v"), 6).alias("mean_validation_ic"),
        F.round(F.avg("t"), 6).alias("mean_test_ic"), F.round(F.median("t"), 6).alias("median_test_ic"),
        F.round(decay, 4).alias("decay"), (decay > 0.5).alias("killed"),
        F.round(F.avg((F.col("t") > 0).cast("double")), 4).alias("test_positive"),
    )
