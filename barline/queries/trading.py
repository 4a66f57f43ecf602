"""Signals to trades to equity (C family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import ts
from barline.functions.scalar import hash_unit, whole_shares
from barline.operators import books, calendar as cal_ops, metrics, sleeves, sweeps, trades as tr
from barline.operators.joins import with_params
from barline.plans.blocks import in_blocks, number_rows
from barline.queries import fixtures as fx
from barline.queries.crosssection import week_calendar
from barline.queries.registry import query, view
from barline.queries.reports import _METRICS_SQL, book_trades, metric_columns
from barline.queries.tables import index_returns, r6
from barline.queries.timeseries import momentum_signal, panel
from barline.session import cut


@query("signal_returns", "sig", """
SELECT symbol, count(*) AS bars, sum(entry)::BIGINT AS entries, round(product(1 + sr) - 1, 6) AS total_return, round(avg(CASE WHEN sr > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (signal = 1), 6) AS win_rate FROM (
  SELECT *, CASE WHEN signal = 1 THEN nx / close - 1 ELSE 0 END AS sr, CASE WHEN signal = 1 AND prev = 0 THEN 1 ELSE 0 END AS entry FROM (
    SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY pos) AS nx, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY pos), 0) AS prev FROM sig)) WHERE nx IS NOT NULL GROUP BY symbol""")
def signal_returns(spark, d):
    rows = tr.signal_returns(momentum_signal(spark, d))
    won = (F.col("strategy_ret") > 0).cast("double")
    return rows.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.sum("entry").alias("entries"), F.round(F.product(1 + F.col("strategy_ret")) - 1, 6).alias("total_return"),
        F.round(F.avg(F.when(F.col("signal") == 1, won)), 6).alias("win_rate"),
    )


view("tom", "idx_r", """
SELECT r.*, t.turn FROM idx_r r JOIN (SELECT ts, row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts) <= 3 OR row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts DESC) <= 4 AS turn
  FROM (SELECT DISTINCT ts FROM idx_r)) t USING (ts)""")


def turn_flags(spark, d):
    """Daily region returns with the turn-of-month flag of the common calendar."""
    returns = cut(index_returns(spark, d))
    days = returns.select(F.to_date("ts").alias("day")).distinct()
    flags = cal_ops.turn_of_month(days).select("day", "turn")
    return cut(returns.withColumn("day", F.to_date("ts")).join(flags, "day").drop("day"))


@query("flag_sleeve", "tom", """
SELECT symbol, ts, position, round(ret * position, 6) AS gross, round(ret * position - abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY rp), 0)) * 0.0001::DOUBLE, 6) AS net FROM (
  SELECT *, coalesce(lag(turn::INTEGER) OVER (PARTITION BY symbol ORDER BY rp), 0)::DOUBLE AS position FROM tom)""")
def flag_sleeve(spark, d):
    return sleeves.flag_sleeve(turn_flags(spark, d), "turn", 1.0).select("symbol", "ts", "position", *r6("gross", "net"))


# Twelve variants from slope threshold, premium gate and long leg.
VARIANTS = [
    {"variant": f"slope_{int(round(s * 100)):02d}" + ("_vrp" if g else "") + ("_longvol" if l else ""), "slope_min": s, "vrp_gate": g, "long_leg": l}
    for s in (0.0, 0.02, 0.05) for g in (False, True) for l in (False, True)
]

view("sleeve_in", "panel", """
SELECT *, row_number() OVER (ORDER BY ts) - 1 AS sp FROM (
  SELECT ts, vix3m / vix - 1 AS slope, (vix / 100) * (vix / 100) - rv AS vrp, vix / lag(vix, 5) OVER (ORDER BY pos) - 1 AS trend, r AS short_ret, vix6m / lag(vix6m) OVER (ORDER BY pos) - 1 AS long_ret, 0.0001::DOUBLE AS cash_ret FROM (
    SELECT *, CASE WHEN count(r) OVER (ORDER BY pos ROWS 20 PRECEDING) = 21 THEN avg(r * r) OVER (ORDER BY pos ROWS 20 PRECEDING) * 252 END AS rv FROM (
      SELECT *, vvix / lag(vvix) OVER (ORDER BY pos) - 1 AS r FROM panel)))
WHERE slope IS NOT NULL AND vrp IS NOT NULL AND short_ret IS NOT NULL""")
view("variants", "", "SELECT * FROM (VALUES " + ", ".join(
    f"('{v['variant']}', {v['slope_min']}::DOUBLE, {v['vrp_gate']}, {v['long_leg']})" for v in VARIANTS) + ") t(variant, slope_min, vrp_gate, long_leg)")


def sleeve_panel(spark, d):
    def add(rows, w):
        rows = rows.withColumn("short_ret", ts.simple_return("vvix", w))
        return rows.withColumns({
            "slope": F.col("vix3m") / F.col("vix") - 1,
            "vrp": (F.col("vix") / 100) * (F.col("vix") / 100) - ts.realized_variance("short_ret", 21, w),
            "trend": ts.simple_return("vix", w, 5), "long_ret": ts.simple_return("vix6m", w), "cash_ret": F.lit(0.0001),
        })

    rows = in_blocks(panel(spark, d), add, back=22, keys=[]).where("slope IS NOT NULL AND vrp IS NOT NULL AND short_ret IS NOT NULL")
    rows = rows.select("ts", "slope", "vrp", "trend", "short_ret", "long_ret", "cash_ret")
    return number_rows(rows, [], ["ts"])


def run_variants(spark, d, lag=2, bps=3.0):
    rows = cut(sleeve_panel(spark, d))
    grid = with_params(rows.withColumn("last_pos", rows.agg(F.max("pos")).scalar()), VARIANTS)
    return sleeves.weights_sleeve(grid, ["variant"], lag, bps)

def _sleeve_sql(lag: int) -> str:
    at = (lambda c: f"lag({c}, {lag - 1}) OVER v") if lag > 1 else (lambda c: c)
    return f"""
SELECT variant, ts, sp, turnover, sw * coalesce(short_ret, 0) + lw * coalesce(long_ret, 0) + greatest(0, 1 - sw - lw) * coalesce(cash_ret, 0) - turnover * 0.0003::DOUBLE AS net FROM (
  SELECT *, CASE WHEN sp < last THEN abs(tsw - sw) + abs(tlw - lw) ELSE 0 END AS turnover FROM (
    SELECT *, coalesce(lag(tsw) OVER v, 0) AS sw, coalesce(lag(tlw) OVER v, 0) AS lw FROM (
      SELECT *, CASE WHEN ls > slope_min AND (NOT vrp_gate OR lv > 0) THEN 1.0::DOUBLE ELSE 0 END AS tsw, CASE WHEN ls <= slope_min AND long_leg AND ls < 0 AND lt > 0 THEN 1.0::DOUBLE ELSE 0 END AS tlw FROM (
        SELECT *, {at('slope')} AS ls, {at('vrp')} AS lv, {at('trend')} AS lt, max(sp) OVER () AS last FROM sleeve_in CROSS JOIN variants WINDOW v AS (PARTITION BY variant ORDER BY sp)))
    WINDOW v AS (PARTITION BY variant ORDER BY sp)))"""


view("sleeve_out", "sleeve_in variants", _sleeve_sql(2))
view("sleeve_out1", "sleeve_in variants", _sleeve_sql(1))


@query("weights_sleeve", "sleeve_out", "SELECT variant, ts, round(turnover, 6) AS turnover, round(net, 6) AS net FROM sleeve_out")
def weights_sleeve(spark, d):
    return run_variants(spark, d).select("variant", "ts", *r6("turnover", "net"))


# ---- exits and trades

EXITS = tr.exit_params(stop_loss=0.03, trailing=0.02)
view("exits", "sig", """
WITH e AS (SELECT symbol, pos AS ep, ts AS ets, close AS entry, greatest(high, close) AS m0, signal,
    min(CASE WHEN signal = 0 THEN pos END) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nf FROM sig),
p AS (SELECT e.symbol, ep, ets, entry, m0, b.pos, b.low, b.close, b.signal, greatest(m0, coalesce(max(greatest(b.high, b.close)) OVER (PARTITION BY e.symbol, ep ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m0)) AS prior
  FROM e JOIN sig b ON b.symbol = e.symbol AND b.pos > ep AND b.pos <= coalesce(nf, 1000000000) WHERE e.signal = 1),
s AS (SELECT *, entry * (1 - 0.03::DOUBLE) AS fixed, greatest(entry * (1 - 0.03::DOUBLE), prior * (1 - 0.02::DOUBLE)) AS stop FROM p),
h AS (SELECT symbol, ep, min(pos) AS xp FROM s WHERE low <= stop OR signal = 0 GROUP BY 1, 2)
SELECT e.symbol, e.ep, e.ets, e.entry, h.xp, CASE WHEN s.low <= s.stop THEN s.stop WHEN s.signal = 0 THEN s.close END AS px,
  CASE WHEN s.low <= s.stop THEN CASE WHEN s.stop = s.fixed THEN 'stop_loss' ELSE 'trailing_stop' END WHEN s.signal = 0 THEN 'signal_exit' END AS reason
FROM e LEFT JOIN h USING (symbol, ep) LEFT JOIN s ON s.symbol = e.symbol AND s.ep = e.ep AND s.pos = h.xp WHERE e.signal = 1""")


def exits(spark, d):
    return tr.label_exits(cut(momentum_signal(spark, d)), EXITS)


@query("exit_labels", "exits", "SELECT symbol, ep AS entry_pos, ets AS entry_ts, round(entry, 6) AS entry_price, xp AS exit_pos, round(px, 6) AS exit_price, reason FROM exits")
def exit_labels(spark, d):
    return exits(spark, d).select("symbol", "entry_pos", "entry_ts", F.round("entry_price", 6).alias("entry_price"), "exit_pos", F.round("exit_price", 6).alias("exit_price"), "reason")


@query("exit_reasons", "exits", "SELECT symbol, reason, count(*) AS n FROM exits WHERE reason IS NOT NULL GROUP BY 1, 2")
def exit_reasons(spark, d):
    return metrics.exit_reasons(exits(spark, d), ["symbol"])


_CHAIN = """
nx AS (SELECT e.symbol, e.ep, min(x.ep) AS np FROM exits e JOIN exits x ON x.symbol = e.symbol AND x.ep > e.xp + 1 GROUP BY 1, 2),
ch AS (SELECT symbol, min(ep) AS ep FROM exits GROUP BY symbol UNION ALL SELECT c.symbol, n.np FROM ch c JOIN nx n ON n.symbol = c.symbol AND n.ep = c.ep),
taken AS (SELECT e.* FROM exits e JOIN ch USING (symbol, ep))"""


@query("chained_trades", "exits", "WITH " + _CHAIN.lstrip() + " SELECT symbol, ep AS entry_pos, xp AS exit_pos, round(px / entry - 1, 6) AS trade_ret, reason FROM taken", recursive=True)
def chained_trades(spark, d):
    """Trades actually taken with one bar of cool-down."""
    out = tr.chain_trades(exits(spark, d), cooldown=1)
    return out.select("symbol", "entry_pos", "exit_pos", F.round(F.col("exit_price") / F.col("entry_price") - 1, 6).alias("trade_ret"), "reason")


# Cost assumptions of an exchange-traded stock order; the participation rate is set so that it binds at times.
COSTS = {
    "spread_bps": 1.0, "impact_bps": 1.0, "stop_extra_bps": 2.0, "participation": 0.1, "commission": 0.0, "buy_fee_bps": 0.0,
    "sell_fee_bps": 0.0, "sec_per_million": 0.0, "taf_per_share": 0.000195, "taf_cap": 9.79,
}


def orders_of(labels, bars):
    """Buy and sell orders of labelled trades with the bar they are filled on."""
    buys = labels.select("symbol", "entry_pos", F.col("entry_pos").alias("pos"), F.lit("buy").alias("side"), F.col("entry_price").alias("price"), F.lit("signal_entry").alias("reason"))
    sells = labels.where("exit_pos IS NOT NULL").select("symbol", "entry_pos", F.col("exit_pos").alias("pos"), F.lit("sell").alias("side"), F.col("exit_price").alias("price"), "reason")
    return buys.unionByName(sells).join(bars.select("symbol", "pos", "open", "low", "close", "volume"), ["symbol", "pos"]).withColumn("notional", F.lit(1000.0))


view("fills", "exits", """
WITH o AS (SELECT symbol, ep, ep AS pos, 'buy' AS side, entry AS price, 'signal_entry' AS reason FROM exits UNION ALL SELECT symbol, ep, xp, 'sell', px, reason FROM exits WHERE xp IS NOT NULL),
j AS (SELECT o.*, b.open, b.low, b.close, b.volume, reason IN ('stop_loss', 'trailing_stop') AS st FROM o JOIN bars b USING (symbol, pos)),
f AS (SELECT *, CASE WHEN side = 'buy' THEN price * (1 + 1.5::DOUBLE / 10000) WHEN st THEN greatest(low, least(price, open) * (1 - 3.5::DOUBLE / 10000)) ELSE price * (1 - 1.5::DOUBLE / 10000) END AS fill FROM j),
q AS (SELECT *, CASE WHEN side = 'buy' THEN least(1000, volume * close * 0.1::DOUBLE) / fill ELSE least(1000 / price, volume * 0.1::DOUBLE) END AS qty, CASE WHEN side = 'buy' THEN 1000 / fill ELSE 1000 / price END AS want FROM f)
SELECT *, CASE WHEN side = 'buy' THEN 0 ELSE least(qty * 0.000195::DOUBLE, 9.79::DOUBLE) END AS fees, qty < want - 1e-9 AS partial FROM q""")


@query("fill_costs", "fills", "SELECT symbol, ep AS entry_pos, side, round(fill, 6) AS fill_price, round(qty, 6) AS qty, round(fees, 9) AS fees, partial FROM fills")
def fill_costs(spark, d):
    signal = cut(momentum_signal(spark, d))
    out = tr.fill_costs(orders_of(tr.label_exits(signal, EXITS), signal), COSTS)
    return out.select("symbol", "entry_pos", "side", *r6("fill_price", "qty"), F.round("fees", 9).alias("fees"), "partial")


@query("net_trades", "exits fills", "WITH " + _CHAIN.lstrip() + """,
n AS (SELECT t.symbol, (s.fill - 0.000195::DOUBLE) / b.fill - 1 AS net FROM taken t JOIN fills b ON b.symbol = t.symbol AND b.ep = t.ep AND b.side = 'buy' JOIN fills s ON s.symbol = t.symbol AND s.ep = t.ep AND s.side = 'sell')
SELECT symbol, count(*) AS trades, round(avg(CASE WHEN net > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(product(1 + net) - 1, 6) AS total_return FROM n GROUP BY symbol""", recursive=True)
def net_trades(spark, d):
    """Compounded net return per symbol of the chained trades, one unit per trade, participation not binding."""
    signal = cut(momentum_signal(spark, d))
    taken = tr.chain_trades(tr.label_exits(signal, EXITS), cooldown=1)
    out = tr.net_trades(tr.fill_costs(orders_of(taken, signal), COSTS), COSTS)
    return metrics.trade_metrics(out, ["symbol"]).select("symbol", "trades", *r6("win_rate", "total_return"))


# The rule grid; a break-even stop is set after a close 3 % above the entry. With these values a trail is always closer than the
# stop loss and the break-even stop, so that these two never decide an exit; tests/test_sweeps.py has values with which each one does.
SWEEP = {
    "stop_loss": (0.04, 0.05, 0.06), "trail": (0.01, 0.015, 0.02), "time_stop": (10, 20, 30), "break_even": (False, True),
    "cooldown": (1, 2), "strict_entry": (False, True), "weak_block": (False, True),
}
EVEN_AT, STRICT, WEAK_MOVE = 0.03, 0.02, 0.05
_VALUES = lambda names: ", ".join(f"(SELECT unnest([{', '.join(map(str, SWEEP[n]))}]){'::DOUBLE' if isinstance(SWEEP[n][0], float) else ''} AS {n})" for n in names)


def sweep_bars(spark, d):
    """Momentum signals with a stricter entry threshold, and with two weak moves among the last three bars marked."""
    def marks(r, w):
        strict = (F.col("pos") >= 10) & (F.col("close") >= F.avg("close").over(w.rowsBetween(-9, 0)) * (1 + STRICT))
        weak = (F.abs(F.col("close") / F.lag("close").over(w) - 1) < WEAK_MOVE).cast("int")
        return r.withColumns({"strict": strict, "_weak": weak}).withColumn("weak", F.coalesce(F.sum("_weak").over(w.rowsBetween(-2, 0)), F.lit(0)) >= 2).drop("_weak")

    return in_blocks(momentum_signal(spark, d), marks, back=9)


@query("threshold_sweep", "sig", f"""
WITH b AS MATERIALIZED (SELECT symbol, pos, low, high, close, signal, pos >= 10 AND close >= avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) * (1 + {STRICT}::DOUBLE) AS strict,
    sum(CASE WHEN abs(close / prev - 1) < {WEAK_MOVE}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY pos ROWS 2 PRECEDING) >= 2 AS weak FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS prev FROM sig)),
p AS (SELECT e.symbol, e.pos AS ep, e.close AS entry, n.pos, n.low, n.close, n.signal, greatest(e.high, e.close, coalesce(max(greatest(n.high, n.close)) OVER before, 0)) AS prior,
    coalesce(bool_or(n.close >= e.close * (1 + {EVEN_AT}::DOUBLE)) OVER before, false) AS risen
  FROM b e JOIN b n ON n.symbol = e.symbol AND n.pos BETWEEN e.pos + 1 AND e.pos + {max(SWEEP['time_stop'])} WHERE e.signal = 1
  WINDOW before AS (PARTITION BY e.symbol, e.pos ORDER BY n.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT p.*, x.*, greatest(CASE WHEN break_even AND risen THEN entry ELSE entry * (1 - stop_loss) END, prior * (1 - trail)) AS stop FROM p, (SELECT * FROM {_VALUES(["stop_loss", "trail", "time_stop", "break_even"])}) x WHERE pos <= ep + time_stop),
h AS MATERIALIZED (SELECT symbol, ep, stop_loss, trail, time_stop, break_even, min(pos) AS xp, arg_min(CASE WHEN low <= stop THEN stop ELSE close END, pos) / any_value(entry) - 1 AS r
  FROM s WHERE low <= stop OR signal = 0 OR pos = ep + time_stop GROUP BY ALL),
f AS MATERIALIZED (SELECT symbol, pos, strict_entry, weak_block, min(CASE WHEN signal = 1 AND (strict OR NOT strict_entry) AND NOT (weak AND weak_block) THEN pos END) OVER (PARTITION BY symbol, strict_entry, weak_block ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM b, {_VALUES(["strict_entry", "weak_block"])}),
ch AS (SELECT symbol, strict_entry, weak_block, stop_loss, trail, time_stop, break_even, cooldown, min(np) AS ep FROM f, {_VALUES(["stop_loss", "trail", "time_stop", "break_even", "cooldown"])} GROUP BY ALL HAVING min(np) IS NOT NULL
  UNION ALL SELECT c.symbol, c.strict_entry, c.weak_block, c.stop_loss, c.trail, c.time_stop, c.break_even, c.cooldown, f.np
  FROM ch c JOIN h USING (symbol, ep, stop_loss, trail, time_stop, break_even) JOIN f ON f.symbol = c.symbol AND f.strict_entry = c.strict_entry AND f.weak_block = c.weak_block AND f.pos = h.xp + c.cooldown + 1 WHERE f.np IS NOT NULL),
m AS (SELECT symbol, {', '.join(SWEEP)}, count(*) AS trades, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, product(1 + r) - 1 AS total_return,
    CASE WHEN count(*) FILTER (r < 0) > 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / abs(sum(r) FILTER (r < 0)) ELSE count(*) FILTER (r > 0) END AS factor
  FROM ch JOIN h USING (symbol, ep, stop_loss, trail, time_stop, break_even) GROUP BY ALL)
SELECT symbol, {', '.join(SWEEP)}, trades, round(win_rate, 6) AS win_rate, round(total_return, 6) AS total_return, round(factor, 6) AS profit_factor, round(total_return + win_rate * 0.1::DOUBLE + least(factor, 3) * 0.02::DOUBLE, 6) AS score FROM m""", recursive=True)
def threshold_sweep(spark, d):
    """All 432 settings of the rule grid on every candidate of every symbol: trades, win rate, return, profit factor and score of each."""
    bars = cut(sweep_bars(spark, d))
    asks = [(F.col("strict") | F.lit(not a)) & ~(F.col("weak") & F.lit(bool(w))) for a in (0, 1) for w in (0, 1)]
    passages = cut(sweeps.first_passages(bars, SWEEP, EVEN_AT, keep=["strict", "weak"]))
    taken = sweeps.walked_trades(passages, SWEEP, asks, SWEEP["cooldown"])
    scored = metrics.trade_metrics(taken.withColumn("trade_ret", F.col("exit_price") / F.col("entry_price") - 1), ["symbol", "eid", "cooldown", "fid"])
    names = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in sweeps.settings(SWEEP, sweeps.EXIT_PARAMS)])
    score = metrics.composite_score(F.col("total_return"), F.lit(0.0), F.col("win_rate"), F.col("profit_factor"))
    out = scored.withColumns({"s": names[F.col("eid")], "strict_entry": F.col("fid") >= 2, "weak_block": F.col("fid") % 2 == 1, "score": score})
    return out.select("symbol", "s.*", "cooldown", "strict_entry", "weak_block", "trades", *r6("win_rate", "total_return", "profit_factor", "score"))


@query("random_entries", "bars_r", """
WITH s AS (SELECT symbol, ts, pos, fwd1, unnest(range(25)) AS seed FROM bars_r),
h AS (SELECT * FROM s WHERE ('0x' || substr(md5(seed || '|' || symbol || '|' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25::DOUBLE AND fwd1 IS NOT NULL),
m AS (SELECT seed, avg(fwd1) AS r, count(*) AS n FROM h GROUP BY seed), l AS (SELECT list_sort(list(r)) AS rs, avg(r) AS mean, stddev_pop(r) AS sd, avg(n) AS entries FROM m)
SELECT round(mean, 6) AS mean_return, round(sd, 6) AS std_return, round(rs[1], 6) AS p05, round(rs[24], 6) AS p95, round(entries, 4) AS mean_entries FROM l""")
def random_entries(spark, d):
    """Random entries at a rate of 25 % over 25 seeds: mean next-bar return per seed, then its spread."""
    rows = in_blocks(fx.bars(spark, d), lambda r, w: r.withColumn("fwd", ts.forward_return("close", 1, w)), fwd=1)
    out = tr.random_entries(rows.where("fwd IS NOT NULL"), "fwd", 0.25, 25)
    return out.select(*r6("mean_return", "std_return", "p05", "p95"), F.round("mean_entries", 4).alias("mean_entries"))


view("gap_ev", "bars", "SELECT symbol, ts FROM (SELECT *, open / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS gap FROM bars) WHERE gap >= 0.04")


@query("event_sleeve", "bars_r gap_ev wcal", """
WITH a AS (SELECT DISTINCT e.symbol, c.ci + k AS ci FROM gap_ev e JOIN wcal c USING (ts), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE c.ci + k <= (SELECT max(ci) FROM wcal)),
n AS (SELECT ci, count(*) AS n FROM a GROUP BY ci), w AS (SELECT symbol, ci, 1.0::DOUBLE / n AS w FROM a JOIN n USING (ci)),
g AS (SELECT w.ci, sum(w * coalesce(ret, 0)) AS gross FROM w JOIN wcal c USING (ci) LEFT JOIN bars_r b ON b.symbol = w.symbol AND b.ts = c.ts GROUP BY w.ci),
t AS (SELECT ci, sum(abs(w)) AS turnover FROM (SELECT symbol, ci, sum(w) AS w FROM (SELECT * FROM w UNION ALL SELECT symbol, ci + 1, -w FROM w) GROUP BY 1, 2) GROUP BY ci)
SELECT c.ts, coalesce(n, 0) AS n_held, round(coalesce(gross, 0), 6) AS gross, round(coalesce(turnover, 0), 6) AS turnover, round(coalesce(gross, 0) - coalesce(turnover, 0) * 0.0005::DOUBLE, 6) AS net
FROM wcal c LEFT JOIN n USING (ci) LEFT JOIN g USING (ci) LEFT JOIN t USING (ci)""")
def event_sleeve(spark, d):
    bars = cut(in_blocks(
        fx.bars(spark, d),
        lambda r, w: r.withColumns({"gap": F.col("open") / F.lag("close").over(w) - 1, "ret": ts.simple_return("close", w)}), back=1,
    ))
    out = books.event_sleeve(bars.where("gap >= 0.04").select("symbol", "ts"), bars, week_calendar(bars), 4, 5.0)
    return out.select("ts", "n_held", *r6("gross", "turnover", "net"))


@query("run_returns", "tom", """
SELECT symbol, min(ts) AS ts, round(product(1 + ret) - 1, 6) AS run_ret, count(*) AS days FROM (
  SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY rp) AS g FROM (SELECT *, CASE WHEN turn IS DISTINCT FROM lag(turn) OVER (PARTITION BY symbol ORDER BY rp) THEN 1 ELSE 0 END AS chg FROM tom))
WHERE turn GROUP BY symbol, g""")
def run_returns(spark, d):
    return sleeves.run_returns(turn_flags(spark, d), "turn").select("symbol", "ts", F.round("run_ret", 6).alias("run_ret"), "days")


view("shocked", "bars_r", """
SELECT symbol, pos, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ret, pos) = 1 THEN -0.6::DOUBLE ELSE ret END AS ret FROM bars_r WHERE ret IS NOT NULL""")


@query("gap_stress", "shocked", """
WITH q AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY pos) AS eq FROM shocked), k AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS dd FROM q)
SELECT symbol, round(product(1 + ret) - 1, 6) AS total_return, round(min(dd), 6) AS max_drawdown FROM k GROUP BY symbol""")
def gap_stress(spark, d):
    rows = books.with_simple_return(fx.bars(spark, d)).where("ret IS NOT NULL")
    out = metrics.return_metrics(cut(sleeves.gap_stress(rows, ["symbol"])), ["symbol"])
    return out.select("symbol", *r6("total_return", "max_drawdown"))


@query("cap_view", "curve", f"""
SELECT symbol, 0.1::DOUBLE AS weight, round(sd * sqrt(252) * 0.1::DOUBLE, 6) AS vol_part, round(dd * 0.1::DOUBLE, 6) AS drawdown_part, round((pow(1 + tot, 252.0::DOUBLE / days) - 1) * 0.1::DOUBLE, 6) AS cagr_part
FROM (SELECT symbol, product(1 + ret) - 1 AS tot, stddev_pop(ret) AS sd, min(drawdown) AS dd, count(*) AS days FROM curve GROUP BY symbol)""")
def cap_view(spark, d):
    rows = cut(books.with_simple_return(fx.bars(spark, d)))
    out = sleeves.cap_view(metrics.return_metrics(rows, ["symbol"]), 0.1)
    return out.select("symbol", "weight", *r6("vol_part", "drawdown_part", "cagr_part"))


view("vbooks", "book_tr", """
SELECT symbol, sum(CASE WHEN closed_price IS NOT NULL THEN (closed_price - entry_price) * qty ELSE 0 END) AS realized_pnl, sum(CASE WHEN closed_price IS NULL THEN (last_price - entry_price) * qty ELSE 0 END) AS unrealized_pnl,
  sum(CASE WHEN closed_price IS NULL THEN qty ELSE 0 END) AS position_qty, count(*) AS buys, count(closed_price) AS sells FROM book_tr GROUP BY symbol""")
_BOOK = "round(realized_pnl, 6) AS realized_pnl, round(unrealized_pnl, 6) AS unrealized_pnl, round(realized_pnl + unrealized_pnl, 6) AS total_pnl, round(position_qty, 6) AS position_qty"
_BOOK_COLS = ("realized_pnl", "unrealized_pnl", "total_pnl", "position_qty")


@query("virtual_books", "vbooks", f"SELECT symbol, {_BOOK}, buys, sells FROM vbooks")
def virtual_books(spark, d):
    return sleeves.virtual_books(book_trades(spark, d)).select("symbol", *r6(*_BOOK_COLS), "buys", "sells")


@query("book_leaderboard", "vbooks bars", f"""
SELECT v.symbol, round(realized_pnl + unrealized_pnl, 6) AS total_pnl, s.snapshots, s.first_seen FROM vbooks v LEFT JOIN (SELECT symbol, count(*) AS snapshots, min(ts) AS first_seen FROM bars GROUP BY symbol) s USING (symbol)""")
def book_leaderboard(spark, d):
    """Books with one snapshot per bar."""
    signal = cut(momentum_signal(spark, d))
    held = sleeves.virtual_books(sleeves.book_trades(signal, F.lit(500.0))).drop("first_seen")
    out = sleeves.book_leaderboard(held, signal.select("symbol", F.col("ts").alias("created_at")), ["symbol"])
    return out.orderBy(F.desc("total_pnl")).select("symbol", F.round("total_pnl", 6).alias("total_pnl"), "snapshots", "first_seen")


@query("rebalance", "bars book_tr", """
WITH t AS (SELECT symbol FROM (SELECT *, row_number() OVER (ORDER BY mom DESC, symbol) AS rank FROM (
  SELECT symbol, arg_max(close, pos) / arg_min(close, pos) - 1 AS mom FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 20 GROUP BY symbol HAVING count(*) = 20) WHERE mom > 0) WHERE rank <= 10),
h AS (SELECT symbol FROM book_tr WHERE closed_price IS NULL)
SELECT symbol, 'sell' AS side FROM h WHERE symbol NOT IN (SELECT symbol FROM t) UNION ALL SELECT symbol, 'buy' FROM t WHERE symbol NOT IN (SELECT symbol FROM h)""")
def rebalance(spark, d):
    """From the names held by the virtual books to the ten best by momentum."""
    signal = cut(momentum_signal(spark, d))
    held = sleeves.book_trades(signal, F.lit(500.0)).where("exit_price IS NULL").select("symbol")
    return books.rebalance(books.momentum_rank(signal, 20, 10), held)


view("open_pos", "book_tr bars", """
SELECT t.symbol, t.qty, t.entry_price AS avg_entry, t.last_price AS price, (SELECT max(high) FROM bars b WHERE b.symbol = t.symbol AND b.ts >= t.entry_ts) AS high_water FROM book_tr t WHERE closed_price IS NULL""")
view("stops", "open_pos", """
SELECT *, CASE WHEN price <= avg_entry * (1 - 0.01::DOUBLE) THEN 'stop_loss' WHEN price <= greatest(high_water, avg_entry, price) * (1 - 0.005::DOUBLE) THEN 'trailing_stop' END AS reason,
  greatest(avg_entry * (1 - 0.01::DOUBLE), greatest(high_water, avg_entry, price) * (1 - 0.005::DOUBLE)) AS effective_stop FROM open_pos""")


def open_positions(signal):
    held = sleeves.book_trades(signal, F.lit(500.0)).where("exit_price IS NULL")
    since = signal.join(held.select("symbol", "entry_ts"), "symbol").where("ts >= entry_ts")
    high = since.groupBy("symbol").agg(F.max("high").alias("high_water"))
    return held.join(high, "symbol").select(
        "symbol", "qty", F.col("entry_price").alias("avg_entry"), F.col("last_price").alias("price"), "high_water"
    )


@query("stop_decisions", "stops", "SELECT symbol, round(effective_stop, 6) AS effective_stop, reason FROM stops")
def stop_decisions(spark, d):
    out = sleeves.stop_decisions(open_positions(cut(momentum_signal(spark, d))), 0.01, 0.005)
    return out.select("symbol", F.round("effective_stop", 6).alias("effective_stop"), "reason")


@query("limit_checks", "", """
SELECT o_orderkey AS order_id, array_to_string(list_filter([CASE WHEN NOT o_totalprice > 0 THEN 'no_size' END, CASE WHEN buy AND c_acctbal <= 0 THEN 'no_equity' END, CASE WHEN buy AND c_acctbal > 0 AND o_totalprice / (c_acctbal * 100) > 0.5 THEN 'position_size' END,
  CASE WHEN buy AND c_acctbal > 0 AND 0.5 + o_totalprice / (c_acctbal * 100) > 1 THEN 'gross_exposure' END, CASE WHEN buy AND held <= 0 AND n_open >= 10 THEN 'open_positions' END,
  CASE WHEN c_acctbal > 0 AND (5000 - c_acctbal) / 5000 * 10000 > 300 THEN 'daily_loss' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT o.*, c.c_acctbal, o_orderstatus = 'O' AS buy, (o_orderkey % 2) AS held, count(*) OVER (PARTITION BY o_custkey) AS n_open FROM orders o JOIN customer c ON o_custkey = c_custkey)""")
def limit_checks(spark, d):
    """Every order checked against the limits of its customer's account (balance in hundreds)."""
    orders = fx.table(spark, d, "orders")
    n_open = orders.groupBy("o_custkey").agg(F.count("*").alias("n_open"))
    rows = orders.join(n_open, "o_custkey").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("o_totalprice").alias("notional"), F.lit(None).cast("double").alias("quantity"), (F.col("c_acctbal") * 100).alias("equity"),
        F.lit(0.5).alias("gross"), "n_open", (F.col("o_orderkey") % 2).alias("held"), F.lit(500000.0).alias("reference"),
    )
    out = sleeves.limit_checks(rows, 0.5, 1.0, 10, 300.0)
    return out.select("order_id", F.array_join("violations", ",").alias("violations"))


@query("wanted_orders", "sig stops", """
WITH s AS (SELECT symbol, arg_max(signal, pos) AS signal, arg_max(close, pos) AS close FROM sig GROUP BY symbol),
j AS (SELECT s.*, p.qty IS NOT NULL AS held, p.reason AS stop FROM s LEFT JOIN stops p USING (symbol))
SELECT symbol, side, reason FROM (SELECT symbol, CASE WHEN held AND (stop IS NOT NULL OR signal = 0) THEN 'sell' WHEN NOT held AND signal = 1 THEN 'buy' END AS side,
  CASE WHEN held AND stop IS NOT NULL THEN stop WHEN held AND signal = 0 THEN 'signal_exit' WHEN NOT held AND signal = 1 THEN 'signal_entry' END AS reason FROM j) WHERE side IS NOT NULL""")
def wanted_orders(spark, d):
    signal = cut(momentum_signal(spark, d))
    latest = signal.groupBy("symbol").agg(F.max_by("signal", "pos").alias("signal"))
    stops = sleeves.stop_decisions(open_positions(signal), 0.01, 0.005).select("symbol", "qty", F.col("reason").alias("stop_reason"))
    return sleeves.wanted_orders(latest, stops)


@query("is_long", "preds sig_h", """
SELECT symbol, ts, direction = 'bullish' AND strength IN ('medium', 'high') AS plain, direction = 'bullish' AND strength = 'high' AND relative <> 'underperform' AND signal = 1 AS strict FROM preds JOIN sig_h USING (symbol, ts)""")
def is_long(spark, d):
    hourly = cut(tr.rule_signal(fx.bars_h(spark, d), [("momentum", 10, 0.005)]))
    rows = fx.preds_of(hourly).join(hourly.select("symbol", "ts", "signal"), ["symbol", "ts"])
    args = F.col("direction"), F.col("strength"), F.col("relative")
    return rows.select(
        "symbol", "ts", sleeves.is_long(*args).alias("plain"),
        sleeves.is_long(*args, minimum="high", need_relative=True, momentum=F.col("signal") == 1).alias("strict"),
    )


view("sig_h", "bars_h", "SELECT *, CASE WHEN pos >= 10 AND close >= avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) * (1 + 0.005::DOUBLE) THEN 1 ELSE 0 END AS signal FROM bars_h")


@query("conviction", "preds bars_h", """
SELECT symbol, ts, CASE strength WHEN 'low' THEN 0.25::DOUBLE WHEN 'high' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS fraction, CASE WHEN close > 0 THEN floor(1000 * CASE strength WHEN 'low' THEN 0.25::DOUBLE WHEN 'high' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / close) ELSE 0 END::BIGINT AS shares
FROM preds JOIN bars_h USING (symbol, ts)""")
def conviction(spark, d):
    hourly = cut(fx.bars_h(spark, d))
    rows = fx.preds_of(hourly).join(hourly.select("symbol", "ts", "close"), ["symbol", "ts"])
    share = sleeves.conviction(F.col("strength"))
    return rows.select("symbol", "ts", share.alias("fraction"), whole_shares(1000 * share, F.col("close")).alias("shares"))
