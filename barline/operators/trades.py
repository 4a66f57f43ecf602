"""Signals, exits, chained trades and their costs, as set operations instead of position loops."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.scalar import hash_unit
from barline.plans.blocks import BLOCK, in_blocks, running
from barline.plans.chain import reachable
from barline.plans.ranks import KEY_ROWS, groups, whole_groups
from barline.session import checkpoint_ready, cut

HORIZON = 32


def rule_signal(bars: DataFrame, rules: Sequence[tuple[str, int, float]]) -> DataFrame:
    """Signal and indicator per rule (type, lookback, threshold); 0 / null until more than ``lookback`` bars."""
    reach = max(n for _, n, _ in rules)

    def compute(rows: DataFrame, w) -> DataFrame:
        out = []
        for kind, n, threshold in rules:
            mean = F.avg("close").over(w.rowsBetween(-(n - 1), 0))
            top = F.max("close").over(w.rowsBetween(-(n - 1), -1))
            ready = F.col("pos") >= n
            close = F.col("close")
            if kind == "momentum":
                fires, value = close >= mean * (1 + threshold), F.when(mean > 0, close / mean - 1)
            elif kind == "mean_reversion":
                fires, value = close <= mean * (1 - threshold), F.when(mean > 0, (mean - close) / mean)
            elif kind == "breakout":
                fires, value = close >= top, F.when(top > 0, close / top - 1)
            elif kind == "breakdown_exit":
                low = F.min("close").over(w.rowsBetween(-(n - 1), -1))
                fires, value = close > low, F.lit(None).cast("double")
            else:
                raise ValueError(f"unknown signal type {kind}")
            out.append(
                F.struct(
                    F.lit(kind).alias("signal_type"),
                    F.when(ready & fires, 1).otherwise(0).alias("signal"),
                    F.when(ready, value).alias("indicator"),
                )
            )
        columns = {f"_s{i}": c for i, c in enumerate(out)}
        return rows.select("*", *[c.alias(n) for n, c in columns.items()])

    wide = in_blocks(bars, compute, back=reach)
    names = [f"_s{i}" for i in range(len(rules))]
    return wide.select(*bars.columns, F.explode(F.array(*names)).alias("_s")).select(*bars.columns, "_s.*")


def signal_returns(bars: DataFrame) -> DataFrame:
    """A signal at the close of t earns the return of t+1; also flags 0 -> 1 entries."""

    def compute(rows: DataFrame, w) -> DataFrame:
        nxt = F.lead("close").over(w) / F.col("close") - 1
        return rows.withColumn("strategy_ret", F.when(F.col("signal") == 1, nxt).otherwise(F.lit(0.0))).withColumn(
            "entry", ((F.col("signal") == 1) & (F.coalesce(F.lag("signal").over(w), F.lit(0)) == 0)).cast("int")
        ).withColumn("_next", nxt)

    return in_blocks(bars, compute, back=1, fwd=1).where(F.col("_next").isNotNull()).drop("_next")


_STATE = "struct<mark:double,held:int,even:boolean,locked:boolean,exit_pos:bigint,exit_price:double,reason:string>"


def _fold(frame: Column, start: Column, entry: Column, p: dict[str, Column], mode: str) -> Column:
    """Walk the bars after an entry until the first exit; the mark used for a test is the one before that bar."""

    def step(a: Column, b: Column) -> Column:
        prior = F.greatest(a["mark"], entry)
        base = entry * (1 - p["stop_loss"])
        fixed = F.when(a["even"], F.greatest(base, entry)).otherwise(base)
        trail = prior * (1 - F.when(a["locked"], p["lock_trail"]).otherwise(p["trailing"]))
        if mode == "close":
            prior = F.greatest(prior, b["close"])
            trail = prior * (1 - p["trailing"])
        stop = F.greatest(fixed, trail)
        tested = b["close"] if mode == "close" else b["low"]
        hit = tested <= stop
        held = a["held"] + 1
        timed = held >= p["time_stop"]
        off, bad = b["signal"] == 0, b["block"]
        leave = hit | timed | off | bad
        reason = (
            F.when(hit, F.lit("risk_exit") if mode == "close" else F.when(stop == fixed, "stop_loss").otherwise("trailing_stop"))
            .when(timed, "time_stop")
            .when(bad & ~off, "llm_exit")
            .when(off, "prediction_exit" if mode == "close" else "signal_exit")
        )
        price = F.when(hit, b["close"] if mode == "close" else stop).otherwise(b["close"])
        mark = prior if mode == "close" else F.greatest(prior, b["high"], b["close"])
        return F.when(a["exit_pos"].isNotNull(), a).otherwise(
            F.struct(
                mark.alias("mark"),
                held.alias("held"),
                (a["even"] | (b["close"] >= entry * (1 + p["even_at"]))).alias("even"),
                (a["locked"] | (b["close"] >= entry * (1 + p["lock_at"]))).alias("locked"),
                F.when(leave, b["pos"]).alias("exit_pos"),
                F.when(leave, price).alias("exit_price"),
                F.when(leave, reason).alias("reason"),
            ).cast(_STATE)
        )

    return F.aggregate(frame, start, step)


def exit_params(
    stop_loss: float,
    trailing: float,
    time_stop: int | None = None,
    break_even: float | None = None,
    lock_at: float | None = None,
    lock_trail: float | None = None,
) -> dict[str, float]:
    """Exit settings; an option left out never triggers."""
    return {
        "stop_loss": stop_loss,
        "trailing": trailing,
        "time_stop": 2**31 - 1 if time_stop is None else time_stop,
        "even_at": 1e18 if break_even is None else break_even,
        "lock_at": 1e18 if lock_at is None else lock_at,
        "lock_trail": trailing if lock_trail is None else lock_trail,
    }


def label_exits(
    bars: DataFrame,
    params: dict[str, float] | Sequence[str],
    keys: Sequence[str] = ("symbol",),
    mode: str = "intrabar",
    horizon: int = HORIZON,
    block: int = BLOCK,
    carry: Sequence[str] = (),
) -> DataFrame:
    """For every candidate entry (signal = 1, not ``barred``) its exit bar, price and reason.

    ``bars`` needs ``signal``; optional boolean columns: ``block`` (sentiment forces an exit), ``barred`` (no entry).
    ``params`` is a dict of :func:`exit_params`, or the column names ``*`` carrying them per row (for sweeps).
    A candidate still open after ``horizon`` bars goes on from its state with the next ``horizon`` bars, as
    often as needed, so there is no cap on holding times and no join of all bar pairs. Candidates that never
    exit keep a null exit.
    """
    keys = list(keys)
    rows = bars
    for name in ("block", "barred"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False))
    fixed = {k: F.lit(v) for k, v in params.items()} if isinstance(params, dict) else {k: F.col(k) for k in params}
    own = [] if isinstance(params, dict) else list(params)
    bar = F.struct("pos", "low", "high", "close", "signal", "block")
    keep = [*keys, "pos", "ts", "close", *own, *carry]
    first = _walked_exits(rows, params, keep, keys, mode, horizon, block)
    settled = _go_on(rows, first, keys, fixed, mode, horizon, bar)
    return settled.select(
        *keys,
        F.col("pos").alias("entry_pos"),
        F.col("ts").alias("entry_ts"),
        F.col("close").alias("entry_price"),
        *own,
        *carry,
        F.col("_s.exit_pos").alias("exit_pos"),
        F.col("_s.exit_price").alias("exit_price"),
        F.col("_s.reason").alias("reason"),
    )


def _walked_exits(rows: DataFrame, params: dict[str, float] | Sequence[str], keep: list[str], keys: list[str], mode: str, horizon: int, block: int) -> DataFrame:
    """Candidates (``keep``) with their state _s, the last position _seen and whether there may be _more bars.

    The rule of :func:`_fold`, worked out for all candidates of a block at once, one bar ahead at a time; each goes on until it exits or its block
    with the next ``horizon`` bars ends. A null price is minus infinity as a mark or stop, which no price reaches.
    """
    blocks = [*keys, "_blk"]
    first = F.floor(F.greatest(F.col("pos") - F.lit(horizon), F.lit(0)) / F.lit(block))
    own = F.col("_blk") == F.floor(F.col("pos") / F.lit(block))
    spread = rows.withColumn("_blk", F.explode(F.sequence(first, F.floor(F.col("pos") / F.lit(block)))))
    settings = params if isinstance(params, dict) else {k: k for k in params}
    numbers = {f"_{c}": F.col(c).cast("double") for c in ("low", "high", "close", *(x for x in settings.values() if isinstance(x, str)))}
    flags = {"_on": F.col("signal") == 1, "_off": F.col("signal") == 0, "_bad": F.col("block")}
    wanted = F.coalesce(own & (F.col("signal") == 1) & ~F.col("barred"), F.lit(False))
    columns = [*keep, *(c for c in keys if c not in keep), "_blk"]
    spread = spread.select(*dict.fromkeys(columns), *[c.alias(n) for n, c in (numbers | flags | {"_wanted": wanted}).items()])
    dealt = spread.repartition(*blocks).sortWithinPartitions(*blocks, "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, blocks):
            with np.errstate(all="ignore"):
                made = _exits_of(table, blocks, settings, mode, horizon)
            yield from pa.Table.from_arrays([*(made[0].column(c) for c in keep), *made[1]], [*keep, *_WALKED]).to_batches(max_chunksize=10_000)

    kinds = spread.select(*keep, *[F.lit(None).cast(kind).alias(n) for n, kind in _WALKED.items()]).schema
    walked = dealt.mapInArrow(run, kinds)
    held = F.struct(*[F.col(f"_{c}").alias(c) for c in ("mark", "held", "even", "locked", "exit_pos", "exit_price", "reason")]).cast(_STATE)
    return walked.select(*keep, held.alias("_s"), "_seen", "_more")


_WALKED = {
    "_mark": "double", "_held": "int", "_even": "boolean", "_locked": "boolean", "_exit_pos": "long", "_exit_price": "double", "_reason": "string", "_seen": "long", "_more": "boolean",
}


def _exits_of(table: pa.Table, blocks: list[str], settings: dict[str, float | str], mode: str, horizon: int) -> tuple[pa.Table, list[pa.Array]]:
    """The candidates of whole blocks and their states, as arrays in the order of ``_WALKED``."""

    def column(name: str) -> tuple[np.ndarray, np.ndarray]:
        x = table.column(name).combine_chunks()
        ok = x.is_valid().to_numpy(zero_copy_only=False)
        return np.where(ok, x.fill_null(False if pa.types.is_boolean(x.type) else 0.0).to_numpy(zero_copy_only=False), False if pa.types.is_boolean(x.type) else -np.inf), ok

    def at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.isnan(a) | (a >= b)  # a NaN is larger than any number

    group = groups(table, blocks)
    size = np.bincount(group, minlength=1)
    left = (np.cumsum(size)[group] - 1 - np.arange(len(group))) if len(group) else np.zeros(0, np.int64)
    (low, low_ok), (high, _), (close, close_ok) = column("_low"), column("_high"), column("_close")
    (off, known), (bad, _) = column("_off"), column("_bad")
    pos = table.column("pos").to_numpy().astype(np.int64)
    at = np.flatnonzero(column("_wanted")[0])
    p = {k: np.full(len(at), float(v)) if not isinstance(v, str) else column(f"_{v}")[0][at] for k, v in settings.items()}
    entry, entry_ok = close[at], close_ok[at]
    mark = np.maximum(high[at], entry) if mode == "intrabar" else entry.copy()
    base = np.where(entry_ok, entry * (1 - p["stop_loss"]), -np.inf)
    held, even, locked = np.zeros(len(at), np.int32), np.zeros(len(at), bool), np.zeros(len(at), bool)
    exit_row, price, price_ok, reason = np.full(len(at), -1), np.zeros(len(at)), np.zeros(len(at), bool), np.zeros(len(at), np.int8)
    live, ahead = np.flatnonzero(left[at] > 0), 0
    while len(live):
        ahead += 1
        b = at[live] + ahead
        prior = np.maximum(mark[live], entry[live])
        fixed = np.where(even[live], np.maximum(base[live], entry[live]), base[live])
        if mode == "close":
            prior = np.maximum(prior, close[b])
        share = p["trailing"][live] if mode == "close" else np.where(locked[live], p["lock_trail"][live], p["trailing"][live])
        stop = np.maximum(fixed, np.where(np.isneginf(prior), prior, prior * (1 - share)))
        tested, there = (close[b], close_ok[b]) if mode == "close" else (low[b], low_ok[b])
        hit = there & ~np.isneginf(stop) & at_least(stop, tested)
        held[live] += 1
        timed = held[live] >= p["time_stop"][live]
        leave = hit | timed | off[b] | bad[b]
        same = (stop == fixed) | (np.isnan(stop) & np.isnan(fixed))
        why = np.select(
            [hit & (mode == "close"), hit & same, hit, timed, bad[b] & known[b] & ~off[b], off[b] & (mode == "close"), off[b]], [1, 2, 3, 4, 5, 6, 7], 0
        )
        gone = live[leave]
        exit_row[gone], reason[gone] = b[leave], why[leave]
        price[gone] = np.where(hit, close[b] if mode == "close" else stop, close[b])[leave]
        price_ok[gone] = (close_ok[b] | (hit & (mode != "close")))[leave]
        mark[live] = prior if mode == "close" else np.maximum(prior, np.maximum(high[b], close[b]))
        rises = entry_ok[live] & close_ok[b]
        even[live] |= rises & at_least(close[b], entry[live] * (1 + p["even_at"][live]))
        locked[live] |= rises & at_least(close[b], entry[live] * (1 + p["lock_at"][live]))
        live = live[~leave & (left[at[live]] > ahead)]
    done = exit_row >= 0
    seen = np.where(done, exit_row, at + left[at])
    names = pa.array([None, "risk_exit", "stop_loss", "trailing_stop", "time_stop", "llm_exit", "prediction_exit", "signal_exit"], pa.string())
    return table.take(pa.array(at, pa.int64())), [
        pa.array(mark, pa.float64(), mask=np.isneginf(mark)), pa.array(held, pa.int32()), pa.array(even), pa.array(locked),
        pa.array(pos[np.maximum(exit_row, 0)] if len(pos) else exit_row, pa.int64(), mask=~done), pa.array(price, pa.float64(), mask=~(done & price_ok)), names.take(pa.array(reason, pa.int64())),
        pa.array(pos[seen] if len(pos) else seen, pa.int64()), pa.array(~done & (left[at] >= horizon)),
    ]


def _go_on(rows, first, keys, fixed, mode, horizon, bar) -> DataFrame:
    """Continue candidates that are still open while there are more bars."""
    spark = rows.sparkSession
    checkpoint_ready(spark)
    first = first.checkpoint()
    open_ = F.col("_s.exit_pos").isNull() & F.col("_more")
    parts = [first.where(~open_)]
    left = first.where(open_)
    kept = None
    while not left.isEmpty():
        if kept is None:
            kept = rows.select(*keys, "pos", bar.alias("_bar")).checkpoint()
        steps = left.withColumn("_p", F.explode(F.sequence(F.col("_seen") + 1, F.col("_seen") + horizon)))
        met = steps.join(kept.withColumnRenamed("pos", "_p"), [*keys, "_p"], "left")
        by = [c for c in first.columns if c not in ("_s", "_seen", "_more")]
        again = met.groupBy(*by).agg(
            F.first("_s").alias("_s"),
            F.first("_seen").alias("_seen"),
            F.sort_array(F.collect_list("_bar")).alias("_next"),  # at most ``horizon`` bars
        )
        # The entry price is the close of the entry bar; ``fixed`` may name columns kept in ``by``.
        nxt = again.select(
            *by,
            _fold(F.col("_next"), F.col("_s"), F.col("close"), fixed, mode).alias("_s"),
            (F.col("_seen") + F.size("_next")).alias("_seen"),
            (F.size("_next") == horizon).alias("_more"),
        ).checkpoint()
        parts.append(nxt.where(~open_))
        left = nxt.where(open_)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chain_trades(
    exits: DataFrame,
    keys: Sequence[str] = ("symbol",),
    cooldown: int = 0,
    no_same_day: bool = False,
    day: Column | None = None,
    exit_days: DataFrame | None = None,
    block: int = BLOCK,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """The trades actually taken: first candidate, then the first candidate after each exit (and cool-down).

    A task walks the candidates of one key at a time. For keys with more than ``key_rows`` of them the next candidate comes from one backwards running
    value and the chain from pointer doubling. An open candidate has no successor, so it ends its chain. With ``no_same_day`` a candidate on the day of the previous
    exit is skipped: ``day`` is the entry day and ``exit_days`` maps (keys, exit_pos) to the last position of that day.
    """
    keys = list(keys)
    after = F.col("exit_pos") + F.lit(cooldown)
    nodes = exits
    if no_same_day:
        nodes = nodes.join(exit_days, [*keys, "exit_pos"], "left")
        after = F.greatest(after, F.col("day_last"))
    counts = exits.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = cut(counts.where(F.col("_n") > key_rows).select(*keys))  # few: each stands for more than key_rows rows
    some = not large.isEmpty()
    nodes = nodes.withColumn("_after", F.when(F.col("exit_pos").isNotNull(), after).cast("long")).select(*exits.columns, "_after")
    walked = nodes.join(large, keys, "left_anti") if some else nodes
    dealt = walked.repartition(*keys).sortWithinPartitions(*keys, "entry_pos")
    columns = exits.columns
    taken = dealt.mapInArrow(lambda batches: _walk(batches, keys, columns), walked.select(*columns).schema)
    return taken.unionByName(_chain_by_doubling(nodes.join(large, keys, "left_semi"), keys, block).select(*columns)) if some else taken


def _walk(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The candidates met on the walk from the first one of each key; rows are sorted by keys and entry position."""
    for table in whole_groups(batches, keys):
        group = groups(table, keys)
        entry = table.column("entry_pos").to_numpy().astype(np.int64)
        leaves = table.column("_after").combine_chunks()
        after = np.where(leaves.is_valid().to_numpy(zero_copy_only=False), leaves.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
        taken = []
        for begin, end in zip(edges, edges[1:]):
            following = (begin + np.searchsorted(entry[begin:end], after[begin:end], side="right")).tolist()
            at = begin
            while at < end:
                taken.append(at)
                at = following[at - begin]
        yield from table.select(columns).take(pa.array(taken, pa.int64())).to_batches(max_chunksize=10_000)


def _chain_by_doubling(nodes: DataFrame, keys: list[str], block: int) -> DataFrame:
    cand = nodes.select(*keys, F.struct(F.col("entry_pos").alias("p"), F.lit(1).alias("s")).alias("_at"),
                        F.col("entry_pos").alias("_cand"), F.lit(None).cast("long").alias("_from"))
    asks = nodes.where(F.col("_after").isNotNull()).select(
        *keys, F.struct((F.col("_after") + 1).alias("p"), F.lit(0).alias("s")).alias("_at"),
        F.lit(None).cast("long").alias("_cand"), F.col("entry_pos").alias("_from"),
    )
    # Several candidates may ask from the same place, so the order needs the asker as a tie-break.
    both = cand.unionByName(asks).withColumn("_at", F.struct("_at.p", "_at.s", F.coalesce("_from", F.lit(-1)).alias("f")))
    found = running(
        both, {"next_pos": ("next", F.col("_cand"))}, keys=keys, pos="_at", bucket=F.floor(F.col("_at.p") / block)
    )
    pointers = found.where(F.col("_from").isNotNull()).select(*keys, F.col("_from").alias("entry_pos"), "next_pos")
    graph = nodes.select(*keys, "entry_pos").join(pointers, [*keys, "entry_pos"], "left")
    taken = reachable(graph, keys, "entry_pos", "next_pos")
    return nodes.join(taken, [*keys, "entry_pos"], "left_semi")


def fill_costs(orders: DataFrame, a: dict[str, float]) -> DataFrame:
    """Fill price, quantity and fees per order.

    ``orders``: side, price, reason, notional, bar columns open, low, close, volume. ``a`` holds the cost assumptions.
    """
    stop = F.col("reason").isin("stop_loss", "trailing_stop")
    base = a["spread_bps"] / 2.0 + a["impact_bps"]
    buy = F.col("side") == "buy"
    gap = stop & F.col("open").isNotNull() & (F.col("open") < F.col("price"))
    ref = F.when(~buy & gap, F.col("open")).otherwise(F.col("price"))
    slip = F.lit(base) + F.when(~buy & stop, F.lit(a["stop_extra_bps"])).otherwise(F.lit(0.0))
    sell_fill = ref * (1 - slip / 10000.0)
    fill = F.when(buy, ref * (1 + slip / 10000.0)).otherwise(
        F.when(stop, F.greatest(F.col("low"), sell_fill)).otherwise(sell_fill)
    )
    priced = orders.withColumn("fill_price", fill)
    cap = F.col("volume") * F.col("close") * a["participation"]
    wanted = F.col("notional") - a["commission"]
    spend = F.when(buy & (cap > 0), F.least(wanted, cap)).otherwise(wanted)
    shares = F.when(buy, spend / F.col("fill_price")).otherwise(
        F.when(F.col("volume") > 0, F.least(F.col("notional") / F.col("price"), F.col("volume") * a["participation"])).otherwise(
            F.col("notional") / F.col("price")
        )
    )
    sized = priced.withColumn("qty", shares).withColumn("gross", F.col("qty") * F.col("fill_price"))
    sell_fees = (
        F.col("gross") * (a["sell_fee_bps"] / 10000.0)
        + F.col("gross") / 1000000.0 * a["sec_per_million"]
        + F.least(F.col("qty") * a["taf_per_share"], F.lit(a["taf_cap"]))
    )
    fees = F.lit(a["commission"]) + F.when(buy, F.col("gross") * (a["buy_fee_bps"] / 10000.0)).otherwise(sell_fees)
    full = F.when(buy, wanted / F.col("fill_price")).otherwise(F.col("notional") / F.col("price"))
    return sized.withColumn("fees", fees).withColumn("partial", F.col("qty") < full - 1e-9)


def whole_cost(a: dict[str, float]) -> float:
    """Round-trip cost in bps without participation limits."""
    return math.fsum([a["spread_bps"], 2 * a["impact_bps"], a["buy_fee_bps"], a["sell_fee_bps"]])


def net_trades(fills: DataFrame, a: dict[str, float]) -> DataFrame:
    """Net return per trade (symbol, entry_pos) from its buy and sell fills, when participation does not bind."""
    paid = F.col("fill_price") * (1 + a["buy_fee_bps"] / 10000.0)
    got = F.col("fill_price") * (1 - a["sell_fee_bps"] / 10000.0 - a["sec_per_million"] / 1000000.0) - a["taf_per_share"]
    both = fills.groupBy("symbol", "entry_pos").agg(
        F.max(F.when(F.col("side") == "buy", paid)).alias("_paid"), F.max(F.when(F.col("side") == "sell", got)).alias("_got")
    )
    return both.select("symbol", "entry_pos", (F.col("_got") / F.col("_paid") - 1).alias("trade_ret")).where("trade_ret IS NOT NULL")


def random_entries(rows: DataFrame, ret: str, rate: float, seeds: int) -> DataFrame:
    """Control: enter at random with the given rate; spread of the mean return over the seeds.

    The draw of a row is a hash of (seed, symbol, pos), so it does not depend on partitioning or retries.
    """
    drawn = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    entered = drawn.where(hash_unit(F.col("seed"), F.col("symbol"), F.col("pos")) < rate)
    per_seed = entered.groupBy("seed").agg(F.avg(ret).alias("r"), F.count("*").alias("n"))
    spread = per_seed.agg(
        F.avg("r").alias("mean_return"), F.stddev_pop("r").alias("std_return"), F.avg("n").alias("mean_entries"),
        F.sort_array(F.collect_list("r")).alias("_r"),  # one number per seed
    )
    low, high = max(0, int(0.05 * seeds) - 1), min(seeds - 1, int(0.95 * seeds))
    return spread.select("mean_return", "std_return", "mean_entries", F.get("_r", F.lit(low)).alias("p05"), F.get("_r", F.lit(high)).alias("p95"))
