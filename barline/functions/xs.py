"""Cross-section operators: everything that compares the symbols of one time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.scalar import clip, corr_of
from barline.plans.arrays import Series, in_arrays
from barline.plans.blocks import number_rows
from barline.plans.ranks import KEY_ROWS, average_rank, average_ranks, groups, quantiles, whole_groups
from barline.session import written

PERIODS = 252.0
EPS = 1e-12  # a correlation this small is zero up to rounding


def cs_rank(df: DataFrame, x: str, name: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Tie-averaged percentile rank among the non-null values of one time."""
    return average_rank(df, list(keys), x, name)


def cs_zscore(df: DataFrame, x: str, name: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """(x - mean) / sample std per time; null where the std is 0."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    scored = F.when(F.col("_s") > 0, (F.col(x) - F.col("_m")) / F.col("_s"))
    return df.join(stats, list(keys)).select(*df.columns, scored.alias(name))


def winsorize(df: DataFrame, x: str, name: str, low=0.01, high=0.99, keys: Sequence[str] = ("ts",)) -> DataFrame:
    edges = quantiles(df, list(keys), x, {"_lo": low, "_hi": high}).drop("n_values")
    kept = F.when(F.col(x).isNotNull(), clip(F.col(x), F.col("_lo"), F.col("_hi")))
    return df.join(edges, list(keys), "left").select(*df.columns, kept.alias(name))


def to_long(df: DataFrame, factors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, factor)."""
    return df.unpivot(list(keep), list(factors), "factor", "x")


def rank_ensemble(df: DataFrame, signs: dict[str, float], name: str = "ensemble") -> DataFrame:
    """Mean of the signed percentile ranks of several factors; null unless every factor has a value."""
    ranked = average_ranks(df.select("symbol", "ts", *signs), ["ts"], {f"_r{i}": f for i, f in enumerate(signs)})
    total = sum((F.col(f"_r{i}") * float(s) for i, s in enumerate(signs.values())), F.lit(0.0))  # null as soon as one is
    return ranked.select("symbol", "ts", (total / len(signs)).alias(name))


def ranked_with(df: DataFrame, factors: Sequence[str], fwd: str, keys: Sequence[str] = ("ts",), key_rows: int = KEY_ROWS) -> DataFrame:
    """symbol, keys and for factor i: _x{i}, _y{i}, the ranks of the factor and of ``fwd`` over the rows that have both, and _n{i}, their number.

    All factors are ranked wide: one shuffle of the rows on the keys serves them all. ``df`` is a table already written.
    """
    values = df.select("symbol", *keys, F.col(fwd).alias("_fwd"), *[F.when(F.col(fwd).isNotNull(), F.col(f)).alias(f"_f{i}") for i, f in enumerate(factors)])
    names = {f"_{r}{i}": f"_f{i}" if r == "x" else ("_fwd", f"_f{i}") for i in range(len(factors)) for r in "xy"}
    ranked = average_ranks(values, list(keys), names, pct=False, key_rows=key_rows, cheap=True, sizes={f"_n{i}": f"_f{i}" for i in range(len(factors))})
    return ranked.drop("_fwd", *[f"_f{i}" for i in range(len(factors))])


def _by_factor(wide: DataFrame, keys: Sequence[str], factors: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One row per (keys, factor) from a wide table: ``columns`` maps names to the prefixes of the factors' columns."""
    item = F.array(*[F.struct(F.lit(f).alias("factor"), *[F.col(f"{p}{i}").alias(n) for n, p in columns.items()]) for i, f in enumerate(factors)])
    return wide.select(*keys, F.explode(item).alias("_i")).select(*keys, "_i.*")


def ic_series(ranked: DataFrame, factors: Sequence[str], min_symbols: int, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """factor, keys, ic, n: rank correlation with the forward return at each time with enough symbols; from :func:`ranked_with`.

    Ranks are taken from their mean, (n + 1) / 2, so that a column of ties adds exactly nothing. Each batch is reduced to four sums for each time and factor.
    """
    columns = [f"_{c}{i}" for c in "xyn" for i in range(len(factors))]
    return _ic_of(ic_sums(ranked, factors, keys), keys, factors, min_symbols)


def ic_sums(ranked: DataFrame, factors: Sequence[str], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """keys, i, n, xx, yy, xy: for factor i its rows, and the sums of squares and products of the centred ranks."""
    columns = [f"_{c}{i}" for c in "xyn" for i in range(len(factors))]
    wide = ranked.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    schema = wide.select(*keys, F.lit(0).alias("i"), *[F.lit(None).cast("double").alias(c) for c in ("n", "xx", "yy", "xy")]).schema
    sums = wide.mapInArrow(lambda batches: _ic_sums(batches, len(keys), len(factors)), schema)
    return sums.groupBy("i", *keys).agg(*[F.sum(c).alias(c) for c in ("n", "xx", "yy", "xy")])


def _ic_of(sums: DataFrame, keys: Sequence[str], factors: Sequence[str], min_symbols: int) -> DataFrame:
    ic = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    name = F.element_at(F.array(*map(F.lit, factors)), F.col("i") + 1)
    return sums.select(name.alias("factor"), *keys, ic.alias("ic"), F.col("n").cast("long").alias("n")).where(F.col("n") >= min_symbols)


def _ic_sums(batches: Iterator[pa.RecordBatch], n_keys: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each time and factor of a batch: its rows with both ranks, and the sums of squares and products of the centred ranks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pa.Table.from_arrays([*batch.columns[:n_keys], pa.array(np.arange(batch.num_rows))], [*batch.schema.names[:n_keys], "_row"])
        first = keys.group_by(keys.column_names[:-1]).aggregate([("_row", "list")])
        rows = first.column("_row_list").combine_chunks()
        code = np.empty(batch.num_rows, np.int64)
        code[rows.flatten().to_numpy()] = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
        x, y, n = batch.column(n_keys).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, size).transpose(1, 2, 0)
        for i in range(size):
            ok = ~np.isnan(x[i])
            p, q = x[i][ok] - (n[i][ok] + 1) / 2, y[i][ok] - (n[i][ok] + 1) / 2
            made = [np.bincount(code[ok], w, len(rows)) for w in (np.ones(len(p)), p * p, q * q, p * q)]
            own = np.flatnonzero(made[0])
            if len(own):
                held = [first.column(c).combine_chunks().take(pa.array(own)) for c in keys.column_names[:-1]]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(own), i, np.int32)), *(pa.array(m[own]) for m in made)], [*keys.column_names[:-1], "i", "n", "xx", "yy", "xy"])


def scored_times(df: DataFrame, factors: Sequence[str], fwd: str, shares: bool = True, key_rows: int = KEY_ROWS) -> DataFrame:
    """ts, s and, with ``shares``, symbol and _p{i}: the percentile rank of factor i over the rows that have both it and ``fwd``.

    ``s`` is set on one row of a time and holds what :func:`ic_from` needs. A task gets the rows of one time at a time; times with more rows than
    ``key_rows`` go by ranges. ``df`` is a table already written.
    """
    size = len(factors)
    counts = df.groupBy("ts").agg(F.count("*").alias("_n"))
    large = counts.where(F.col("_n") > key_rows).select("ts")  # few: each stands for more than key_rows rows
    some = not large.isEmpty()
    small = df.join(large, "ts", "left_anti") if some else df
    parts = [f"_p{i}" for i in range(size)]
    dealt = small.select(*(["symbol"] if shares else []), "ts", F.col(fwd).alias("_fwd"), *[F.col(f).alias(p) for f, p in zip(factors, parts)])
    kind = df.schema["ts"].dataType.simpleString()
    rows = "".join(f", {p} double" for p in ("symbol string", *parts)).replace("symbol string double", "symbol string") if shares else ""
    dealt = dealt.repartition("ts").sortWithinPartitions("ts")
    out = dealt.mapInArrow(lambda batches: _scored(batches, parts, shares), f"ts {kind}, s array<double>{rows}")
    if some:
        ranked = written(ranked_with(df.join(large, "ts", "left_semi"), factors, fwd, key_rows=key_rows), "factor-ranks")
        sums = ic_sums(ranked, factors).groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("i", "n", "xx", "yy", "xy"))).alias("_l"))  # a row for each factor
        held = F.flatten(F.transform("_l", lambda x: F.array(x["i"].cast("double"), x["n"], x["xx"], x["yy"], x["xy"])))
        own = [F.lit(None).cast("string").alias("symbol"), *[F.lit(None).cast("double").alias(p) for p in parts]] if shares else []
        out = out.unionByName(sums.select("ts", held.alias("s"), *own))
        if shares:
            placed = [(F.col(f"_x{i}") / F.col(f"_n{i}")).alias(p) for i, p in enumerate(parts)]
            out = out.unionByName(ranked.select("ts", F.lit(None).cast("array<double>").alias("s"), "symbol", *placed))
    return out


def _scored(batches: Iterator[pa.RecordBatch], parts: list[str], shares: bool) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["ts"]):
        group = groups(table, ["ts"])
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for begin, end in zip(edges, edges[1:]):
            own = table.slice(begin, end - begin)
            fwd, sums, out = own.column("_fwd").combine_chunks(), [], []
            scored, ranks = fwd.is_valid().to_numpy(zero_copy_only=False), {}
            for i, p in enumerate(parts):
                x = own.column(p).combine_chunks()
                both = scored & x.is_valid().to_numpy(zero_copy_only=False)
                n, at = int(both.sum()), np.packbits(both).tobytes()
                if at not in ranks:
                    ranks[at] = _tied_ranks(fwd.to_numpy(zero_copy_only=False)[both])
                r, middle = _tied_ranks(x.to_numpy(zero_copy_only=False)[both]), (n + 1) / 2
                a, b = r - middle, ranks[at] - middle
                if n:
                    sums += [float(i), float(n), float(a @ a), float(b @ b), float(a @ b)]
                if shares:
                    share = np.zeros(len(both))
                    share[both] = r / max(n, 1)
                    out.append(pa.array(share, mask=~both))
            size = own.num_rows if shares else 1
            held = pa.array([sums] + [None] * (size - 1), pa.list_(pa.float64()))
            when = own.column("ts").combine_chunks().slice(0, size)
            columns = [when, held, *([own.column("symbol").combine_chunks(), *out] if shares else [])]
            made = pa.Table.from_arrays(columns, ["ts", "s", *(["symbol", *parts] if shares else [])])
            yield from made.to_batches(max_chunksize=10_000)


def _tied_ranks(x: np.ndarray) -> np.ndarray:
    """Tie-averaged ranks from 1; NaN is the largest."""
    _, code, ties = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(ties) - (ties - 1) / 2)[code]


def ic_from(scored: DataFrame, factors: Sequence[str], min_symbols: int) -> DataFrame:
    """factor, ts, ic, n from the sums of :func:`scored_times`."""
    item = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.size("s") / 5) - 1), lambda k: F.struct(*[F.get("s", (k * 5 + j).cast("int")).alias(c) for j, c in enumerate(("i", "n", "xx", "yy", "xy"))]))
    sums = scored.where(F.size("s") > 0).select("ts", F.explode(item).alias("_i")).select("ts", "_i.*").withColumn("i", F.col("i").cast("int"))
    return _ic_of(sums, ["ts"], factors, min_symbols)


def rank_turnover(scored: DataFrame, cal: DataFrame, factors: Sequence[str]) -> DataFrame:
    """factor, turnover: mean absolute change of the percentile rank between consecutive times, averaged per time first."""
    shares = {f"_m{i}": f"_p{i}" for i in range(len(factors))}
    placed = scored.where("symbol IS NOT NULL").select("symbol", "ts", *shares.values()).join(cal, "ts")

    def change(s: dict[str, Series]) -> dict[str, Series]:
        follows = s["ci"].lag().v == s["ci"].v - 1
        return {m: (s[p] - s[p].lag()).abs().where(follows) for m, p in shares.items()}

    moved = in_arrays(placed.drop("ts"), change, ["ci", *shares.values()], list(shares), back=1, pos="ci")
    daily = moved.groupBy("ci").agg(*[F.avg(f"_m{i}").alias(f"_t{i}") for i in range(len(factors))])
    return _by_factor(daily.agg(*[F.avg(f"_t{i}").alias(f"_t{i}") for i in range(len(factors))]), [], factors, {"turnover": "_t"})


def factor_ic(
    df: DataFrame,
    factors: Sequence[str],
    fwd: str,
    min_symbols: int = 20,
    min_days: int = 60,
    min_coverage: float = 0.5,
    periods: float = PERIODS,
    direction: float = 1.0,
    cheap: bool = False,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Score factors by their daily rank correlation with the forward return.

    ``df`` has symbol, ts, ``fwd`` and a column for each factor. Returns factor, rank_ic, icir (annualised, population std), ic_positive, turnover,
    coverage and days; factors with too few days or too little coverage are dropped. The rows stay wide: they are shuffled once for all ranks and
    once for all turnovers. ``cheap`` says that ``df`` is a table already written.
    """
    df = df if cheap else written(df.select("symbol", "ts", fwd, *factors), "factors")
    scored = written(scored_times(df, factors, fwd, key_rows=key_rows), "factor-scores")
    series = ic_from(scored, factors, min_symbols)
    cal = number_rows(df.select("ts").distinct(), [], ["ts"], pos="ci")
    ic = F.col("ic") * direction
    scores = series.groupBy("factor").agg(
        F.avg(ic).alias("rank_ic"),
        F.stddev_pop("ic").alias("_sd"),
        F.avg(F.when(ic.isNotNull(), (ic > EPS).cast("double"))).alias("ic_positive"),
        F.count("ic").alias("days"),
        F.count("*").alias("_usable"),
        F.avg("n").alias("_n"),
    )
    symbols = df.select("symbol").distinct().agg(F.count("*")).scalar()
    out = scores.join(rank_turnover(scored, cal, factors), "factor", "left")
    icir = F.when(F.col("_sd") > 0, F.col("rank_ic") / F.col("_sd") * math.sqrt(periods)).otherwise(0.0)
    return (
        out.withColumn("coverage", F.col("_n") / F.greatest(symbols, F.lit(1)))
        .where((F.col("_usable") >= min_days) & (F.col("days") >= min_days) & (F.col("coverage") >= min_coverage))
        .select("factor", "rank_ic", icir.alias("icir"), "ic_positive", F.coalesce("turnover", F.lit(1.0)).alias("turnover"), "coverage", "days")
    )


def factor_corr(df: DataFrame, factors: Sequence[str], min_days: int = 30, cheap: bool = False, key_rows: int = KEY_ROWS) -> DataFrame:
    """a, b, corr: mean per-time rank correlation of every pair of factors, each pair ranked over the rows that have both.

    A task gets the rows of one time at a time and works out all of its pairs in arrays; times with more rows than ``key_rows`` go by ranges.
    ``cheap`` says that ``df`` is a table already written.
    """
    df = df.select("symbol", "ts", *factors)
    df = df if cheap else written(df, "factors")
    counts = df.groupBy("ts").agg(F.count("*").alias("_n"))
    large = counts.where(F.col("_n") > key_rows).select("ts")  # few: each stands for more than key_rows rows
    some = not large.isEmpty()
    small = df.join(large, "ts", "left_anti") if some else df
    dealt = small.select("ts", *factors).repartition("ts").sortWithinPartitions("ts")
    every = dealt.mapInArrow(lambda batches: _pairs(batches, list(factors)), "a string, b string, c double")
    if some:
        every = every.unionByName(_pairs_by_ranges(df.join(large, "ts", "left_semi"), factors, key_rows))
    return every.groupBy("a", "b").agg(F.when(F.count("*") < min_days, 0.0).otherwise(F.coalesce(F.avg("c"), F.lit(0.0))).alias("corr"))


def _pairs(batches: Iterator[pa.RecordBatch], factors: list[str]) -> Iterator[pa.RecordBatch]:
    """a, b, c: the rank correlation of each pair of factors at each time, null where one side is constant; batches are sorted by time."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("c", pa.float64())])
    for table in whole_groups(batches, ["ts"]):
        group = groups(table, ["ts"])
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for begin, end in zip(edges, edges[1:]):
            yield pa.RecordBatch.from_pylist(_time_pairs(table.slice(begin, end - begin), factors), schema=schema)


def _time_pairs(table: pa.Table, factors: list[str]) -> list[dict]:
    """Factors with values on the same rows are ranked once and multiplied together; for others each is ranked on the rows common to both."""
    columns = [table.column(f).combine_chunks() for f in factors]
    known = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
    alike: dict[bytes, list[int]] = {}
    for i, ok in enumerate(known):
        alike.setdefault(np.packbits(ok).tobytes(), []).append(i)
    sets, ranks = list(alike.values()), {}

    def ranked(own: int, rows: np.ndarray) -> np.ndarray:
        """Centred ranks over the rows, scaled to length one; NaN where all are equal."""
        at = (own, np.packbits(rows).tobytes())
        if at not in ranks:
            out = []
            for i in sets[own]:
                _, code, ties = np.unique(columns[i].to_numpy(zero_copy_only=False)[rows], return_inverse=True, return_counts=True)
                r = (np.cumsum(ties) - (ties - 1) / 2)[code] - (len(code) + 1) / 2
                size = r @ r
                out.append(r / np.sqrt(size) if size > 0 else r * np.nan)
            ranks[at] = np.array(out)
        return ranks[at]

    made = []
    for m in range(len(sets)):
        for n in range(m, len(sets)):
            rows = known[sets[m][0]] & known[sets[n][0]]
            if not rows.any():
                continue
            c = ranked(m, rows) @ ranked(n, rows).T
            for p, i in enumerate(sets[m]):
                for q, j in enumerate(sets[n]):
                    if m != n or i < j:
                        a, b = sorted((i, j))
                        made.append({"a": factors[a], "b": factors[b], "c": None if np.isnan(c[p, q]) else float(c[p, q])})
    return made


def _pairs_by_ranges(df: DataFrame, factors: Sequence[str], key_rows: int) -> DataFrame:
    """Like :func:`_pairs` for times with more rows than a task holds.

    One pass ranks every factor over its own rows and adds up, for each time, the products of all ranks (a Gram matrix). Where both factors of a
    pair have values on the same rows, its correlation follows from these sums; the other (time, pair)s are ranked again on their common rows.
    """
    df = written(df, "factors")
    size = len(factors)
    ranked = average_ranks(df, ["ts"], {f"_x{i}": f for i, f in enumerate(factors)}, pct=False, cheap=True, key_rows=key_rows)
    sums = ranked.select("ts", F.array(*[F.col(f"_x{i}") for i in range(size)]).alias("x")).mapInArrow(lambda batches: _gram(batches, size), "ts timestamp, s array<double>")
    # Partial sums of a time: one row for each batch that holds some of its rows.
    total = sums.select("ts", F.posexplode("s").alias("i", "v")).groupBy("ts", "i").agg(F.sum("v").alias("v"))
    total = total.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select("ts", F.transform("s", lambda x: x["v"]).alias("s"))
    at = lambda kind, i, j: F.col("s")[kind * size * size + i * size + j]
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]

    def daily(i: int, j: int) -> Column:
        n, sx, sy = at(0, i, j), at(1, i, j), at(1, j, i)
        vx, vy = at(2, i, j) - sx * sx / n, at(2, j, i) - sy * sy / n
        same = (n == at(0, i, i)) & (n == at(0, j, j))
        c = F.when((vx > 1e-9) & (vy > 1e-9), (at(3, i, j) - sx * sy / n) / F.sqrt(vx * vy))
        return F.when(n > 0, F.struct(F.lit(factors[i]).alias("a"), F.lit(factors[j]).alias("b"), same.alias("same"), F.when(same, c).alias("c")))

    found = total.select("ts", F.explode(F.filter(F.array(*[daily(i, j) for i, j in pairs]), lambda x: x.isNotNull())).alias("p")).select("ts", "p.*")
    found = written(found, "factor-pairs")
    again = found.where(~F.col("same")).groupBy("ts").agg(F.collect_list(F.struct("a", "b")).alias("p"))  # at most all pairs of factors
    value = lambda name: F.coalesce(*[F.when(F.col(name) == f, F.col(f)) for f in factors])
    rows = df.join(again, "ts").select("symbol", "ts", F.explode("p").alias("p"), *factors).withColumns({"a": F.col("p.a"), "b": F.col("p.b")})
    rows = rows.select("symbol", "ts", "a", "b", value("a").alias("x"), value("b").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = average_ranks(rows, ["a", "b", "ts"], {"_rx": "x", "_ry": "y"}, pct=False, key_rows=key_rows)
    rows = rows.groupBy("a", "b", "ts").agg(corr_of(F.col("_rx"), F.col("_ry")).alias("c"))
    return found.where("same").select("a", "b", "c").unionByName(rows.select("a", "b", "c"))


def _gram(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each time of a batch: counts, sums, sums of squares and of products of the ranks (nulls left out), each a matrix over pairs of factors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        known = ~np.isnan(values)
        x, m = np.where(known, values, 0.0), known.astype(np.float64)
        times, code = np.unique(batch.column(0).cast(pa.int64()).to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(times) + 1))
        out = []
        for a, b in zip(edges, edges[1:]):
            own = order[a:b]
            p, q = x[own], m[own]
            out.append(np.concatenate([(q.T @ q).ravel(), (p.T @ q).ravel(), ((p * p).T @ q).ravel(), (p.T @ p).ravel()]))
        first = pa.array(times, pa.int64()).cast(batch.schema.field(0).type)
        yield pa.RecordBatch.from_arrays([first, pa.array([o.tolist() for o in out], pa.list_(pa.float64()))], ["ts", "s"])


# Acceptance limits of a factor.
MIN_IC, MIN_ICIR, MAX_TURNOVER, MAX_CORR = 0.02, 0.25, 0.45, 0.70


def accept(scores: DataFrame, min_ic: float = MIN_IC, min_icir: float = MIN_ICIR, max_turnover: float = MAX_TURNOVER) -> DataFrame:
    """Factors strong enough in either direction and stable enough."""
    return scores.where(
        (F.abs("rank_ic") >= min_ic) & (F.abs("icir") >= min_icir) & (F.col("turnover") <= max_turnover)
    )


def accepted_factors(scores: DataFrame, corr: DataFrame, limit: float = MAX_CORR, **limits: float) -> DataFrame:
    """factor, place, strong, accepted: factors in falling |ICIR|, whether they pass :func:`accept`, and whether the walk keeps them.

    The walk takes each strong factor that is not correlated beyond ``limit`` with one it has taken. Its tables have a row per factor or pair of factors.
    """
    order = [F.desc(F.abs(F.round("icir", 6))), F.asc("factor")]
    strong = accept(scores, **limits).select("factor", F.lit(True).alias("strong"))
    ranked = scores.join(strong, "factor", "left").select("factor", F.row_number().over(Window.orderBy(*order)).alias("place"), F.coalesce("strong", F.lit(False)).alias("strong"))
    ranked = written(ranked, "factor-places")
    kept = drop_correlated([r["factor"] for r in ranked.where("strong").orderBy("place").collect()], corr, limit)
    return ranked.withColumn("accepted", F.col("factor").isin(kept))


def drop_correlated(ranked: Sequence[str], corr: DataFrame, limit: float = MAX_CORR) -> list[str]:
    """Names kept when walking along ``ranked`` and skipping those correlated with a kept one; ``corr`` has one row per pair of factors."""
    linked = {frozenset((r["a"], r["b"])) for r in corr.where(F.abs("corr") > limit).collect()}
    kept: list[str] = []
    for name in ranked:
        if all(frozenset((name, other)) not in linked for other in kept):
            kept.append(name)
    return kept


def deciles(df: DataFrame, x: str, y: str, buckets: int = 10) -> DataFrame:
    """Mean of ``y`` per quantile bucket of ``x`` (equal edges merged), with a check that the means rise."""
    pair = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    names = {f"_e{i}": i / buckets for i in range(buckets + 1)}
    edges = quantiles(pair, [], x, names).select(F.array_distinct(F.array(*names)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(x))) - 1
    means = (
        pair.withColumn("_edges", edges.scalar())
        .groupBy(F.greatest(below, F.lit(0)).alias("bucket"))
        .agg(F.avg(y).alias("mean"), F.count("*").alias("n"))
    )
    table = means.agg(F.sort_array(F.collect_list(F.struct("bucket", "mean"))).alias("_m"))  # at most ``buckets`` items
    pairs = F.zip_with(
        F.slice("_m", 1, F.size("_m") - 1), F.slice("_m", F.lit(2), F.size("_m") - 1), lambda a, b: a["mean"] <= b["mean"]
    )
    rising = table.select(F.forall(pairs, lambda ok: ok))
    spread = table.select(F.element_at("_m", -1)["mean"] - F.element_at("_m", 1)["mean"])
    return means.withColumn("monotone", rising.scalar()).withColumn("top_minus_bottom", spread.scalar())
