"""Event statistics: bootstrap intervals, effect tests, profiles, correlation tables, variance forecasts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions import ts
from barline.functions.scalar import beta_of, corr_of, hash_unit
from barline.plans.blocks import in_blocks, number_rows, running
from barline.plans.ranks import average_ranks
from barline.session import cut


# How many of 2^32 equally likely numbers stand for a Poisson(1) weight of at most 0, 1, 2, ...: cumulative chances, rounded.
POISSON = np.array([round(4294967296 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(11)])


def _scrambled(x: np.ndarray) -> np.ndarray:
    """32-bit numbers from others, each bit depending on all: shifts, exclusive ors and products that stay below 2^63, as any engine has them."""
    x = x ^ (x >> 16)
    x = (x * 569420461) & 0xFFFFFFFF
    x = x ^ (x >> 15)
    x = (x * 1935289751) & 0xFFFFFFFF
    return x ^ (x >> 15)


def resample_numbers(seed: np.ndarray, item: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """A number below 2^32 for each (row, resample)."""
    first = _scrambled((item + seed * 48271 + 1) & 0xFFFFFFFF)
    return _scrambled((first[:, None] + reps[None, :] * 630360016) & 0xFFFFFFFF)


def resampled_sums(rows: DataFrame, keys: Sequence[str], reps: int) -> DataFrame:
    """keys, num, den: for each resample the weighted sum of ``_v`` and the sum of the weights, as arrays; a row for each key and batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(reps, dtype=np.int64)
        for batch in batches:
            seed, item, value = (batch.column(len(keys) + i).to_numpy() for i in range(3))
            own = pa.Table.from_batches([batch]).select(range(len(keys)))
            code = np.zeros(len(item), np.int64)
            for i in range(len(keys)):
                code = code * (len(item) + 1) + own.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                code = np.unique(code, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(order) else order
            sums: list[list] = [[], []]
            for a, b in zip(starts, [*starts[1:], len(order)]):
                num, den = np.zeros(reps), np.zeros(reps, np.int64)
                for i in range(a, b, 64):
                    k = order[i : min(b, i + 64)]
                    weight = np.searchsorted(POISSON, resample_numbers(seed[k], item[k], every), side="right")
                    num += value[k] @ weight
                    den += weight.sum(axis=0)
                sums[0].append(num.tolist())
                sums[1].append(den.tolist())
            names = own.take(pa.array(order[starts])).columns
            yield from pa.Table.from_arrays([*names, pa.array(sums[0], pa.list_(pa.float64())), pa.array(sums[1], pa.list_(pa.int64()))], [*keys, "num", "den"]).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.select(*keys, "_seed", "_i", "_v").mapInArrow(run, f"{schema}{', ' if schema else ''}num array<double>, den array<long>")


def bootstrap_ci(
    events: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], reps: int = 10_000, alpha: float = 0.05, seed: Column | int = 7
) -> DataFrame:
    """Percentile interval of the mean over ``reps`` resamples per key; null below three values.

    A resample gives every row a Poisson(1) weight, the number of times it would be drawn, from a hash of (seed, resample, position of the row in its
    key), hence the same after a retry. The weights are drawn and summed where the rows are: no join, and only a weighted sum for each key and
    resample is shuffled. A resample in which all weights are zero has no mean and does not count.
    """
    keys = list(keys)
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    known = number_rows(events.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v"), seed_col.cast("bigint").alias("_seed")), keys, order, pos="_i")
    sums = resampled_sums(known, keys, reps).select(*keys, F.posexplode(F.arrays_zip("num", "den")).alias("_rep", "_s"))
    means = sums.groupBy(*keys, "_rep").agg((F.sum("_s.num") / F.when(F.sum("_s.den") > 0, F.sum("_s.den"))).alias("_m"))
    edges = means.groupBy(*keys).agg(  # ``reps`` numbers per key
        F.percentile("_m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("ci_high")
    )
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = sizes.join(edges, keys, "left") if keys else edges.withColumn("_n", sizes.scalar())
    enough = F.col("_n") >= 3
    return joined.select(*keys, F.when(enough, F.col("ci_low")).alias("ci_low"), F.when(enough, F.col("ci_high")).alias("ci_high"))


def effect_pieces(events: DataFrame, name: str, order: Sequence[str], split: float = 0.7) -> DataFrame:
    """Event rows tagged with their pieces: full, and early or late by position in time."""
    numbered = cut(number_rows(events, [name], order, pos="_p"))
    sizes = numbered.groupBy(name).agg(F.count("*").alias("n_events"))
    early, late = f"early_{int(split * 100)}pct", f"late_{int((1 - split) * 100)}pct"
    side = F.when(F.col("_p") < F.floor(F.col("n_events") * F.lit(split)), early).otherwise(late)
    return numbered.join(sizes, name).withColumn("piece", F.explode(F.array(F.lit("full"), side)))


def piece_seed(seed: int = 7) -> Column:
    piece = F.col("piece")
    return F.when(piece == "full", seed).when(piece.startswith("early"), seed + 1).otherwise(seed + 2)


def effect_test(
    events: DataFrame, name: str, value: str, order: Sequence[str], cost: float, split: float = 0.7, reps: int = 10_000
) -> DataFrame:
    """Is the mean event return non-zero with the same sign early and late, and at least twice the cost?

    One row per effect; effects with fewer than ten events are not testable.
    """
    known = events.where(F.col(value).isNotNull())
    pieces = cut(effect_pieces(known, name, order, split))
    stats = pieces.groupBy(name, "piece").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive"), F.max("n_events").alias("n_events")
    )
    ci = bootstrap_ci(pieces, [name, "piece"], value, order, reps, seed=piece_seed())
    rows = stats.join(ci, [name, "piece"]).withColumn(
        "excludes_zero", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))
    )

    def of(piece: str, column: str) -> Column:
        return F.max(F.when(F.col("piece").startswith(piece), F.col(column)))

    wide = rows.groupBy(name).agg(
        F.max("n_events").alias("n"), of("full", "mean").alias("mean"), of("early", "mean").alias("early_mean"), of("late", "mean").alias("late_mean"),
        of("full", "ci_low").alias("ci_low"), of("full", "ci_high").alias("ci_high"), of("full", "positive").alias("positive"),
        of("early", "excludes_zero").alias("_e"), of("late", "excludes_zero").alias("_l"),
    )
    testable = F.col("n") >= 10
    confirmed = testable & F.coalesce(F.col("_e") & F.col("_l") & (F.signum("early_mean") == F.signum("late_mean")), F.lit(False))
    pays = F.abs("mean") >= 2 * cost
    reason = (
        F.when(~testable, "fewer than 10 events; not testable").when(~confirmed, "failed split-sample confirmation").when(~pays, "effect smaller than 2x round-trip cost")
    )
    return wide.select(
        name, "n", "mean", "early_mean", "late_mean", "ci_low", "ci_high", "positive", confirmed.alias("confirmed"),
        pays.alias("exceeds_cost"), F.when(confirmed & pays, "SURVIVES").otherwise("DROPPED").alias("verdict"), reason.alias("drop_reason"),
    )


def car_profile(windows: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean return per offset around events and its running sum; a key has one row per offset."""
    means = windows.groupBy(*keys, "offset").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("events"))
    path = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return means.withColumn("car", F.sum("mean_ret").over(path))


# Coefficients of the rational approximation of the normal quantile (relative error below 1.2e-9).
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution as a column expression."""
    q = p - 0.5
    middle = _poly(q * q, _A) * q / _poly(q * q, [*_B, 1.0])
    low_z = F.sqrt(-2 * F.ln(F.least(p, F.lit(0.5))))
    high_z = F.sqrt(-2 * F.ln(F.least(1 - p, F.lit(0.5))))
    low = _poly(low_z, _C) / _poly(low_z, [*_D, 1.0])
    high = -_poly(high_z, _C) / _poly(high_z, [*_D, 1.0])
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(middle)


def sharpe_hurdle(trials: Column, observations: Column, periods: float = 252.0) -> dict[str, Column]:
    """Standard error of a Sharpe ratio and the best of ``trials`` expected without any edge."""
    gamma = 0.5772156649
    n = F.greatest(F.lit(2), trials)
    error = F.sqrt(F.lit(periods) / F.greatest(F.lit(1), observations))
    z = (1 - gamma) * normal_quantile(1 - 1 / n) + gamma * normal_quantile(1 - 1 / (n * math.e))
    return {"sharpe_error": error, "expected_best": z * error}


def lag_corr(rows: DataFrame, x: str, lags: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Pearson, Spearman, slope, r2 and t of ``x`` against the next return 0..``lags`` rows later.

    As in the surveyed analysis the last row of a series has a next return of 0. Below three pairs, or when a
    side is constant, all values are 0.
    """
    keys = list(keys)

    def add(r: DataFrame, w) -> DataFrame:
        r = r.withColumn("_f", F.coalesce(F.lead("close").over(w) / F.col("close") - 1, F.lit(0.0)))
        pairs = [F.struct(F.lit(i).alias("lag"), (F.lead("_f", i).over(w) if i else F.col("_f")).alias("y")) for i in range(lags + 1)]
        cols = {f"_y{i}": p for i, p in enumerate(pairs)}
        return r.withColumns(cols)

    wide = in_blocks(rows, add, fwd=lags + 1, keys=keys)
    long = wide.select(*keys, F.col(x).alias("x"), F.explode(F.array(*[f"_y{i}" for i in range(lags + 1)])).alias("_p")).select(
        *keys, "x", "_p.lag", "_p.y"
    ).where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_ranks(long, [*keys, "lag"], {"_rx": "x", "_ry": "y"}, pct=False)
    fit = ranked.groupBy(*keys, "lag").agg(
        corr_of(F.col("x"), F.col("y")).alias("_p"), corr_of(F.col("_rx"), F.col("_ry")).alias("_s"), beta_of(F.col("y"), F.col("x")).alias("_b"), F.count("*").alias("n")
    )
    fine = (F.col("n") >= 3) & F.col("_p").isNotNull()
    zero = F.lit(0.0)
    pick = lambda c: F.when(fine, c).otherwise(zero)
    r = F.col("_p")
    t = F.try_divide(r * F.sqrt(F.col("n") - 2), F.sqrt(F.greatest(1 - r * r, zero)))
    return fit.select(*keys, "lag", "n", pick(r).alias("pearson"), pick(F.coalesce("_s", zero)).alias("spearman"), pick(F.col("_b")).alias("slope"), pick(r * r).alias("r2"), pick(F.coalesce(t, zero)).alias("t_stat"))


def conditional_means(rows: DataFrame, score: str, fwd: str, keys: Sequence[str], edge: float = 0.1) -> DataFrame:
    """Rows and mean forward return by the sign of a score."""
    s = F.col(score)
    tone = F.when(s > edge, "bullish").when(s < -edge, "bearish").otherwise("neutral")
    return rows.groupBy(*keys, tone.alias("tone")).agg(F.count("*").alias("n"), F.coalesce(F.avg(fwd), F.lit(0.0)).alias("mean_fwd"))


def _class_sums(actual: str, predicted: str, labels: Sequence[str], tag: str = "") -> list[Column]:
    """Sums over rows of (actual, predicted, n): hits, and for each label the rows that have it on both sides, as truth and as prediction."""
    a, p, n = F.col(actual), F.col(predicted), F.col("n")
    some = lambda ok, name: F.sum(F.when(ok, n).otherwise(0)).alias(f"_{tag}{name}")
    out = [some(a == p, "hit")]
    for i, label in enumerate(labels):
        out += [some((a == label) & (p == label), f"tp{i}"), some(a == label, f"a{i}"), some(p == label, f"p{i}")]
    return out


def _class_scores(labels: Sequence[str], tag: str = "", prefix: str = "") -> list[Column]:
    """Accuracy, balanced accuracy and macro precision, recall and F1 from the sums; a zero division is 0."""
    at = lambda name: F.col(f"_{tag}{name}")
    safe = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    k = range(len(labels))
    precision, recall = [safe(at(f"tp{i}"), at(f"p{i}")) for i in k], [safe(at(f"tp{i}"), at(f"a{i}")) for i in k]
    f1 = [safe(2.0 * at(f"tp{i}"), at(f"a{i}") + at(f"p{i}")) for i in k]
    present = sum((at(f"a{i}") > 0).cast("int") for i in k)
    named = {
        "accuracy": at("hit") / F.col("samples"), "balanced_accuracy": sum(recall) / F.greatest(present, F.lit(1)), "macro_precision": sum(precision) / len(labels),
        "macro_recall": sum(recall) / len(labels), "macro_f1": sum(f1) / len(labels),
    }
    return [c.alias(prefix + name) for name, c in named.items()]


def class_metrics(rows: DataFrame, actual: str, predicted: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and macro precision, recall and F1, all from the confusion counts."""
    keys = list(keys)
    table = rows.groupBy(*keys, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sums = table.groupBy(*keys).agg(F.sum("n").alias("samples"), *_class_sums("a", "p", labels))
    return sums.select(*keys, "samples", *_class_scores(labels))


def joint_metrics(rows: DataFrame, targets: Mapping[str, tuple[str, str, Sequence[str]]], keys: Sequence[str] = ()) -> DataFrame:
    """Class metrics of several targets of the same rows, the share of rows on which all are right, and how often each label occurs.

    ``targets`` names (actual column, predicted column, labels). Columns: keys, samples, the five metrics of each target with its name in front,
    joint_accuracy, and for each target the maps ``<name>_actual`` and ``<name>_predicted`` from label to rows. Rows are counted by their
    combination of labels first, so that a key of any size is a handful of rows when it is brought together. A null label is never right and counts
    for no label. Without rows a table without keys holds one row of zero samples and null ratios.
    """
    keys = list(keys)
    pairs = [F.col(c).alias(f"_{side}_{name}") for name, t in targets.items() for side, c in zip("ap", t)]
    table = rows.select(*keys, *pairs).groupBy(*keys, *[f"_{side}_{name}" for name in targets for side in "ap"]).agg(F.count("*").alias("n"))
    right = F.lit(True)
    for name in targets:
        right = right & F.coalesce(F.col(f"_a_{name}") == F.col(f"_p_{name}"), F.lit(False))
    parts = [c for name, t in targets.items() for c in _class_sums(f"_a_{name}", f"_p_{name}", t[2], f"{name}_")]
    sums = table.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("_joint"), *parts)
    out = [c for name, t in targets.items() for c in _class_scores(t[2], f"{name}_", f"{name}_")]
    seen = lambda name, side, labels: F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.col(f"_{name}_{side}{i}") for i in range(len(labels))]))
    maps = [seen(name, side, t[2]).alias(f"{name}_{word}") for name, t in targets.items() for side, word in (("a", "actual"), ("p", "predicted"))]
    return sums.select(*keys, "samples", *out, (F.col("_joint") / F.col("samples")).alias("joint_accuracy"), *maps)


def signal_quality(rows: DataFrame, taken: Column, actual: str, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and coverage of long signals against bullish outcomes."""
    good = F.col(actual) == "bullish"
    both, n_taken, n_good = F.count_if(taken & good), F.count_if(taken), F.count_if(good)
    safe = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        safe(both, n_taken).alias("precision"), safe(both, n_good).alias("recall"), (n_taken / F.count("*")).alias("coverage"), F.count("*").alias("n")
    )


def stitch_returns(panel: DataFrame, change: str) -> DataFrame:
    """Index return from the first of three sources: direct, inverse and leveraged ones with dated leverage.

    ``panel`` has ts and the returns r_direct, r_inverse, r_double.
    """
    late = F.col("ts") >= F.lit(change).cast("timestamp")
    inverse = -F.col("r_inverse") / F.when(late, 0.5).otherwise(1.0)
    double = F.col("r_double") / F.when(late, 1.5).otherwise(2.0)
    direct = F.col("r_direct")
    source = F.when(direct.isNotNull(), "direct").when(double.isNotNull(), "double").when(inverse.isNotNull(), "inverse")
    return panel.select("ts", F.coalesce(direct, double, inverse).alias("ret"), source.alias("source"), direct.alias("direct"), inverse.alias("inverse"), double.alias("double"))


def leverage_check(stitched: DataFrame, min_rows: int = 60) -> DataFrame:
    """Beta and correlation of each derived series against the direct one; beta within 0.15 of 1 reads as expected."""
    item = F.array(F.struct(F.lit("inverse").alias("source"), F.col("inverse").alias("y")), F.struct(F.lit("double").alias("source"), F.col("double").alias("y")))
    long = stitched.select(F.col("direct").alias("x"), F.explode(item).alias("i")).select("x", "i.*").where("x IS NOT NULL AND y IS NOT NULL")
    fit = long.groupBy("source").agg(F.count("*").alias("overlap"), beta_of(F.col("y"), F.col("x")).alias("beta"), corr_of(F.col("y"), F.col("x")).alias("correlation"))
    return fit.where(F.col("overlap") >= min_rows).withColumn("as_expected", F.abs(F.col("beta") - 1) < 0.15)


# Lags of the daily, weekly and monthly variance in the forecast.
HAR_LAGS = (1, 5, 22)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve the 4x4 normal equations of a batch of refit rows."""
    for pdf in batches:
        if len(pdf):
            gram = np.array(pdf["gram"].tolist(), dtype=float).reshape(-1, 4, 4)
            moment = np.array(pdf["moment"].tolist(), dtype=float).reshape(-1, 4, 1)
            # The pseudo-inverse also covers singular systems, as a least-squares solver does.
            pdf["coef"] = list((np.linalg.pinv(gram, hermitian=True) @ moment)[:, :, 0])
        else:
            pdf["coef"] = pd.Series([], dtype=object)
        yield pdf.drop(columns=["gram", "moment"])


def har_forecast(
    returns: DataFrame, keys: Sequence[str] = ("symbol",), horizon: int = 21, label_lag: int | None = None, min_train: int = 504, refit_every: int = 21
) -> DataFrame:
    """Walk-forward least-squares forecast of the mean variance over the next ``horizon`` rows.

    ``label_lag`` is how many rows old a target must be to be fitted on. The default, ``horizon``, only uses closed
    targets; 1 reproduces the surveyed code, which also fits on targets that reach past the forecast row.
    The normal equations are running sums, so a fit needs no look at earlier rows.
    """
    keys = list(keys)
    lag = horizon if label_lag is None else label_lag

    def design(rows: DataFrame, w) -> DataFrame:
        made = {f"_x{n}": (F.col("ret") * F.col("ret") * 252.0 if n == 1 else ts.realized_variance("ret", n, w)) for n in HAR_LAGS}
        ahead = w.rowsBetween(1, horizon)
        target = F.when(F.count("ret").over(ahead) == horizon, F.avg(F.col("ret") * F.col("ret")).over(ahead) * 252.0)
        return rows.withColumns(made | {"actual": target})

    reach = max(HAR_LAGS)
    rows = in_blocks(returns.where("ret IS NOT NULL"), design, back=reach, fwd=horizon, keys=keys)
    rows = cut(rows.where(F.col(f"_x{reach}").isNotNull()))
    x = [F.lit(1.0), *[F.col(f"_x{n}") for n in HAR_LAGS]]
    usable = F.col("actual").isNotNull()
    sums = {f"_g{i}{j}": ("sum", F.when(usable, x[i] * x[j]).otherwise(0.0)) for i in range(4) for j in range(i, 4)}
    sums |= {f"_m{i}": ("sum", F.when(usable, x[i] * F.col("actual")).otherwise(0.0)) for i in range(4)}
    totals = running(rows, sums, keys=keys)
    names = list(sums)

    def delayed(r: DataFrame, w) -> DataFrame:
        late = r.withColumns({f"{n}_d": F.lag(n, lag).over(w) for n in names}).drop(*names)
        ready = F.col("_g00_d") >= min_train
        first = ready & ~F.coalesce(F.lag("_g00_d").over(w) >= min_train, F.lit(False))
        return late.withColumn("refit", ready & (first | ((F.col("pos") - F.lit(reach - 1)) % refit_every == 0)))

    marked = cut(in_blocks(totals, delayed, back=lag + 1, keys=keys))
    gram = F.array(*[F.col(f"_g{min(i, j)}{max(i, j)}_d") for i in range(4) for j in range(4)])
    fits = marked.where("refit").select(*keys, "pos", gram.alias("gram"), F.array(*[F.col(f"_m{i}_d") for i in range(4)]).alias("moment"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.schema.fields if f.name not in ("gram", "moment"))
    solved = fits.mapInPandas(_solve, f"{types}, coef array<double>")
    joined = marked.join(solved, [*keys, "pos"], "left")
    carried = running(joined, {"_coef": ("last", F.col("coef"))}, keys=keys)
    value = sum(F.get("_coef", F.lit(i)) * x[i] for i in range(4))
    return carried.select(
        *keys, "ts", "pos", F.when(F.col("_coef").isNotNull(), F.greatest(value, F.lit(1e-6))).alias("forecast"), "actual", F.coalesce("refit", F.lit(False)).alias("refit")
    )


def har_diagnostics(forecast: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Out-of-sample correlation, RMSE, bias, and whether the RMSE beats that of the expanding mean."""
    keys = list(keys)
    both = cut(forecast.where("forecast IS NOT NULL AND actual IS NOT NULL"))
    prior = running(both, {"_s": ("sum", F.col("actual")), "_n": ("count", F.col("actual"))}, keys=keys, inclusive=False)
    base = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    err, base_err = F.col("forecast") - F.col("actual"), base - F.col("actual")
    own = F.when(base.isNotNull(), err * err)
    return prior.groupBy(*keys).agg(
        F.count("*").alias("rows"), corr_of(F.col("forecast"), F.col("actual")).alias("correlation"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"),
        (F.avg(own) < F.avg(base_err * base_err)).alias("beats_mean"),
    ).where(F.col("rows") > 30)
