"""Model queries (M01 - M04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.scalar import hash_unit
from barline.operators import labels, models
from barline.queries import fixtures as fx
from barline.queries.registry import query, view
from barline.queries.tables import r6
from barline.session import cut, written


@query("wf_logreg")
def wf_logreg(spark, d):
    """Walk-forward logistic regression on the technical features of all suppliers."""
    rows = labels.technical_features(fx.bars(spark, d)).withColumn("pos", F.col("pos") - 20)
    return models.walk_forward_fit(rows, labels.TECHNICAL, train=120, step=60).select("symbol", "ts", "label", F.round("probability", 4).alias("probability"), "signal")


@query("meta_model")
def meta_model(spark, d):
    """Feed-forward meta-model trained on the first 60 % of weeks and applied to the rest."""
    from barline.queries.crosssection import week_calendar

    rows = written(labels.technical_features(fx.bars(spark, d)), "features")
    period = labels.period_of(week_calendar(rows)).select("ts", "period")
    rows = rows.join(period, "ts")
    model = models.fit_meta(rows.where("period = 'train'"), labels.TECHNICAL)
    out = models.predict_meta(model, rows.where("period <> 'train'"), labels.TECHNICAL)
    return out.select("symbol", "ts", "label", F.round("probability", 4).alias("probability"))


@query("fused_model")
def fused_model(spark, d):
    """Embedding plus vector length; class = label % 3, sector = label % 4, trained on the lower 70 % of ids per class."""
    rows = fx.table(spark, d, "embeddings").select(
        "vec_id", "embedding", (F.col("label") % 3).cast("double").alias("label"), (F.col("label") % 4).alias("sector"),
        F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
    )
    rows = cut(rows.withColumn("edge", rows.agg(F.max("vec_id") * 0.7).scalar()))
    out = models.fit_fused(rows.where("vec_id <= edge").drop("edge"), rows.where("vec_id > edge").drop("edge"), "embedding", ["norm"])
    return out.select("vec_id", "label", "sector", "direction", F.round("confidence", 4).alias("confidence"), "strength")


def _u(h: str, c: str) -> str:
    return f"('0x' || substr(md5({h} || '|' || symbol || '|' || pos || '|{c}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


view("probs", "bars", f"""
SELECT symbol, ts, h, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM (
  SELECT symbol, ts, h, {_u('h', 'bearish')} AS a, {_u('h', 'neutral')} AS b, {_u('h', 'bullish')} AS c FROM bars CROSS JOIN (SELECT unnest([1, 3, 5]) AS h))""")


@query("horizon_ensemble", "probs", """
WITH s AS (SELECT symbol, ts, sum(w * p0) AS b, sum(w * p1) AS n, sum(w * p2) AS u FROM (SELECT *, CASE h WHEN 1 THEN 0.2::DOUBLE WHEN 3 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS w FROM probs) GROUP BY 1, 2)
SELECT symbol, ts, round(b, 6) AS bearish_prob, round(n, 6) AS neutral_prob, round(u, 6) AS bullish_prob, round(greatest(b, n, u), 6) AS confidence, CASE WHEN b = greatest(b, n, u) THEN 'bearish' WHEN n = greatest(b, n, u) THEN 'neutral' ELSE 'bullish' END AS direction FROM s""")
def horizon_ensemble(spark, d):
    """Class probabilities per bar and horizon come from hashes and are then combined over the horizons."""
    rows = fx.bars(spark, d).select("symbol", "ts", "pos", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("horizon"))
    draw = lambda c: hash_unit(F.col("horizon"), F.col("symbol"), F.col("pos"), F.lit(c))
    rows = rows.select("symbol", "ts", "horizon", *[draw(c).alias(c) for c in models.CLASSES])
    total = sum(F.col(c) for c in models.CLASSES)
    probs = rows.select("symbol", "ts", "horizon", F.array(*[F.col(c) / total for c in models.CLASSES]).alias("p"))
    out = models.horizon_ensemble(probs, ["symbol", "ts"])
    return out.select("symbol", "ts", *r6(*[f"{c}_prob" for c in models.CLASSES], "confidence"), "direction")
