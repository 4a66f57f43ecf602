"""Walk-forward and one-shot classifiers on Spark ML. Fits are distributed; only the list of folds is on the driver.

Numbers differ from other libraries' solvers; nothing here claims equality with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.scalar import choose
from barline.operators.labels import walk_forward
from barline.operators.networks import fit_network
from barline.session import cut

THRESHOLD = 0.55


def classifier(name: str, n_features: int, n_classes: int = 2, seed: int = 42):
    """Logistic regression with class weights, gradient-boosted trees, or a small feed-forward network."""
    common = {"featuresCol": "features", "labelCol": "label", "probabilityCol": "probability", "predictionCol": "prediction"}
    if name == "logistic_regression":
        return LogisticRegression(weightCol="weight", maxIter=100, regParam=1e-3, family="multinomial" if n_classes > 2 else "auto", **common)
    if name == "gradient_boosting":
        return GBTClassifier(maxDepth=3, maxIter=150, stepSize=0.05, minInstancesPerNode=20, seed=seed, **common)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 32, 16, n_classes], maxIter=60, seed=seed, **common)
    raise ValueError(f"unknown model {name}")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight rows so that every class counts the same. The weights, one for each class, are literals: a join on the label would deal all rows to as many tasks as there are classes."""
    sizes = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect()}
    rows = sum(sizes.values())
    weight = choose(F.col(label), {c: rows / (len(sizes) * n) for c, n in sizes.items()}) if sizes else F.lit(None).cast("double")
    return df.where(F.col(label).isNotNull()).withColumn("weight", weight)


def assemble(df: DataFrame, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Numeric columns (missing = 0) and vector columns as one feature vector in name order."""
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    inputs = [*extra, *sorted(features)]
    return VectorAssembler(inputCols=inputs, outputCol="raw").transform(clean)


def fit_scaled(train: DataFrame, model):
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, model]).fit(train)


def walk_forward_fit(
    rows: DataFrame, features: Sequence[str], train: int, step: int, model: str = "logistic_regression", pos: str = "pos", label: str = "label"
) -> DataFrame:
    """Probability of label 1 per row from a model fitted on all rows of earlier positions (all symbols together).

    0.5 before the first fold and where the train rows have a single class; signal = probability >= 0.55.
    """
    keep = ["symbol", "ts", pos, label]
    ready = cut(assemble(walk_forward(rows, train, step, pos), features).select(*keep, "fold", "train_end", "raw"))
    folds = [(r["fold"], r["train_end"]) for r in ready.where("fold IS NOT NULL").select("fold", "train_end").distinct().orderBy("fold").collect()]
    out = ready.where("fold IS NULL").select(*keep, F.lit(0.5).alias("probability"))
    for fold, end in folds:
        past, now = ready.where(F.col(pos) < end), ready.where(F.col("fold") == fold)
        if past.select(label).distinct().count() < 2:
            out = out.unionByName(now.select(*keep, F.lit(0.5).alias("probability")))
            continue
        fitted = fit_scaled(balanced_weights(past, label), classifier(model, len(features)))
        scored = fitted.transform(now).select(*keep, vector_to_array("probability")[1].alias("probability"))
        out = out.unionByName(scored)
    return out.withColumn("signal", (F.col("probability") >= THRESHOLD).cast("int"))


def fit_meta(train: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42, order: Sequence[str] = ("symbol", "ts")):
    """Meta-model on a feature map laid out in name order, missing features = 0."""
    rows = assemble(train, features)
    net = MultilayerPerceptronClassifier(
        layers=[len(features), 64, 32, 2], maxIter=60, seed=seed, featuresCol="features", labelCol=label, probabilityCol="probability"
    )
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    return PipelineModel([scaler, fit_network(scaler.transform(rows), net, list(order))])


def predict_meta(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    scored = model.transform(assemble(df, features))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("probability"))


def confidence_strength(p: Column) -> Column:
    return F.when(p >= 0.55, "high").when(p >= 0.40, "medium").otherwise("low")


def fit_fused(
    train: DataFrame, test: DataFrame, embedding: str, numeric: Sequence[str], sector: str = "sector", min_rows: int = 60, label: str = "label"
) -> DataFrame:
    """Three-class model on embedding plus numeric features: one per sector with enough rows, else the pooled one.

    Labels are 0 bearish, 1 neutral, 2 bullish.
    """
    def ready(df: DataFrame) -> DataFrame:
        vectors = df.withColumn("_vec", array_to_vector(F.col(embedding).cast("array<double>")))
        return cut(assemble(vectors, numeric, ["_vec"]).drop("_vec"))

    past, now = ready(train), ready(test)

    def fit(df: DataFrame):
        return fit_scaled(balanced_weights(df, label), classifier("logistic_regression", 0, 3))

    stats = past.groupBy(sector).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"))
    own = [r[sector] for r in stats.where((F.col("n") >= min_rows) & (F.col("k") >= 2)).orderBy(sector).collect()]
    parts = [(fit(past), ~F.col(sector).isin(*own) if own else F.lit(True))]
    parts += [(fit(past.where(F.col(sector) == s)), F.col(sector) == s) for s in own]
    out = None
    for model, mine in parts:
        probs = vector_to_array("probability")
        scored = model.transform(now.where(mine)).withColumn("_p", probs)
        best = F.array_max("_p")
        name = F.element_at(F.array(F.lit("bearish"), F.lit("neutral"), F.lit("bullish")), F.array_position("_p", best).cast("int"))
        scored = scored.select(*test.columns, name.alias("direction"), best.alias("confidence"), confidence_strength(best).alias("strength"))
        out = scored if out is None else out.unionByName(scored)
    return out


# Class order and weight of each horizon.
CLASSES = ("bearish", "neutral", "bullish")
HORIZON_WEIGHTS = {1: 0.2, 3: 0.3, 5: 0.5}


def horizon_ensemble(probs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum of class probabilities over horizons and the most likely class (first in order on ties).

    ``probs`` has (keys, horizon, p array<double> in class order).
    """
    weight = F.lit(None).cast("double")
    for h, w in HORIZON_WEIGHTS.items():
        weight = F.when(F.col("horizon") == h, F.lit(w)).otherwise(weight)
    sums = probs.groupBy(*keys).agg(*[F.sum(weight * F.get("p", F.lit(i))).alias(f"{c}_prob") for i, c in enumerate(CLASSES)])
    best = F.greatest(*[F.col(f"{c}_prob") for c in CLASSES])
    name = F.when(F.col("bearish_prob") == best, "bearish").when(F.col("neutral_prob") == best, "neutral").otherwise("bullish")
    return sums.withColumn("direction", name).withColumn("confidence", best)
