"""The network trained in arrays against Spark ML's own trainer."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barline.operators import models, networks


def _rows(spark, n, parts=1):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(float)
    rows = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a array<double>, label double")
    return rows.repartition(parts).withColumn("features", array_to_vector("a"))


def test_network_equals_sparks_trainer(spark):
    """Over whole blocks of 128 rows both weight rows the same, so start, loss, gradient and steps are held against Spark's."""
    rows = _rows(spark, 1280).coalesce(1).cache()
    for steps, near in ((0, 1e-12), (1, 1e-9), (25, 1e-5)):
        net = MultilayerPerceptronClassifier(layers=[3, 8, 5, 2], maxIter=steps, seed=42)
        ours, theirs = networks.fit_network(rows, net, ["id"], task_rows=300).weights.toArray(), net.fit(rows).weights.toArray()
        assert np.abs(ours - theirs).max() < near * max(1.0, np.abs(theirs).max())


def test_network_does_not_depend_on_partitions(spark):
    """A partition of 129 rows made its last row count as much as the 128 before it."""
    net = MultilayerPerceptronClassifier(layers=[3, 8, 2], maxIter=15, seed=42)
    a, b = (networks.fit_network(_rows(spark, 1290, p), net, ["id"], task_rows=200).weights.toArray() for p in (1, 10))
    assert np.abs(a - b).max() < 1e-9


def test_meta_model_fits_outside_the_jvm_trainer(spark):
    """A step is one pass in arrays over the kept blocks: no count or treeAggregate of Spark's own optimizer over all rows."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"S{i % 7}", i, float(x), int(x > 0)) for i, x in enumerate(rng.normal(size=600))], "symbol string, ts long, f double, label int")
    model = models.fit_meta(rows, ["f"])
    assert model.stages[1].getMaxIter() == 0  # the weights were found before
    hit = models.predict_meta(model, rows, ["f"]).where((F.col("probability") > 0.5) == (F.col("label") == 1)).count()
    assert hit > 570
