"""Class weights leave the rows where they are, however few classes there are."""

from pyspark.sql import functions as F

from barline.operators import models


def test_weights_balance_without_dealing_rows_by_label(spark):
    rows = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 4000 != 7, (F.col("id") % 5 == 0).cast("int")).alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = models.balanced_weights(rows)
        per_task = out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        sums = {r.label: r.w for r in out.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["count"] for r in per_task) == [499] + [500] * 7
    assert sums.keys() == {0, 1} and all(abs(w - 3999 / 2) < 1e-6 for w in sums.values())
