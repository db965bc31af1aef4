"""Skew-safe order helpers against plain windows, with one group holding a
third of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.functions.sequence import prefix_sum


def _skewed(spark, n=30000):
    # Group 7 holds a third of the rows; the others are small.
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 997).alias("g"),
        ((F.col("id") * 7919) % 1000003).alias("t"),
        (F.col("id") % 5).alias("v"))


def test_prefix_sum_matches_window(spark):
    df = _skewed(spark)
    got = prefix_sum(df, ["t", "k"], "v", "ps", parts=16)
    w = Window.orderBy("t", "k").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
    bad = got.join(ref.select("k", "ref"), "k").where(F.col("ps") != F.col("ref"))
    assert bad.count() == 0
