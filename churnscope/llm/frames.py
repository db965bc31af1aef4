"""Small DataFrame helpers of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.session import checkpoint_dir

#: Ids that may be sent to every executor: about 16 MB.
BROADCAST_IDS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """The frame computed once and written to the shared checkpoint folder.

    Spark deletes shuffle and checkpoint files of frames that nobody refers to
    once the driver's JVM has collected them, which a driver with little to do
    may put off for half an hour.  So each step asks for that: files of
    finished steps are gone before the next ones are written.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    spark.sparkContext._jvm.System.gc()
    return out


def with_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose id is (left_semi) or is not (left_anti) among the distinct ``ids``.

    The ids are broadcast only when counted to be at most ``BROADCAST_IDS``;
    else both sides are shuffled.  ``ids`` should be materialised.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component of ``edges`` (a, b).

    Each round points every node to its smallest neighbour (or itself) and
    contracts the edges to those; rounds are few, since a star collapses in one
    and a path at least halves.  Labels and edges live in checkpoints only.
    """
    spark = edges.sparkSession
    edges = kept(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        smallest = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("to")))
        # a node's target may itself point on: follow it once more; Spark splits the rows of a target that many point to
        onward = smallest.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = kept(smallest.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), F.col("to").alias("new"))
            labels = kept(labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component")))
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        edges = kept(edges.join(to("a"), "a").join(to("b"), "b").filter("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if edges.isEmpty():
            return labels if labels is not None else spark.createDataFrame([], "node long, component long")
