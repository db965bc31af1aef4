"""Order-dependent helpers that stay distributed when one group is huge.

``Window.partitionBy(k).orderBy(...)`` sends a whole group to one task, and
``Window.orderBy(...)`` without a partition sends everything to one task.
These helpers instead range-partition on the full sort key (which splits a
hot group over many partitions), work within each partition, and repair
partition boundaries with a table that has one row per partition — a size
bound that does not grow with the data, so it is safe to broadcast.

The frame that carries the partition ids is materialised once with a
reliable ``checkpoint()`` (in ``spark.checkpoint.dir``): range bounds come
from a sample seeded by the RDD id, so two executions of the same exchange
could cut differently, and every branch must see the same partition ids.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.session import checkpoint_dir


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def range_partitioned(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``order`` with a stable ``_pid`` column."""
    checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(_parts(df, parts), *order)
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))


def prefix_sum(df: DataFrame, order: Sequence[str], value: str, out: str,
               inclusive: bool = False, parts: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows before this one in ``order``
    (``order`` must be unique per row); ``inclusive`` adds the row itself."""
    r = range_partitioned(df, order, parts)
    w = (Window.partitionBy("_pid").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumn("_local", F.sum(value).over(w))
    # One row per partition: the offset is the total of all earlier partitions.
    totals = r.groupBy("_pid").agg(F.sum(value).alias("_ptotal"))
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_ptotal").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         .alias("_offset"))
    res = local.join(F.broadcast(offsets), "_pid", "left")
    incl = F.col("_offset") + F.col("_local")
    val = incl if inclusive else incl - F.col(value)
    return res.withColumn(out, val).drop("_pid", "_local", "_offset")
