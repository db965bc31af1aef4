"""A written subscription base that grows by committed batches (IO7).

Layout of a table's folder::

    rows/attempt=<uuid>/Churn=<value>/   one write of a batch, sorted by customerID
    commits/                             one row per commit: batch_id, attempt, version, n_rows

A batch's rows are written to a folder of their own first; Spark's committer
moves finished files there, and nothing reads them yet.  Then one row is added
to the commit log, which makes them visible: readers take, of each batch, the
attempt of its latest commit.  So a job that dies before the commit leaves no
trace in the table, a batch sent again replaces itself, and batches of other
ids never touch each other's files.

``Churn`` and the attempt are partition columns: ``Churn = 'Yes'`` prunes
folders, the join with the commit log prunes attempts at run time, and
``customerID`` ranges prune row groups.  Rows keep ``SUBSCRIPTION_SCHEMA``
exactly; anything else is refused before it is written.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnscope.sources.subscriptions import SUBSCRIPTION_COLUMNS, SUBSCRIPTION_SCHEMA

COMMITS = "batch_id string, attempt string, version long, n_rows long"


def checked(df: DataFrame) -> DataFrame:
    """The base's columns in their order; raises if one is missing, added or of another type."""
    wanted = StructType.fromDDL(SUBSCRIPTION_SCHEMA)
    have = {f.name: f.dataType for f in df.schema}
    if len(have) < len(df.schema):
        raise ValueError("a batch must not repeat a column name")
    wrong = [f"{f.name} is {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}"
             for f in wanted if have.get(f.name) != f.dataType]
    wrong += [f"{name} does not belong to the base" for name in have if name not in SUBSCRIPTION_COLUMNS]
    if wrong:
        raise ValueError("the batch does not fit the base: " + "; ".join(wrong))
    return df.select(*SUBSCRIPTION_COLUMNS)


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The commit log; empty where no batch was ever committed."""
    try:
        return spark.read.schema(COMMITS).parquet(os.path.join(path, "commits"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, attempt, version, n_rows) of each batch's latest commit."""
    last = F.max(F.struct("version", "attempt", "n_rows")).alias("c")
    return _log(spark, path).groupBy("batch_id").agg(last).select("batch_id", "c.attempt", "c.version", "c.n_rows")


def stage_batch(df: DataFrame, path: str) -> tuple[str, int]:
    """Write the rows of a batch where no reader sees them yet; returns the attempt and its number of rows."""
    attempt = uuid.uuid4().hex
    folder = os.path.join(path, "rows", f"attempt={attempt}")
    # a folder name cannot tell a blank from a NULL, so a blank fails the write
    told = F.when(F.trim("Churn") == "", F.raise_error(F.lit("the batch has blank values of Churn"))).otherwise(F.col("Churn"))
    (checked(df).withColumn("Churn", told).repartitionByRange("customerID").sortWithinPartitions("customerID")
     .write.partitionBy("Churn").parquet(folder))
    return attempt, df.sparkSession.read.schema(SUBSCRIPTION_SCHEMA).parquet(folder).count()  # from the files' footers


def commit_batch(spark: SparkSession, path: str, batch_id: str, attempt: str, n_rows: int) -> None:
    """Make a staged batch visible, in place of any earlier attempt at it."""
    version = _log(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    spark.createDataFrame([(batch_id, attempt, version, n_rows)], COMMITS).coalesce(1).write.mode("append").parquet(
        os.path.join(path, "commits"))


def append_batch(df: DataFrame, path: str, batch_id: str) -> int:
    """IO7: add the rows of ``df`` to the base as batch ``batch_id``; returns their number.

    Sent again, a batch replaces itself.  An empty batch is a commit of no rows.
    """
    if not batch_id:
        raise ValueError("a batch needs an id")
    attempt, n = stage_batch(df, path)
    commit_batch(df.sparkSession, path, batch_id, attempt, n)
    return n


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows of the base, each batch as of its latest commit."""
    live = batches(spark, path).filter("n_rows > 0").select("attempt")
    if live.isEmpty():
        return spark.createDataFrame([], SUBSCRIPTION_SCHEMA)
    rows = spark.read.schema(StructType.fromDDL(SUBSCRIPTION_SCHEMA).add("attempt", "string")).parquet(os.path.join(path, "rows"))
    return rows.join(live, "attempt", "left_semi").select(*SUBSCRIPTION_COLUMNS)
