"""Sinks and parameterised reads: summary snapshots, JSON output, SQL args."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def param_query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None,
                **frames: DataFrame) -> DataFrame:
    """IO4: run SQL with named parameters (``:name``) bound as literals —
    never string-formatted — and DataFrames passed as ``{name}`` sources."""
    return spark.sql(sql, args=args or {}, **frames)


def fetch_scalar(df: DataFrame):
    """IO4 scalar form: the first column of the first row (None if empty)."""
    r = df.first()
    return None if r is None else r[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a saved table is there; any error but a missing path is raised."""
    try:
        spark.read.parquet(path).schema  # noqa: B018  reads the footer
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def with_snapshot_columns(payload: DataFrame) -> DataFrame:
    """IO6: add a random id and the snapshot time to a payload row."""
    return payload.select(F.expr("uuid()").alias("id"),
                          F.current_timestamp().alias("snapshot_ts"), "*")


def append_snapshot(payload: DataFrame, path: str) -> DataFrame:
    """IO6: append the payload as a snapshot row, partitioned by day (the
    reference indexes snapshots by time; day partitions give the same
    pruning for "latest snapshot" reads).  Returns the written rows."""
    snap = with_snapshot_columns(payload).withColumn("snapshot_date", F.to_date("snapshot_ts"))
    snap.write.mode("append").partitionBy("snapshot_date").parquet(path)
    return payload.sparkSession.read.parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Most recent snapshot row (a top-1 report)."""
    return spark.read.parquet(path).orderBy(F.col("snapshot_ts").desc()).limit(1)


def to_json_lines(payload: DataFrame, col: str = "payload") -> DataFrame:
    """IO8: the payload serialised as one JSON string per row (NULL fields dropped)."""
    return payload.select(F.to_json(F.col(col)).alias("json"))
