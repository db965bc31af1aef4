"""Running metrics with Structured Streaming (ST1, ST2).

The reference re-polls its KPI queries; the Spark form is a streaming
aggregate over a growing file source.  The ``lead`` and global maximum in
the base derivation cannot run on a stream, so the already derived
subscription rows are what streams in (staged as parquet by ``stage_rows``).

* State is a handful of groups (no time windows), so complete output mode
  and no watermark are right: each trigger emits the whole, small result.
* The sink is ``foreachBatch`` that OVERWRITES the result table — replaying
  a batch after a failure rewrites the same rows, so it is idempotent.
* Snapshots (ST2) are appended per batch id with dynamic partition
  overwrite, so a replayed batch replaces its own partition only.
* ``trigger(availableNow=True)`` drains everything present and stops;
  ``maxBytesPerTrigger`` splits it into micro-batches of bounded size, however
  many files there are.  A run that starts again from its checkpoint takes only
  the files added since, and goes on from the state it had.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.scalar import churn_flag, round_fp, safe_div, unknown_if_blank
from churnscope.operators.features import feature_counts, feature_rates, validate_features
from churnscope.session import checkpoint_dir
from churnscope.sources.subscriptions import SUBSCRIPTION_SCHEMA


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), kind, uuid.uuid4().hex)


#: Input bytes of a micro-batch, about; a larger file is a batch of its own.
TRIGGER_BYTES = 512 << 20


def stage_rows(df: DataFrame, path: str, files: int | None = None) -> str:
    """Add derived rows as parquet files to the folder of a file-source stream.

    By default the natural layout is kept (one file per final task, so the
    file count scales with the data); ``files`` forces a count (tests)."""
    (df.repartition(files) if files else df).write.mode("append").parquet(path)
    return path


def kpi_stream(stream: DataFrame) -> DataFrame:
    """K1 as a streaming aggregate (one global group)."""
    a = stream.agg(F.count(F.lit(1)).alias("_total"), F.sum(churn_flag()).alias("_churned"),
                   F.avg("tenure").alias("_t"), F.avg("MonthlyCharges").alias("_m"))
    return a.select(
        F.coalesce(F.col("_churned"), F.lit(0)).cast("long").alias("churned_users"),
        F.coalesce(round_fp(safe_div("_churned", "_total"), 4), F.lit(0.0)).alias("churn_rate_overall"),
        F.coalesce(round_fp("_t", 1), F.lit(0.0)).alias("avg_tenure"),
        F.coalesce(round_fp("_m", 1), F.lit(0.0)).alias("avg_monthly"))


def segment_stream(column: str) -> Callable[[DataFrame], DataFrame]:
    """G1/G2 as a streaming aggregate keyed by the NULL/blank->Unknown value."""
    def build(stream: DataFrame) -> DataFrame:
        g = stream.groupBy(unknown_if_blank(column).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(churn_flag()).alias("_churned"))
        return g.select("key", round_fp(safe_div("_churned", "n"), 4).alias("churn_rate"), "n")
    return build


def feature_stream(features: Sequence[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """F1 state as a streaming aggregate: (feature, key, n, churned)."""
    feats = validate_features(features)

    def build(stream: DataFrame) -> DataFrame:
        return feature_counts(stream, feats)
    return build


def feature_post(features: Sequence[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """F1 per micro-batch: zero-filled Yes/No rates from the running counts.

    A join with the static dimension cannot follow a streaming aggregation,
    so it runs on each (static, small) micro-batch result instead."""
    feats = validate_features(features)
    return lambda batch: feature_rates(batch, feats)


def run_running(spark: SparkSession, source: str, build: Callable[[DataFrame], DataFrame],
                out: str, snapshots: str | None = None, trigger_bytes: int = TRIGGER_BYTES,
                checkpoint: str | None = None,
                post: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ST1 (+ ST2): stream what ``source`` holds through ``build``; return the
    result table.  ``post`` runs on each micro-batch result (a static frame)
    before it is written.  With ``snapshots``, every micro-batch result is also
    written there under its batch id, and a replayed batch replaces its own.
    The same ``checkpoint`` takes a later run on from where this one ended."""
    stream = (spark.readStream.schema(SUBSCRIPTION_SCHEMA)
                   .option("maxBytesPerTrigger", trigger_bytes).parquet(source))
    result = build(stream)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if post is not None:
            batch = post(batch)
        batch.write.mode("overwrite").parquet(out)
        if snapshots:
            write_snapshot(batch, batch_id, snapshots)

    q = (result.writeStream.outputMode("complete").foreachBatch(sink)
               .option("checkpointLocation", checkpoint or scratch(spark, "stream-ckpt"))
               .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out)


def write_snapshot(result: DataFrame, batch_id: int, path: str) -> None:
    """ST2: the micro-batch's result as JSON rows of its batch id, in place of what an earlier try of it wrote."""
    (result.select(F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("snapshot_ts"),
                   F.to_json(F.struct(*result.columns)).alias("payload"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def last_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """ST2: the result that the latest snapshot holds, as rows of ``schema``."""
    rows = spark.read.schema("snapshot_ts timestamp, payload string, batch_id long").parquet(path)
    last = rows.agg(F.max("batch_id").alias("batch_id"))  # partition values only
    return rows.join(last, "batch_id").select(F.from_json("payload", schema).alias("r")).select("r.*")
