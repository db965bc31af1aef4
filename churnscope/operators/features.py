"""Churn by service add-on ("feature") columns.

The reference issues one query per feature; here all requested features are
unpivoted and counted in one aggregate (one scan, one small shuffle), then
joined onto the (feature x {Yes, No}) dimension to emit exactly those two
rows per feature.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.dims import literal_frame
from churnscope.functions.scalar import round_fp, safe_div
from churnscope.operators.segments import segment_counts

# --- fixed values: the feature allow-list and defaults ----------------------
ALLOWED_FEATURES = [
    "OnlineSecurity", "TechSupport", "OnlineBackup", "DeviceProtection", "StreamingTV",
    "StreamingMovies", "InternetService", "PhoneService", "MultipleLines", "PaperlessBilling",
]
DEFAULT_FEATURES = ["OnlineSecurity", "TechSupport"]
FEATURE_KEYS = ["Yes", "No"]
# -----------------------------------------------------------------------------


def parse_feature_names(names: str | None) -> list[str]:
    """comma-separated names, trimmed, blanks dropped."""
    if not names:
        return []
    return [n.strip() for n in names.split(",") if n.strip()]


def validate_features(features: Iterable[str] | None) -> list[str]:
    """keep allow-listed names (first occurrence order); empty -> defaults;
    none valid -> ValueError."""
    asked = dict.fromkeys(features or DEFAULT_FEATURES)
    known = [f for f in asked if f in ALLOWED_FEATURES]
    if not known:
        raise ValueError(f"none of {list(asked)} is a service feature")
    return known


def list_features() -> dict[str, list[str]]:
    """allowed and default feature names."""
    return {"allowed": list(ALLOWED_FEATURES), "default": list(DEFAULT_FEATURES)}


def feature_churn(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """per feature, the Yes and No rows (NULL counts as No): churn rate
    (4 dp) and n; absent key -> 0.0 / 0; other values are not emitted."""
    feats = validate_features(features)
    return feature_rates(feature_counts(df, feats), feats)


def feature_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, key, n, churned) for the features in one pass (NULL -> No)."""
    return segment_counts(df, list(features), "no").withColumnRenamed("segment", "feature")


def feature_rates(counts: DataFrame, features: Sequence[str]) -> DataFrame:
    """Yes/No rows per feature from ``feature_counts`` output (zero-filled)."""
    feats = list(features)
    spark = counts.sparkSession
    dim = literal_frame(
        spark, [(f, k, i, j) for i, f in enumerate(feats) for j, k in enumerate(FEATURE_KEYS)],
        [("feature", "string"), ("key", "string"), ("feature_order", "int"), ("key_order", "int")])
    # Only Yes/No rows are emitted, so the broadcast side has <= 2 rows per feature.
    kept = counts.where(F.col("key").isin(*FEATURE_KEYS))
    j = F.broadcast(kept).join(dim, ["feature", "key"], "right")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return (j.select("feature", "key",
                     F.coalesce(round_fp(safe_div("churned", n), 4), F.lit(0.0)).alias("churn_rate"),
                     n.alias("n"), "feature_order", "key_order")
             .orderBy("feature_order", "key_order"))


def feature_metadata(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """analysed feature names, sum of n over the emitted rows, allowed names."""
    feats = validate_features(features)
    fc = feature_churn(df, feats)
    return fc.agg(
        F.lit(",".join(feats)).alias("analyzed_features"),
        F.sum("n").cast("long").alias("total_feature_combinations"),
        F.lit(",".join(ALLOWED_FEATURES)).alias("available_features"))


def _yes_no_wide(df: DataFrame, features: Sequence[str] | None) -> DataFrame:
    fc = feature_churn(df, features)
    yes, no = F.col("key") == "Yes", F.col("key") == "No"
    return fc.groupBy("feature", "feature_order").agg(
        F.max(F.when(yes, F.col("churn_rate"))).alias("yes_churn_rate"),
        F.max(F.when(no, F.col("churn_rate"))).alias("no_churn_rate"),
        F.max(F.when(yes, F.col("n"))).alias("yes_customers"),
        F.max(F.when(no, F.col("n"))).alias("no_customers"))


def feature_impact(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """churn reduction = No rate - Yes rate (4 dp) for features with both
    groups present; ranked best first (ties keep request order); best/worst."""
    w = _yes_no_wide(df, features).where((F.col("yes_customers") > 0) & (F.col("no_customers") > 0))
    w = w.withColumn("churn_reduction",
                     round_fp(F.col("no_churn_rate") - F.col("yes_churn_rate"), 4))
    # One row per feature (<= 10 rows): a single-partition window is bounded.
    order = Window.orderBy(F.col("churn_reduction").desc(), F.col("feature_order"))
    w = (w.withColumn("rank", F.row_number().over(order))
          .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    return (w.select("feature", "yes_churn_rate", "no_churn_rate", "churn_reduction",
                     "yes_customers", "no_customers", "rank",
                     (F.col("rank") == 1).alias("is_best"),
                     (F.col("rank") == F.col("_n")).alias("is_worst"))
             .orderBy("rank"))


def feature_chart_series(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """one row per feature: Yes/No rate as percent and Yes/No counts."""
    w = _yes_no_wide(df, features)
    return (w.select("feature",
                     (F.col("yes_churn_rate") * 100).alias("yes_pct"),
                     (F.col("no_churn_rate") * 100).alias("no_pct"),
                     F.col("yes_customers").alias("yes_n"),
                     F.col("no_customers").alias("no_n"), "feature_order")
             .orderBy("feature_order"))
