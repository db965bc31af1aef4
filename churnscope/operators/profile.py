"""Churned-customer profile: value counts of 16 attributes plus two binned
columns, as one long (attribute, value, count, pct) frame.

All attributes are unpivoted after the churn filter and counted in a single
aggregate (one scan; each task ships at most #attributes x #values partial
rows).  The two binned attributes list every bin, zero counts included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.bins import MONTHLY_JS, TENURE_JS
from churnscope.functions.dims import literal_frame

# --- fixed values: attribute names of the profile and their columns ---------
PROFILE_ATTRIBUTES = [
    ("gender", "gender"), ("seniorCitizen", "SeniorCitizen"), ("partner", "Partner"),
    ("dependents", "Dependents"), ("phoneService", "PhoneService"),
    ("multipleLines", "MultipleLines"), ("internetService", "InternetService"),
    ("onlineSecurity", "OnlineSecurity"), ("onlineBackup", "OnlineBackup"),
    ("deviceProtection", "DeviceProtection"), ("techSupport", "TechSupport"),
    ("streamingTV", "StreamingTV"), ("streamingMovies", "StreamingMovies"),
    ("contract", "Contract"), ("paperlessBilling", "PaperlessBilling"),
    ("paymentMethod", "PaymentMethod"),
]
PROFILE_BINS = [("tenureRanges", "tenure", TENURE_JS),
                ("monthlyChargeRanges", "MonthlyCharges", MONTHLY_JS)]
# -----------------------------------------------------------------------------


def churned_profile(df: DataFrame) -> DataFrame:
    """Per attribute value, churned count and percent of churned (1 dp).

    Values are keyed as the dashboard script keys them: NULL -> 'null',
    numbers as text; a NULL tenure/charge compares as 0 (first bin)."""
    churned = df.where(F.col("Churn") == "Yes")
    names = [a for a, _ in PROFILE_ATTRIBUTES] + [a for a, _, _ in PROFILE_BINS]
    wide = churned.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(a) for a, c in PROFILE_ATTRIBUTES],
        *[b.label(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(a)
          for a, c, b in PROFILE_BINS])
    counts = (wide.unpivot([], names, "attribute", "value")
                  .groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("count")))
    # Zero rows for every bin so empty bins still appear; summed away below.
    zeros = literal_frame(df.sparkSession,
                          [(a, lab, 0) for a, _, b in PROFILE_BINS for lab in b.labels],
                          [("attribute", "string"), ("value", "string"), ("count", "bigint")])
    full = counts.unionByName(zeros).groupBy("attribute", "value").agg(
        F.sum("count").cast("long").alias("count"))
    # Every churned row has exactly one value per attribute, so the total is
    # the attribute's sum (window over the small aggregated frame).
    total = F.sum("count").over(Window.partitionBy("attribute"))
    return full.select("attribute", "value", "count",
                       F.round(F.col("count") / total * 100, 1).alias("pct"))
