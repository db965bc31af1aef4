"""Churn grouped by segment columns (contract, payment method, ...).

Every operator here makes one pass over the base: the requested columns are
unpivoted to ``(segment, key)`` and counted in a single aggregate, so the
shuffle carries at most (#segments x #keys) partial rows per task.  Later
steps (rates, summaries, shares) only touch that aggregated result, whose
size is bounded by the number of distinct category values, not by the data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.scalar import (
    churn_flag, no_if_null, round_fp, safe_div, unknown_if_blank, unknown_if_null)

KEY_RULES = {
    "blank": unknown_if_blank,              # NULL or blank -> Unknown (API)
    "null": unknown_if_null,                # NULL -> Unknown (batch job)
    "no": no_if_null,                       # NULL -> No (features)
    "js": lambda c: F.coalesce(c.cast("string"), F.lit("null")),  # JS object key
    "raw": lambda c: c,
}


def segment_counts(df: DataFrame, columns: Sequence[str], rule: str = "blank",
                   where: Column | None = None) -> DataFrame:
    """(segment, key, n, churned) for each requested column in one pass."""
    keyf = KEY_RULES[rule]
    if where is not None:
        df = df.where(where)
    cols = list(columns)
    slim = df.select(churn_flag().alias("_churned"),
                     *[keyf(F.col(c)).cast("string").alias(c) for c in cols])
    if len(cols) == 1:
        long = slim.select(F.lit(cols[0]).alias("segment"), F.col(cols[0]).alias("key"), "_churned")
    else:
        long = slim.unpivot(["_churned"], cols, "segment", "key")
    return long.groupBy("segment", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_churned").cast("long").alias("churned"))


def with_rate(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Adds ``churn_rate`` (rounded) and ``_raw_rate`` (unrounded, for ties)."""
    raw = safe_div("churned", "n")
    return counts.withColumn("churn_rate", round_fp(raw, digits)).withColumn("_raw_rate", raw)


def churn_by(df: DataFrame, column: str) -> DataFrame:
    """Key, churn_rate (4 dp), n; highest rate first.  Rounded ties
    keep the unrounded order (as the SQL sort feeding a stable re-sort does),
    then key."""
    return (with_rate(segment_counts(df, [column], "blank"))
            .orderBy(F.col("churn_rate").desc(), F.col("_raw_rate").desc(), F.col("key"))
            .select("key", "churn_rate", "n"))


def churn_by_contract(df: DataFrame) -> DataFrame:
    return churn_by(df, "Contract")


def churn_by_payment(df: DataFrame) -> DataFrame:
    return churn_by(df, "PaymentMethod")


def segment_metadata(df: DataFrame, column: str) -> DataFrame:
    """Total customers over the groups and the number of groups."""
    g = segment_counts(df, [column], "blank")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_customers"),
                 F.count(F.lit(1)).alias("total_groups"))


def _summary_aggs(prefix: str = "") -> list[Column]:
    # First max / first min of the list ordered by (rate desc, raw rate desc, key).
    row = F.struct("key", "churn_rate", "n")
    hi = F.min_by(row, F.struct(-F.col("churn_rate"), -F.col("_raw_rate"), F.col("key")))
    lo = F.min_by(row, F.struct(F.col("churn_rate"), -F.col("_raw_rate"), F.col("key")))
    return [
        hi.getField("key").alias(f"{prefix}highest_key"),
        hi.getField("churn_rate").alias(f"{prefix}highest_rate"),
        hi.getField("n").alias(f"{prefix}highest_n"),
        lo.getField("key").alias(f"{prefix}lowest_key"),
        lo.getField("churn_rate").alias(f"{prefix}lowest_rate"),
        lo.getField("n").alias(f"{prefix}lowest_n"),
        F.coalesce(round_fp(safe_div(F.sum(F.col("churn_rate") * F.col("n")), F.sum("n")), 4),
                   F.lit(0.0)).alias(f"{prefix}average_churn_rate"),
        F.count(F.lit(1)).alias(f"{prefix}total_types"),
    ]


def segment_summary(df: DataFrame, column: str) -> DataFrame:
    """highest/lowest group (ties -> smaller key), n-weighted mean of the
    rounded rates, group count.  Empty input -> NULL rows, 0.0 and 0."""
    g = with_rate(segment_counts(df, [column], "blank"))
    return g.agg(*_summary_aggs())


def payment_vs_contract(df: DataFrame) -> DataFrame:
    """Rate range per segmentation and which one spreads more (one pass)."""
    g = with_rate(segment_counts(df, ["PaymentMethod", "Contract"], "blank"))
    out = []
    for seg, p in (("PaymentMethod", "payment"), ("Contract", "contract")):
        is_seg = F.col("segment") == seg
        rate = F.when(is_seg, F.col("churn_rate"))
        out += [F.coalesce(F.max(rate), F.lit(0.0)).alias(f"{p}_highest_rate"),
                F.coalesce(F.min(rate), F.lit(0.0)).alias(f"{p}_lowest_rate"),
                F.count_if(is_seg).alias(f"{p}_count")]
    a = g.agg(*out)
    ps = F.round(F.col("payment_highest_rate") - F.col("payment_lowest_rate"), 4)
    cs = F.round(F.col("contract_highest_rate") - F.col("contract_lowest_rate"), 4)
    return (a.withColumn("payment_rate_spread", ps)
             .withColumn("contract_rate_spread", cs)
             .withColumn("higher_spread_segment",
                         F.when(F.col("payment_rate_spread") > F.col("contract_rate_spread"),
                                "payment").otherwise("contract"))
             .withColumn("payment_vs_contract_spread_ratio",
                         F.coalesce(round_fp(safe_div("payment_rate_spread",
                                                      "contract_rate_spread"), 4), F.lit(0.0))))


def spread_bars(df: DataFrame) -> DataFrame:
    """Bar width = spread / max(spreads) * 100 for the two segmentations."""
    c = payment_vs_contract(df)
    mx = F.greatest("payment_rate_spread", "contract_rate_spread")
    return c.select(F.explode(F.array(
        F.struct(F.lit("payment").alias("segment"), F.col("payment_rate_spread").alias("spread"),
                 F.round(safe_div("payment_rate_spread", mx) * 100, 2).alias("bar_pct")),
        F.struct(F.lit("contract").alias("segment"), F.col("contract_rate_spread").alias("spread"),
                 F.round(safe_div("contract_rate_spread", mx) * 100, 2).alias("bar_pct")),
    )).alias("b")).select("b.*")


def batch_churn_rate(df: DataFrame, columns: Sequence[str] = ("Contract", "PaymentMethod")) -> DataFrame:
    """Batch job rate per NULL->Unknown key, percent, unrounded."""
    g = segment_counts(df, columns, "null")
    return (g.select("segment", "key",
                     (F.col("churned") / F.col("n") * 100).alias("churn_rate"))
              .orderBy("segment", "key"))


def churned_mix(df: DataFrame, columns: Sequence[str] = ("Contract", "PaymentMethod"),
                rule: str = "null", digits: int | None = None) -> DataFrame:
    """Churned customers per key: count and share of all churned (percent).

    ``rule='null'`` is the batch job (NULL -> Unknown, unrounded percent);
    ``rule='js'`` the dashboard script (raw keys, 2 dp, 0 when nobody churned).
    """
    g = segment_counts(df, columns, rule, where=F.col("Churn") == "Yes")
    # Total churned per segment = sum over that segment's groups (tiny window).
    total = F.sum("n").over(Window.partitionBy("segment"))
    pct = safe_div(F.col("n"), total) * 100
    if digits is not None:
        pct = F.round(pct, digits)
    return (g.select("segment", "key", F.col("n").alias("count"), pct.alias("pct"))
              .orderBy("segment", F.col("count").desc(), "key"))


def distinct_segments(df: DataFrame) -> DataFrame:
    """Number of distinct NULL/blank->Unknown contract and payment keys."""
    return df.agg(
        F.count_distinct(unknown_if_blank("Contract")).alias("contract_types"),
        F.count_distinct(unknown_if_blank("PaymentMethod")).alias("payment_methods"))


def segment_shares(df: DataFrame, columns: Sequence[str] = ("Contract", "PaymentMethod")) -> DataFrame:
    """G11 + G13: per group n share of all users (1 dp) and the rate as percent
    (2 dp for charts, 1 dp for labels)."""
    g = with_rate(segment_counts(df, columns, "blank"))
    total = F.sum("n").over(Window.partitionBy("segment"))
    return g.select(
        "segment", "key", "n", "churn_rate",
        F.round(safe_div(F.col("n"), total) * 100, 1).alias("share_pct"),
        F.round(F.col("churn_rate") * 100, 2).alias("churn_rate_pct"),
        F.round(F.col("churn_rate") * 100, 1).alias("churn_rate_label"))
