"""Overall metrics: KPIs, churned-only averages, readiness counts.

Each operator is one global aggregate over the base (partial aggregate per
task, one tiny final merge), followed by scalar arithmetic on one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.scalar import (
    churn_flag, parse_or_zero, round_fp, safe_div, to_number, unknown_if_blank)
from churnscope.sources.subscriptions import allowed_table


def compute_kpis(df: DataFrame) -> DataFrame:
    """K1: churned users, churn rate (4 dp), mean tenure and charge (1 dp).

    Averages skip NULLs; a NULL average or an empty table gives 0.0."""
    a = df.agg(F.count(F.lit(1)).alias("_total"),
               F.sum(churn_flag()).alias("_churned"),
               F.avg("tenure").alias("_t"),
               F.avg("MonthlyCharges").alias("_m"))
    return a.select(
        F.coalesce(F.col("_churned"), F.lit(0)).cast("long").alias("churned_users"),
        F.coalesce(round_fp(safe_div("_churned", "_total"), 4), F.lit(0.0)).alias("churn_rate_overall"),
        F.coalesce(round_fp("_t", 1), F.lit(0.0)).alias("avg_tenure"),
        F.coalesce(round_fp("_m", 1), F.lit(0.0)).alias("avg_monthly"),
    )


def compute_kpis_for_table(spark: SparkSession, table_name: str = "customers") -> DataFrame:
    """K2: K1 over an allow-listed catalog table."""
    return compute_kpis(allowed_table(spark, table_name))


def kpis_with_metadata(df: DataFrame, table_name: str = "churn_customers",
                       with_timestamp: bool = True) -> DataFrame:
    """K3: K1 plus total records, table name and (optionally) computation time."""
    a = df.agg(F.count(F.lit(1)).alias("_total"),
               F.sum(churn_flag()).alias("_churned"),
               F.avg("tenure").alias("_t"),
               F.avg("MonthlyCharges").alias("_m"))
    cols = [
        F.coalesce(F.col("_churned"), F.lit(0)).cast("long").alias("churned_users"),
        F.coalesce(round_fp(safe_div("_churned", "_total"), 4), F.lit(0.0)).alias("churn_rate_overall"),
        F.coalesce(round_fp("_t", 1), F.lit(0.0)).alias("avg_tenure"),
        F.coalesce(round_fp("_m", 1), F.lit(0.0)).alias("avg_monthly"),
        F.col("_total").alias("total_records"),
        F.lit(table_name).alias("table_name"),
    ]
    if with_timestamp:
        cols.append(F.current_timestamp().alias("computed_at"))
    return a.select(*cols)


def churned_averages(df: DataFrame) -> DataFrame:
    """K4: batch job's churned-only means (unrounded) and churned count."""
    c = df.where(F.col("Churn") == "Yes")
    return c.agg(F.avg("tenure").alias("avg_tenure"),
                 F.avg("MonthlyCharges").alias("avg_monthly"),
                 F.avg(to_number("TotalCharges")).alias("avg_total"),
                 F.count(F.lit(1)).alias("count"))


def churned_averages_js(df: DataFrame) -> DataFrame:
    """K5: dashboard-script means: NULL/unparseable values add 0 but still
    count in the denominator; 2 dp; nobody churned -> 0."""
    c = df.where(F.col("Churn") == "Yes")
    a = c.agg(F.count(F.lit(1)).alias("churned"),
              F.sum(F.coalesce(F.col("tenure").cast("double"), F.lit(0.0))).alias("_t"),
              F.sum(F.coalesce(F.col("MonthlyCharges"), F.lit(0.0))).alias("_m"),
              F.sum(parse_or_zero("TotalCharges")).alias("_tc"))
    return a.select(
        "churned",
        *[F.round(safe_div(s, "churned"), 2).alias(n)
          for s, n in (("_t", "avg_tenure"), ("_m", "avg_monthly"), ("_tc", "avg_total"))])


def implied_total(df: DataFrame) -> DataFrame:
    """K6: total customers re-derived as round(churned / rounded rate) (0 when
    the rate is 0), beside the exact count it approximates."""
    k = df.agg(F.count(F.lit(1)).alias("total_customers"),
               F.sum(churn_flag()).alias("_churned"))
    rate = F.coalesce(round_fp(safe_div("_churned", "total_customers"), 4), F.lit(0.0))
    churned = F.coalesce(F.col("_churned"), F.lit(0))
    return k.select(
        churned.cast("long").alias("churned_users"),
        rate.alias("churn_rate_overall"),
        F.when(rate > 0, F.round(churned / rate, 0)).otherwise(F.lit(0.0)).cast("long")
         .alias("implied_total_customers"),
        "total_customers")


def readiness(df: DataFrame) -> DataFrame:
    """R7 (+ G10, H14, M14): data-quality counts in one pass."""
    churned = F.col("Churn") == "Yes"
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(churned).alias("churned_rows"),
        F.count_distinct(unknown_if_blank("Contract")).alias("contract_types"),
        F.count_distinct(unknown_if_blank("PaymentMethod")).alias("payment_methods"),
        F.count_if(churned & F.col("tenure").isNotNull()).alias("churned_with_tenure"),
        F.count_if(churned & F.col("MonthlyCharges").isNotNull()).alias("churned_with_charges"),
        F.count_if(F.col("tenure").isNotNull() & F.col("MonthlyCharges").isNotNull())
         .alias("model_usable_rows"),
    )


def churned_with_value(df: DataFrame) -> DataFrame:
    """Churned rows having a tenure / a monthly charge."""
    churned = F.col("Churn") == "Yes"
    return df.agg(
        F.count_if(churned & F.col("tenure").isNotNull()).alias("churned_with_tenure"),
        F.count_if(churned & F.col("MonthlyCharges").isNotNull()).alias("churned_with_charges"))


def model_usable_rows(df: DataFrame) -> DataFrame:
    """Rows with both tenure and monthly charge."""
    return df.agg(F.count_if(F.col("tenure").isNotNull() & F.col("MonthlyCharges").isNotNull())
                  .alias("usable_rows"))


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether a catalog table/view exists (driver-side metadata lookup)."""
    return spark.catalog.tableExists(name)
