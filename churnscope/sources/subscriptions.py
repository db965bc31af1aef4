"""The subscription base table and scans over it.

The test data has no subscription table, so the 21-column base is derived
from ``orders``, a per-order ``lineitem`` rollup and ``customer``: one order
is one subscription term that ends at the customer's next order (or at the
last order date).  The derivation is written once here and once as SQL in
``churnscope.plans.oracle`` (same rules, used only for checking).

Scale notes
-----------
* ``lineitem`` is rolled up per order with algebraic aggregates, so the
  partial (map-side) aggregate collapses a hot order before the shuffle.
* The tenure needs the month of the customer's next order only, so orders are
  first aggregated to one row per customer and month; a customer with a third
  of all orders then gives the window at most 12 rows a year.
* ``customer`` is joined by key with a shuffle join; AQE's skew-join
  handling splits a hot customer's partition.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SUBSCRIPTION_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
]

SUBSCRIPTION_SCHEMA = (
    "customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
    "tenure int, PhoneService string, MultipleLines string, InternetService string, "
    "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
    "StreamingTV string, StreamingMovies string, Contract string, PaperlessBilling string, "
    "PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string"
)

# Table names the "KPIs over another table" operator accepts (fixed values).
ALLOWED_TABLES = ("customers", "churn_customers", "customer_data")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lineitem_rollup(lineitem: DataFrame) -> DataFrame:
    """One row per order: line count, maxima, open lines and returned share."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_discount").alias("max_disc"),
        F.max("l_tax").alias("max_tax"),
        F.max("l_quantity").alias("max_qty"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("n_open"),
        F.try_divide(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)),
                     F.sum("l_quantity")).alias("ret"),
    )


def month_of(date) -> Column:
    return F.year(date) * 12 + F.month(date)


def term_months(orders: DataFrame) -> DataFrame:
    """Months until the customer's next order, or until the last month of all
    orders, for each customer's last order of a month: (term_key, term_months).

    Only months matter, so orders are first aggregated to one row per customer
    and month; the window then sees at most 12 rows a year of any customer.
    The final aggregate is on the join key, so queries that do not use the
    tenure lose this branch.
    """
    # order date and key as one sortable number, so that a hash aggregate finds the last order
    place = F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("decimal(19,0)") * F.expr("10000000000000000000BD")
    months = orders.groupBy("o_custkey", month_of("o_orderdate").alias("month")).agg(
        F.max((place + F.col("o_orderkey")).cast("decimal(38,0)")).alias("last"))
    as_of = orders.agg(F.max(month_of("o_orderdate")).alias("as_of"))  # one row
    following = F.lead("month").over(Window.partitionBy("o_custkey").orderBy("month"))
    return (months.withColumn("next", following).crossJoin(F.broadcast(as_of))
            .groupBy((F.col("last") % F.expr("10000000000000000000BD")).cast("long").alias("term_key"))
            .agg(F.max(F.coalesce("next", "as_of") - F.col("month")).alias("term_months")))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21-column subscription base (IO1), derived from the given tables."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    lineitem = read_table(spark, sf_dir, "lineitem")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")

    b = (orders.join(customer, F.col("c_custkey") == F.col("o_custkey"), "inner")
          .join(lineitem_rollup(lineitem), F.col("l_orderkey") == F.col("o_orderkey"), "left")
          .join(term_months(orders), F.col("term_key") == F.col("o_orderkey"), "left"))

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    n_lines = F.col("n_lines")
    # an order that is not its customer's last of a month ends in that month
    months = F.coalesce("term_months", F.lit(0))
    b = (b.withColumn("tenure", F.when(k % 103 == 0, F.lit(None)).otherwise(months))
          .withColumn("mc", F.when(k % 101 == 0, F.lit(None).cast("double"))
                             .otherwise(F.round(F.col("o_totalprice") / 4000, 2)))
          .withColumn("phone", F.when(n_lines.isNull(), F.lit(None).cast("string"))
                                .when(n_lines >= 2, "Yes").otherwise("No"))
          .withColumn("isvc", F.when(ck % 5 == 0, "No").when(ck % 5 <= 2, "DSL")
                               .otherwise("Fiber optic")))

    no_inet = F.col("isvc") == "No"

    def addon(cond):
        return (F.when(no_inet, "No internet service")
                 .when(n_lines.isNull(), F.lit(None).cast("string"))
                 .when(cond, "Yes").otherwise("No"))

    threshold = (F.when(F.col("o_orderstatus") == "O", 0.35)
                  .when(F.col("o_orderstatus") == "F", 0.55).otherwise(0.8))
    tenure = F.col("tenure")
    total = F.when(tenure == 0, F.lit(" ")).otherwise(
        (F.col("mc").cast("decimal(10,2)") * tenure).cast("decimal(18,2)").cast("string"))

    return b.select(
        F.concat(F.lpad(k.cast("string"), 20, "0"), F.lit("-"),
                 F.substring("c_mktsegment", 1, 5)).alias("customerID"),
        F.when(ck % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(k % 107 == 0, F.lit(None)).when(ck % 10 < 3, 1).otherwise(0)
         .cast("int").alias("SeniorCitizen"),
        F.when(F.col("c_acctbal") >= 4500, "Yes").otherwise("No").alias("Partner"),
        F.when(F.col("c_nationkey") % 3 == 0, "Yes").otherwise("No").alias("Dependents"),
        tenure.cast("int").alias("tenure"),
        F.col("phone").alias("PhoneService"),
        F.when(F.col("phone") == "No", "No phone service").when(n_lines >= 4, "Yes")
         .when(n_lines.isNull(), F.lit(None).cast("string")).otherwise("No").alias("MultipleLines"),
        F.col("isvc").alias("InternetService"),
        addon(F.col("max_disc") >= 0.08).alias("OnlineSecurity"),
        addon(F.col("n_open") >= 2).alias("OnlineBackup"),
        addon(F.col("max_qty") >= 45).alias("DeviceProtection"),
        addon(F.col("max_tax") >= 0.06).alias("TechSupport"),
        F.when(no_inet, "No internet service").when(k % 3 == 0, "Yes").otherwise("No")
         .alias("StreamingTV"),
        F.when(no_inet, "No internet service").when(k % 4 < 2, "Yes").otherwise("No")
         .alias("StreamingMovies"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).when(k % 89 == 0, "  ")
         .when(F.col("o_orderstatus") == "O", "Month-to-month")
         .when(F.col("o_orderstatus") == "F", "One year").otherwise("Two year").alias("Contract"),
        F.when(ck % 4 == 0, "No").otherwise("Yes").alias("PaperlessBilling"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Electronic check")
         .when(F.col("o_orderpriority") == "2-HIGH", "Mailed check")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "Bank transfer (automatic)")
         .when(F.col("o_orderpriority") == "5-LOW", "Credit card (automatic)")
         .alias("PaymentMethod"),
        F.col("mc").alias("MonthlyCharges"),
        total.alias("TotalCharges"),
        F.when(F.col("ret").isNull(), F.lit(None).cast("string"))
         .when(F.col("ret") >= threshold, "Yes").otherwise("No").alias("Churn"),
    )


def churn_customers(spark: SparkSession, sf_dir: str, view: str = "churn_customers") -> DataFrame:
    """Build the base and register it as a temp view (the reference's table name)."""
    df = subscriptions(spark, sf_dir)
    df.createOrReplaceTempView(view)
    return df


def allowed_table(spark: SparkSession, name: str) -> DataFrame:
    """``spark.table(name)`` for an allow-listed table name only."""
    if name not in ALLOWED_TABLES:
        raise ValueError(f"table {name!r} is not allowed; use one of {list(ALLOWED_TABLES)}")
    return spark.table(name)


def churned_scan(df: DataFrame) -> DataFrame:
    """Churned rows only (the filter reaches the scan when ``df`` is parquet)."""
    return df.where(F.col("Churn") == "Yes")


def model_input_scan(df: DataFrame) -> DataFrame:
    """The 7 model columns, rows with tenure and charge present."""
    return (df.where(F.col("tenure").isNotNull() & F.col("MonthlyCharges").isNotNull())
              .select(F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("churn"),
                      "tenure", "MonthlyCharges", "Contract", "PaymentMethod",
                      "OnlineSecurity", "TechSupport"))


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows by customerID (a deterministic connectivity sample)."""
    return df.orderBy("customerID").limit(n)


def materialize_subscriptions(spark: SparkSession, sf_dir: str, path: str,
                              files: int | None = None) -> str:
    """Write the derived base once as a table (the ETL step of a deployment).

    * ``partitionBy("Churn")``: churned-only queries prune to one directory.
    * ``repartitionByRange("customerID")`` + sorted files: each file covers a
      contiguous id range, so ``customerID > last`` (keyset paging) and id
      searches skip files and row groups by their min/max statistics.
    """
    base = subscriptions(spark, sf_dir)
    ranged = base.repartitionByRange(files, "customerID") if files else base.repartitionByRange("customerID")
    ranged.sortWithinPartitions("customerID").write.mode("overwrite").partitionBy("Churn").parquet(path)
    return path


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Read a materialised base with the canonical column order."""
    return spark.read.parquet(path).select(*SUBSCRIPTION_COLUMNS)


def require_rows(df: DataFrame, what: str = "churn_customers") -> DataFrame:
    """IO1: fail early on an empty source, as the batch load does.

    ``isEmpty`` reads at most one row (a limit-1 job), not the table."""
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df
