"""Fixed-bin distributions of churned customers (tenure, monthly charge).

Binning is a chained CASE expression (right-closed edges) evaluated inside
the scan stage; the aggregate has at most #bins groups, so each task ships
a handful of partial rows.  Zero-filling, ordering, totals and summaries
run on the aggregated rows (bounded by the bin count, not by the data):
the bin dimension is joined to the counts, never to the base rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.bins import (
    MONTHLY_API, MONTHLY_BATCH, MONTHLY_JS, TENURE_API, TENURE_BATCH, TENURE_JS, BinDef)
from churnscope.functions.dims import literal_frame
from churnscope.functions.scalar import round_fp, safe_div

def _ALL_BINS():
    """Single-partition window over a frame with one row per bin (a few rows)."""
    return Window.partitionBy()


def _bin_counts(df: DataFrame, label: Column, where: Column | None) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df.select(label.alias("range")).groupBy("range").agg(
        F.count(F.lit(1)).alias("count"))


def _on_dimension(counts: DataFrame, bindef: BinDef) -> DataFrame:
    """Every bin of the definition with its count (0 if absent), in order;
    ranges not in the definition are dropped (zero-fill, H5)."""
    dim = bindef.frame(counts.sparkSession, "range")
    # counts has at most one row per bin (+ NULL): broadcast it, stream the dimension.
    return (F.broadcast(counts).join(dim, "range", "right")
               .select("range", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                       "bin_order"))


def histogram(df: DataFrame, column: str, bindef: BinDef) -> DataFrame:
    """H1/H2: churned rows with a non-NULL value, counted per bin.

    pct = count / churned-with-value (4 dp); all bins, in definition order."""
    x = F.col(column)
    counts = _bin_counts(df, bindef.label(x), (F.col("Churn") == "Yes") & x.isNotNull())
    full = _on_dimension(counts, bindef)
    total = F.sum("count").over(_ALL_BINS())
    return (full.select("range", "count",
                        F.coalesce(round_fp(safe_div("count", total), 4), F.lit(0.0)).alias("pct"),
                        "bin_order")
                .orderBy("bin_order"))


def tenure_bins(df: DataFrame) -> DataFrame:
    return histogram(df, "tenure", TENURE_API)


def monthly_bins(df: DataFrame) -> DataFrame:
    return histogram(df, "MonthlyCharges", MONTHLY_API)


def order_bins(rows: DataFrame, bindef: BinDef) -> DataFrame:
    """H4: known ranges in definition order, unknown ranges after them."""
    pos = F.coalesce(bindef.order("range"), F.lit(len(bindef.labels)))
    return rows.withColumn("bin_order", pos).orderBy("bin_order")


def complete_bins(rows: DataFrame, bindef: BinDef) -> DataFrame:
    """H5: (range, count, pct) rows completed to every bin; unknown dropped."""
    dim = bindef.frame(rows.sparkSession, "range")
    return (rows.join(dim, "range", "right")
               .select("range", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                       F.coalesce(F.col("pct"), F.lit(0.0)).alias("pct"), "bin_order")
               .orderBy("bin_order"))


def histogram_metadata(df: DataFrame, column: str, bindef: BinDef) -> DataFrame:
    """H6: total churned analysed and the bin definition."""
    h = histogram(df, column, bindef)
    return h.agg(F.sum("count").cast("long").alias("total_churned"),
                 F.count(F.lit(1)).alias("n_bins"),
                 F.lit("|".join(bindef.labels)).alias("bin_labels"),
                 F.lit("|".join(str(e) for e in bindef.edges)).alias("bin_edges"))


def histogram_summary(df: DataFrame, column: str, bindef: BinDef) -> DataFrame:
    """H7: highest / lowest count and most common (by pct) bin; ties go to the
    first bin in definition order; total churned analysed."""
    h = histogram(df, column, bindef)
    row = F.struct("range", "count", "pct")
    hi = F.min_by(row, F.struct(-F.col("count"), F.col("bin_order")))
    lo = F.min_by(row, F.struct(F.col("count"), F.col("bin_order")))
    mc = F.min_by(row, F.struct(-F.col("pct"), F.col("bin_order")))
    return h.agg(hi.getField("range").alias("highest_count_range"),
                 hi.getField("count").alias("highest_count"),
                 lo.getField("range").alias("lowest_count_range"),
                 lo.getField("count").alias("lowest_count"),
                 mc.getField("range").alias("most_common_range"),
                 mc.getField("pct").alias("most_common_pct"),
                 F.sum("count").cast("long").alias("total_churned_analyzed"))


def _py_float_text(x: Column) -> Column:
    """str() of a double that is already rounded to 1 dp (e.g. '71.3', '80.0')."""
    return x.cast("string")


def histogram_insights(df: DataFrame, column: str, bindef: BinDef, split: int,
                       kind: str, text_a: str, text_b: str, dominant_text: str) -> DataFrame:
    """H8/H9: share of the first ``split`` bins vs the rest (1 dp), and the
    dominant bin; each line only when its total / pct is positive."""
    h = histogram(df, column, bindef)
    first = F.col("bin_order") < split
    mc = F.min_by(F.struct("range", "pct"), F.struct(-F.col("pct"), F.col("bin_order")))
    a = h.agg(F.sum(F.when(first, F.col("count")).otherwise(0)).alias("_a"),
              F.sum(F.when(~first, F.col("count")).otherwise(0)).alias("_b"),
              mc.alias("_mc"))
    tot = F.col("_a") + F.col("_b")
    pa = round_fp(safe_div("_a", tot) * 100, 1)
    pb = round_fp(safe_div("_b", tot) * 100, 1)
    share = F.struct(
        F.lit(kind).alias("type"), F.lit(None).cast("string").alias("range"),
        pa.alias("pct_a"), pb.alias("pct_b"),
        F.concat(_py_float_text(pa), F.lit(text_a), _py_float_text(pb), F.lit(text_b)).alias("insight"))
    mpct = F.col("_mc.pct")
    dom = F.struct(
        F.lit("dominant_range").alias("type"), F.col("_mc.range").alias("range"),
        F.round(mpct * 100, 6).alias("pct_a"), F.lit(None).cast("double").alias("pct_b"),
        F.format_string(dominant_text, F.round(mpct * 100, 1), F.col("_mc.range")).alias("insight"))
    rows = F.array(F.when(tot > 0, share), F.when(mpct > 0, dom))
    return (a.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
             .select("r.*"))


def tenure_insights(df: DataFrame) -> DataFrame:
    return histogram_insights(
        df, "tenure", TENURE_API, 3, "early_vs_late_churn",
        "% of churned customers left within first year, ", "% after first year",
        "Most churned customers (%.1f%%) are in the %s months tenure range")


def monthly_insights(df: DataFrame) -> DataFrame:
    return histogram_insights(
        df, "MonthlyCharges", MONTHLY_API, 2, "low_vs_high_charges_churn",
        "% of churned customers have low charges ($0-65), ", "% have high charges ($66+)",
        "Most churned customers (%.1f%%) are in the $%s monthly charges range")


def batch_binned(df: DataFrame) -> DataFrame:
    """Batch-job bin label per row (NULL when outside the edges)."""
    return df.select("customerID", "tenure", "MonthlyCharges",
                     TENURE_BATCH.label(F.col("tenure")).alias("tenure_range"),
                     MONTHLY_BATCH.label(F.col("MonthlyCharges")).alias("monthly_charge_range"))


def batch_bin_mix(df: DataFrame, column: str, bindef: BinDef) -> DataFrame:
    """Churned customers per batch bin; zero-count bins included; pct =
    count / all churned * 100 (NULL-bin rows count in the total), unrounded."""
    churned = df.where(F.col("Churn") == "Yes")
    a = churned.groupBy(bindef.label(F.col(column)).alias("range")).agg(
        F.count(F.lit(1)).alias("count"))
    # Total churned = all groups, the NULL bin included (bounded window).
    a = a.withColumn("_total", F.sum("count").over(_ALL_BINS()))
    total = F.max("_total").over(_ALL_BINS())
    full = (F.broadcast(a).join(bindef.frame(df.sparkSession, "range"), "range", "right")
            .select("range", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    "bin_order", "_total"))
    return (full.select("range", "count",
                        (safe_div(F.col("count"), total) * 100).alias("pct"),
                        "bin_order")
                .orderBy(F.col("count").desc(), "bin_order"))


def js_bins(df: DataFrame, columns: Sequence[tuple[str, BinDef]] = (
        ("tenure", TENURE_JS), ("MonthlyCharges", MONTHLY_JS))) -> DataFrame:
    """Dashboard-script bins over churned rows: NULL counts as 0, no range
    check, every bin listed in order, pct 2 dp of all churned."""
    churned = df.where(F.col("Churn") == "Yes")
    cols = [(c, b) for c, b in columns]
    labelled = churned.select(*[
        b.label(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c, b in cols])
    long = labelled.unpivot([], [c for c, _ in cols], "attribute", "range") if len(cols) > 1 else \
        labelled.select(F.lit(cols[0][0]).alias("attribute"), F.col(cols[0][0]).alias("range"))
    counts = long.groupBy("attribute", "range").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    dim = literal_frame(spark, [(c, lab, i) for c, b in cols for i, lab in enumerate(b.labels)],
                        [("attribute", "string"), ("range", "string"), ("bin_order", "int")])
    full = F.broadcast(counts).join(dim, ["attribute", "range"], "right").select(
        "attribute", "range", "bin_order",
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    total = F.sum("count").over(Window.partitionBy("attribute"))
    return (full.select("attribute", "range", "count",
                        F.round(safe_div(F.col("count"), total) * 100, 2).alias("pct"), "bin_order")
                .orderBy("attribute", "bin_order"))
