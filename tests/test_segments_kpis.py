from pyspark.sql import functions as F

from churnscope.operators import kpis, segments as seg
from conftest import counts_frame

CONTRACT_GROUPS = [("Month-to-month", 3875, 1655), ("One year", 1473, 166),
                   ("Two year", 1695, 48), (None, 10, 2), ("", 5, 1)]
PAYMENT_GROUPS = [("Electronic check", 2365, 1071), ("Mailed check", 1612, 308),
                  ("Bank transfer (automatic)", 1544, 258), ("Credit card (automatic)", 1522, 232),
                  (None, 8, 3), ("", 4, 1)]


def test_churn_by_contract_merges_unknown(spark):
    df = counts_frame(spark, "Contract", CONTRACT_GROUPS)
    rows = seg.churn_by_contract(df).collect()
    assert len(rows) == 4
    by = {r.key: r for r in rows}
    assert by["Unknown"].n == 15 and by["Unknown"].churn_rate == 0.2
    assert by["Month-to-month"].churn_rate == 0.4271 and by["Month-to-month"].n == 3875
    assert [r.churn_rate for r in rows] == sorted([r.churn_rate for r in rows], reverse=True)


def test_churn_by_payment(spark):
    df = counts_frame(spark, "PaymentMethod", PAYMENT_GROUPS)
    rows = seg.churn_by_payment(df).collect()
    assert len(rows) == 5 and rows[0].key == "Electronic check"
    assert {r.key: r.n for r in rows}["Unknown"] == 12


def test_segment_summary_and_meta(spark):
    df = counts_frame(spark, "Contract", CONTRACT_GROUPS)
    s = seg.segment_summary(df, "Contract").first()
    assert s.highest_key == "Month-to-month" and s.lowest_key == "Two year"
    assert s.total_types == 4
    rates = {r.key: (r.churn_rate, r.n) for r in seg.churn_by_contract(df).collect()}
    expect = round(sum(r * n for r, n in rates.values()) / sum(n for _, n in rates.values()), 4)
    assert abs(s.average_churn_rate - expect) < 1e-12
    m = seg.segment_metadata(df, "Contract").first()
    assert (m.total_customers, m.total_groups) == (7058, 4)


def test_summary_ties_pick_smaller_key(spark):
    df = counts_frame(spark, "Contract", [("b", 10, 5), ("a", 10, 5), ("c", 10, 1)])
    s = seg.segment_summary(df, "Contract").first()
    assert s.highest_key == "a" and s.lowest_key == "c"


def test_empty_summary(spark):
    df = counts_frame(spark, "Contract", CONTRACT_GROUPS).where(F.lit(False))
    s = seg.segment_summary(df, "Contract").first()
    assert s.highest_key is None and s.average_churn_rate == 0.0 and s.total_types == 0


def test_payment_vs_contract(spark):
    c = counts_frame(spark, "Contract", CONTRACT_GROUPS)
    p = counts_frame(spark, "PaymentMethod", PAYMENT_GROUPS)
    df = c.withColumn("PaymentMethod", F.lit(None).cast("string")).unionByName(
        p.withColumn("Contract", F.lit(None).cast("string")))
    r = seg.payment_vs_contract(df).first()
    assert r.contract_count == 4 and r.payment_count == 5
    assert r.higher_spread_segment in ("payment", "contract")
    assert r.payment_rate_spread == round(r.payment_highest_rate - r.payment_lowest_rate, 4)


def test_churned_mix_percentages(spark):
    df = counts_frame(spark, "Contract", CONTRACT_GROUPS).withColumn("PaymentMethod", F.lit("x"))
    rows = seg.churned_mix(df).where(F.col("segment") == "Contract").collect()
    assert abs(sum(r.pct for r in rows) - 100.0) < 1e-9
    assert {r.key for r in rows} == {"Month-to-month", "One year", "Two year", "Unknown", ""}


def _kpi_frame(spark, n, churned, tenure, monthly):
    return spark.range(n).select(
        F.when(F.col("id") < churned, "Yes").otherwise("No").alias("Churn"),
        F.lit(tenure).cast("double").alias("tenure"), F.lit(monthly).cast("double").alias("MonthlyCharges"))


def test_kpis_values(spark):
    r = kpis.compute_kpis(_kpi_frame(spark, 1000, 250, 32.456789, 64.789123)).first()
    assert (r.churned_users, r.churn_rate_overall, r.avg_tenure, r.avg_monthly) == (250, 0.25, 32.5, 64.8)
    r = kpis.compute_kpis(_kpi_frame(spark, 7043, 1869, 1.0, 1.0)).first()
    assert r.churn_rate_overall == 0.2654


def test_kpis_empty_and_null(spark):
    empty = _kpi_frame(spark, 10, 1, 1.0, 1.0).where(F.lit(False))
    r = kpis.compute_kpis(empty).first()
    assert (r.churned_users, r.churn_rate_overall, r.avg_tenure, r.avg_monthly) == (0, 0.0, 0.0, 0.0)
    nulls = _kpi_frame(spark, 10, 5, None, None)
    r = kpis.compute_kpis(nulls).first()
    assert (r.avg_tenure, r.avg_monthly, r.churn_rate_overall) == (0.0, 0.0, 0.5)


def test_implied_total(spark):
    r = kpis.implied_total(_kpi_frame(spark, 7043, 1869, 1.0, 1.0)).first()
    assert r.implied_total_customers == 7042 and r.total_customers == 7043   # lossy, as documented


def test_allow_listed_table(spark):
    import pytest
    _kpi_frame(spark, 10, 2, 1.0, 1.0).createOrReplaceTempView("customer_data")
    assert kpis.compute_kpis_for_table(spark, "customer_data").first().churned_users == 2
    with pytest.raises(ValueError):
        kpis.compute_kpis_for_table(spark, "orders")


def test_churned_averages_js_counts_nulls_in_denominator(spark):
    df = spark.createDataFrame([("Yes", 10, 50.0, "100"), ("Yes", None, None, " "), ("No", 99, 99.0, "1")],
                               "Churn string, tenure int, MonthlyCharges double, TotalCharges string")
    r = kpis.churned_averages_js(df).first()
    assert (r.churned, r.avg_tenure, r.avg_monthly, r.avg_total) == (2, 5.0, 25.0, 50.0)
    b = kpis.churned_averages(df).first()
    assert (b.avg_tenure, b.avg_total, b["count"]) == (10.0, 100.0, 2)


def test_rounded_ties_keep_unrounded_order(spark):
    # Both round to 0.3333; "z" (1/3) is higher unrounded than "a" (3333/10000).
    df = counts_frame(spark, "Contract", [("a", 10000, 3333), ("z", 3, 1), ("m", 10, 1)])
    rows = seg.churn_by_contract(df).collect()
    assert [r.key for r in rows] == ["z", "a", "m"]
    s = seg.segment_summary(df, "Contract").first()
    assert s.highest_key == "z" and s.lowest_key == "m"
