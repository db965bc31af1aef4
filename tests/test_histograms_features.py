import pytest
from pyspark.sql import functions as F

from churnscope.functions.bins import MONTHLY_API, TENURE_API
from churnscope.operators import features as feat
from churnscope.operators import histograms as hist
from churnscope.operators import profile


def test_tenure_bins_fixture(spark):
    rows = [(t, "Yes") for t in (1, 3, 5, 6, 10, 12, 18, 24, 30, 60)] + [(15, "No"), (None, "Yes")]
    df = spark.createDataFrame(rows, "tenure int, Churn string")
    out = hist.tenure_bins(df).collect()
    assert [r.range for r in out] == list(TENURE_API.labels)
    assert all(r["count"] == 2 and r.pct == 0.2 for r in out)
    assert hist.histogram_metadata(df, "tenure", TENURE_API).first().total_churned == 10


def test_monthly_bins_fixture(spark):
    rows = [(m, "Yes") for m in (25.0, 35.0, 45.0, 65.0, 75.0, 95.0, 105.0, 150.0)] + \
        [(80.0, "No"), (None, "Yes")]
    df = spark.createDataFrame(rows, "MonthlyCharges double, Churn string")
    out = hist.monthly_bins(df).collect()
    assert [r.range for r in out] == list(MONTHLY_API.labels)
    assert all(r["count"] == 2 and r.pct == 0.25 for r in out)


def test_zero_fill_and_order(spark):
    shuffled = spark.createDataFrame([("25+", 10, 0.5), ("0–3", 20, 0.5), ("junk", 1, 0.1)],
                                     "`range` string, count long, pct double")
    done = hist.complete_bins(shuffled, TENURE_API).collect()
    assert [r.range for r in done] == list(TENURE_API.labels)          # unknown dropped
    assert [r["count"] for r in done] == [20, 0, 0, 0, 10]
    ordered = hist.order_bins(shuffled, TENURE_API).collect()
    assert [r.range for r in ordered] == ["0–3", "25+", "junk"]          # unknown last


def test_summary_ties_first_in_order(spark):
    rows = [(1, "Yes"), (5, "Yes")]       # bins 0-3 and 4-6 tie at 1; others 0
    df = spark.createDataFrame(rows, "tenure int, Churn string")
    s = hist.histogram_summary(df, "tenure", TENURE_API).first()
    assert s.highest_count_range == "0–3" and s.lowest_count_range == "7–12"
    assert s.most_common_range == "0–3" and s.total_churned_analyzed == 2


def test_tenure_insights(spark):
    rows = [(t, "Yes") for t in (1, 2, 3, 30)]
    df = spark.createDataFrame(rows, "tenure int, Churn string")
    out = {r.type: r for r in hist.tenure_insights(df).collect()}
    assert out["early_vs_late_churn"].insight == \
        "75.0% of churned customers left within first year, 25.0% after first year"
    assert out["dominant_range"].insight == \
        "Most churned customers (75.0%) are in the 0–3 months tenure range"


def test_empty_insights(spark):
    df = spark.createDataFrame([(1, "No")], "tenure int, Churn string")
    assert hist.tenure_insights(df).count() == 0


FEATURE_ROWS = [("Yes", "Yes", "Yes"), ("Yes", "No", "No"), ("No", "Yes", "Yes"), ("No", "No", "Yes"),
                ("Yes", "Yes", "No"), ("No", "No", "No"), (None, "Yes", "Yes"), ("Yes", None, "No")]


def test_feature_churn_null_is_no(spark):
    df = spark.createDataFrame(FEATURE_ROWS, "OnlineSecurity string, TechSupport string, Churn string")
    out = {(r.feature, r.key): r for r in feat.feature_churn(df).collect()}
    assert out[("OnlineSecurity", "Yes")].n == 4 and out[("OnlineSecurity", "No")].n == 4
    assert out[("OnlineSecurity", "Yes")].churn_rate == 0.25
    assert out[("OnlineSecurity", "No")].churn_rate == 0.75
    assert out[("TechSupport", "No")].n == 4


def test_feature_absent_key_zero_and_dropped_values(spark):
    df = spark.createDataFrame([("DSL", "Yes"), ("No", "No")], "InternetService string, Churn string")
    out = {r.key: r for r in feat.feature_churn(df, ["InternetService"]).collect()}
    assert set(out) == {"Yes", "No"}
    assert out["Yes"].n == 0 and out["Yes"].churn_rate == 0.0
    assert out["No"].n == 1


def test_validate_and_parse():
    assert feat.validate_features([]) == feat.DEFAULT_FEATURES
    assert feat.validate_features(["Bogus", "TechSupport"]) == ["TechSupport"]
    with pytest.raises(ValueError):
        feat.validate_features(["Bogus"])
    assert feat.parse_feature_names(" TechSupport, ,OnlineBackup ") == ["TechSupport", "OnlineBackup"]


def test_feature_impact(spark):
    df = spark.createDataFrame(FEATURE_ROWS, "OnlineSecurity string, TechSupport string, Churn string")
    rows = feat.feature_impact(df).collect()
    assert rows[0].is_best and rows[-1].is_worst
    assert rows[0].feature == "OnlineSecurity" and rows[0].churn_reduction == 0.5


def test_profile_zero_bins(spark):
    df = spark.createDataFrame([("Male", 1, 5, 20.0, "Yes")],
                               "gender string, SeniorCitizen int, tenure int, MonthlyCharges double, "
                               "Churn string")
    for c in [c for _, c in profile.PROFILE_ATTRIBUTES if c not in ("gender", "SeniorCitizen")]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = {(r.attribute, r.value): r for r in profile.churned_profile(df).collect()}
    assert out[("tenureRanges", "0-12")]["count"] == 1 and out[("tenureRanges", "49+")]["count"] == 0
    assert out[("seniorCitizen", "1")].pct == 100.0 and out[("contract", "null")]["count"] == 1
