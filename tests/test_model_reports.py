import hashlib

from pyspark.sql import functions as F

from churnscope.operators import model as M
from churnscope.operators import reports as rep

RAW = [("a", "Yes", 12, 85.0, "Month-to-month", "Electronic check", "No", None),
       ("b", "No", 24, 65.0, "One year", None, "Yes", "Yes"),
       ("c", "Yes", None, 45.0, None, "Credit card (automatic)", None, "No"),
       ("d", "No", 36, None, "Two year", "Bank transfer (automatic)", "Yes", "Yes"),
       ("e", "Yes", 6, 95.0, "Month-to-month", "Electronic check", "No", "No")]
SCHEMA = ("customerID string, Churn string, tenure int, MonthlyCharges double, Contract string, "
          "PaymentMethod string, OnlineSecurity string, TechSupport string")


def test_impute_encode(spark):
    df = spark.createDataFrame(RAW, SCHEMA).select(
        "customerID", F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("churn"),
        "tenure", "MonthlyCharges", "Contract", "PaymentMethod", "OnlineSecurity", "TechSupport")
    med = M.medians(df)
    assert med == {"tenure": 18.0, "MonthlyCharges": 75.0}
    out = {r.customerID: r for r in M.impute_encode(df, med).collect()}
    assert out["c"].tenure == 18.0 and out["d"].MonthlyCharges == 75.0
    assert out["c"].Contract == "Unknown" and out["b"].PaymentMethod == "Unknown"
    assert out["a"].TechSupport == 0 and out["b"].OnlineSecurity == 1


def test_one_hot_drop_first(spark):
    clean = spark.createDataFrame(RAW, SCHEMA).where(F.col("customerID") != "c") \
                 .where(F.col("customerID") != "b") \
                 .unionByName(spark.createDataFrame(
                     [("b", "No", 24, 65.0, "One year", "Credit card (automatic)", "Yes", "Yes")], SCHEMA))
    base = M.training_set(clean.withColumn("MonthlyCharges", F.coalesce("MonthlyCharges", F.lit(45.0))))
    cats = M.categories(base)
    names = M.feature_names(cats)
    assert len(names) == 8
    assert names[:4] == ["tenure", "MonthlyCharges", "OnlineSecurity", "TechSupport"]
    assert "Contract_Month-to-month" not in names and "Contract_One year" in names
    assert "PaymentMethod_Bank transfer (automatic)" not in names


def test_rank_auc_matches_bruteforce(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1), (0, 0.1), (0, 0.05), (1, 0.7)]
    df = spark.createDataFrame(rows, "churn int, score double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    from test_properties import round_half_up
    assert M.rank_auc(df).first().auc == round_half_up(brute, 4)


def test_split_is_stable_and_near_fraction(spark):
    df = spark.range(20000).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("customerID"),
                                 (F.col("id") % 4 == 0).cast("int").alias("churn"))
    a = M.with_split(df).where("is_test").count()
    assert abs(a / 20000 - M.TEST_FRACTION) < 0.02
    assert M.with_split(df).where("is_test").count() == a


def test_train_save_load(spark, tmp_path):
    from conftest import SF_SMALL
    from churnscope.sources.subscriptions import subscriptions
    base = subscriptions(spark, SF_SMALL)
    model, metrics = M.load_or_train(base, str(tmp_path / "m"), retrain=True)
    assert metrics["total_features"] == len(metrics["coefficients"])
    assert 0.5 < metrics["auc"] <= 1.0
    m2, met2 = M.load(spark, str(tmp_path / "m"))
    assert met2["coefficients"] == metrics["coefficients"]
    top = M.top_features(M.coefficients_frame(spark, metrics)).collect()
    assert len(top) == 10 and abs(top[0].weight) >= abs(top[-1].weight)
    info = M.model_info(spark, str(tmp_path / "m")).first()
    assert info.model_exists and info.total_features == metrics["total_features"]
    assert not M.model_info(spark, str(tmp_path / "none")).first().model_exists


def _payload(spark):
    """The sample payload: 7,043 customers, 26.54 % churn, short form."""
    rows = [
        ("overall_churn_rate", None, None, 0, None, None, None, None, 0.2654),
        ("total_customers", None, None, 1, None, None, 7043, None, None),
        ("churned_customers", None, None, 2, None, None, 1869, None, None),
        ("average_tenure", None, None, 3, None, None, None, None, 32.4),
        ("average_monthly_charges", None, None, 4, None, None, None, None, 64.8),
        ("churn_by_contract", "Month-to-month", None, 1, 0.4273, 3875, None, None, None),
        ("churn_by_contract", "Two year", None, 2, 0.0283, 1695, None, None, None),
        ("churn_by_payment", "Electronic check", None, 1, 0.4528, 2365, None, None, None),
        ("churn_by_features", "OnlineSecurity", "Yes", 1, 0.1461, 2019, None, None, None),
        ("churn_by_features", "OnlineSecurity", "No", 2, 0.4177, 3498, None, None, None),
        ("tenure_distribution", "0–3", None, 0, None, None, 245, 0.1311, None),
    ]
    return spark.createDataFrame(rows, "section string, item string, sub_item string, item_order int, "
                                       "churn_rate double, n long, count long, pct double, value double")


def test_report_lines_format(spark):
    lines = [r.text for r in rep.report_lines(_payload(spark)).collect()]
    assert "- Overall Churn Rate: 26.54%" in lines
    assert "- Total Subscribers: 7,043" in lines
    assert "- Average Subscription Tenure: 32.4 months" in lines
    assert "- Month-to-month: 42.73% churn rate (3,875 subscribers)" in lines
    assert "- Electronic check: 45.28% churn rate (2,365 subscribers)" in lines
    assert "### OnlineSecurity" in lines
    assert "- 0–3 months: 245 subscribers (13.1%)" in lines
    assert lines[0] == "## Overall Metrics"


def test_report_model_section(spark):
    plain = [tuple(r) for r in rep.report_lines(_payload(spark)).collect()]
    top = [("tenure", -1.2), ("MonthlyCharges", 0.8), ("a", 0.0), ("it's", 0.3), ("c", -0.2), ("d", 0.1)]
    lines = [tuple(r) for r in rep.report_lines(_payload(spark), (0.8412, top)).collect()]
    assert lines[:len(plain)] == plain
    assert [t for n, _, t in lines if n == 7] == [
        "## Predictive Model Insights", "- Model Performance (AUC): 0.8412", "- Most Important Predictive Features:",
        "  1. tenure (decreases churn likelihood)", "  2. MonthlyCharges (increases churn likelihood)",
        "  3. a (decreases churn likelihood)", "  4. it's (increases churn likelihood)",
        "  5. c (decreases churn likelihood)"]
    assert rep.model_lines(None, []) == ["- Model Performance (AUC): N/A"]


def test_data_points(spark):
    # 1 overall + 2 contract + 1 payment + 2 feature rows = 6
    assert rep.data_points(_payload(spark)).first().data_points == 6


def test_insight_json_drops_nulls(spark):
    js = rep.insight_json(_payload(spark)).first().payload_json
    assert '"overall_churn_rate":0.2654' in js and '"n":null' not in js


def test_split_cuts_each_class_exactly(spark):
    rows = [(f"{k:05d}", int(k % 17 == 0)) for k in range(2000)] + [("lone", 2), (None, 0)]
    got = M.with_split(spark.createDataFrame(rows, "customerID string, churn int")).collect()
    assert len(got) == len(rows)
    for label in (0, 1, 2):
        ids = sorted((r[0] for r in rows if r[1] == label and r[0]), key=lambda x: hashlib.md5(x.encode()).hexdigest())
        assert {r.customerID for r in got if r.churn == label and r.is_test} == set(ids[:int(len(ids) * 0.2 + 0.5)])
    assert M.with_split(spark.createDataFrame([], "customerID string, churn int")).count() == 0
