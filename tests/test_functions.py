import math

from pyspark.sql import functions as F

from churnscope.functions import scalar as sc
from churnscope.functions.bins import TENURE_BATCH, TENURE_API


def _one(spark, expr, schema="x double", rows=((None,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("r")).collect()


def test_safe_div(spark):
    df = spark.createDataFrame(
        [(10.0, 2.0), (10.0, 0.0), (None, 5.0), (10.0, None), (1.0, 1e-12), (float("inf"), 1.0)],
        "a double, b double")
    got = [r.r for r in df.select(sc.safe_div("a", "b").alias("r")).collect()]
    assert got == [5.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    got = [r.r for r in df.select(sc.safe_div("a", "b", -1.0).alias("r")).collect()]
    assert got == [5.0, -1.0, -1.0, -1.0, -1.0, -1.0]


def test_round_fp(spark):
    df = spark.createDataFrame([(0.26537,), (None,), (float("nan"),), (float("inf"),), (32.456789,)],
                               "x double")
    got = [r.r for r in df.select(sc.round_fp("x", 4).alias("r")).collect()]
    assert got[0] == 0.2654 and got[1] is None and got[2] is None and got[3] is None
    assert df.select(sc.round_fp("x", 1).alias("r")).collect()[4].r == 32.5


def test_safe_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (float("inf"),)], "x double")
    r = df.agg(sc.safe_mean("x").alias("m"), sc.safe_sum("x").alias("s"),
               sc.safe_count().alias("n"), sc.safe_count((F.col("x") > 2) & ~F.isnan("x")).alias("c"),
               sc.safe_count(F.col("x") > 2).alias("c_nan")).first()
    assert (r.m, r.s, r.n, r.c) == (2.0, 4.0, 5, 2)
    assert r.c_nan == 3   # Spark orders NaN above every number
    empty = df.where(F.lit(False)).agg(sc.safe_mean("x").alias("m"), sc.safe_sum("x").alias("s")).first()
    assert empty.m is None and empty.s == 0.0


def test_array_safe_mean(spark):
    df = spark.createDataFrame([([1.0, None, float("nan"), 3.0],), ([],)], "a array<double>")
    got = [r.r for r in df.select(sc.array_safe_mean("a").alias("r")).collect()]
    assert got == [2.0, None]


def test_to_number_coerce(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("invalid",), (None,), (" ",)], "c string")
    assert [r.r for r in df.select(sc.to_number("c", 0).alias("r")).collect()] == [1.0, 2.5, 0.0, 0.0, 0.0]
    assert [r.r for r in df.select(sc.to_number("c").alias("r")).collect()] == [1.0, 2.5, None, None, None]


def test_parse_or_zero(spark):
    df = spark.createDataFrame([("12abc",), ("  3.5",), ("x1",), (None,), ("-2e2z",), (".5",)], "c string")
    assert [r.r for r in df.select(sc.parse_or_zero("c").alias("r")).collect()] == \
        [12.0, 3.5, 0.0, 0.0, -200.0, 0.5]


def test_unknown_rules(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" One year",), ("Two year",)], "c string")
    blank = [r.r for r in df.select(sc.unknown_if_blank("c").alias("r")).collect()]
    assert blank == ["Unknown", "Unknown", "Unknown", " One year", "Two year"]
    null = [r.r for r in df.select(sc.unknown_if_null("c").alias("r")).collect()]
    assert null == ["Unknown", "", "  ", " One year", "Two year"]
    no = [r.r for r in df.select(sc.no_if_null("c").alias("r")).collect()]
    assert no[0] == "No" and no[1] == ""


def test_flags(spark):
    df = spark.createDataFrame([("Yes",), ("No",), (None,), ("No internet service",)], "c string")
    assert [r.r for r in df.select(sc.yes_flag("c").alias("r")).collect()] == [1, 0, 0, 0]


def test_right_closed_bins(spark):
    # create_bins docstring: 1 -> 0-12, 15 -> 13-24, 25 -> 25-48, 50 -> 49+, 100 -> 49+
    df = spark.createDataFrame([(1,), (15,), (25,), (50,), (100,), (0,), (-1,), (121,), (None,), (12,)],
                               "x int")
    got = [r.r for r in df.select(TENURE_BATCH.label(F.col("x")).alias("r")).collect()]
    assert got == ["0-12", "13-24", "25-48", "49+", "49+", "0-12", None, None, None, "0-12"]
    # The CASE form has open ends: negatives land in the first bin.
    api = [r.r for r in df.select(TENURE_API.label(F.col("x")).alias("r")).collect()]
    assert api[:6] == ["0–3", "13–24", "25+", "25+", "25+", "0–3"] and api[6] == "0–3"


def test_duplicate_edges_dropped(spark):
    df = spark.createDataFrame([(5.0,), (15.0,)], "x double")
    e = sc.right_closed_bins(F.col("x"), [0, 10, 10, 20], ["a", "b"])
    assert [r.r for r in df.select(e.alias("r")).collect()] == ["a", "b"]


def test_formatting(spark):
    df = spark.createDataFrame([(0.2654, 7043, 32.44)], "r double, n long, t double")
    r = df.select(sc.pct_text("r", 2).alias("p"), sc.thousands_text("n").alias("n"),
                  sc.fixed_text("t", 1).alias("t"), sc.pct_text("r", 1).alias("p1")).first()
    assert (r.p, r.n, r.t, r.p1) == ("26.54%", "7,043", "32.4", "26.5%")
    assert not math.isnan(0.0)


def test_clean_numeric_column(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("invalid",), (None,)], "col string")
    assert [r.col for r in sc.clean_numeric_column(df, "col", 0).collect()] == [1.0, 2.5, 0.0, 0.0]
    missing = sc.clean_numeric_column(df, "nope")
    assert missing.columns == ["nope"] and missing.count() == 0
