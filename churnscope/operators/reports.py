"""Summaries and reports assembled from the metric aggregates.

The batch summary (R1), the script summary (R2) and the dashboard payload
(R3) each come from ONE scan of the base and one plain aggregate over all
their keys together, of sums and counts (a row of the base is never expanded;
each task ships at most one row per combination of the few values of each
key).  ``GROUPING SETS`` then rolls that small result up to each key alone,
and everything after works on tens of rows regardless of data size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.bins import (
    MONTHLY_API, MONTHLY_BATCH, MONTHLY_JS, TENURE_API, TENURE_BATCH, TENURE_JS, BinDef)
from churnscope.functions.dims import literal_frame
from churnscope.functions.scalar import (
    churn_flag, fixed_text, no_if_null, parse_or_zero, pct_text, round_fp, safe_div,
    senior_filled, thousands_text, to_number, unknown_if_blank)
from churnscope.operators.features import DEFAULT_FEATURES, FEATURE_KEYS, validate_features
from churnscope.session import checkpoint_dir

# --- fixed values: columns the batch job fills with 'Unknown' ----------------
BATCH_CATEGORICAL = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
]
# -----------------------------------------------------------------------------


def _TINY():
    """Single-partition window: only ever applied to a few aggregated rows."""
    return Window.partitionBy()


def clean_batch(df: DataFrame) -> DataFrame:
    """SC9-SC11: numeric TotalCharges, SeniorCitizen NULL -> 0, NULL -> 'Unknown'
    in the 15 categorical columns (blanks stay)."""
    out = (df.withColumn("TotalCharges", to_number("TotalCharges"))
             .withColumn("SeniorCitizen", senior_filled()))
    return out.fillna("Unknown", subset=[c for c in BATCH_CATEGORICAL if c in df.columns])


def _sets_agg(df: DataFrame, keys: dict[str, Column], aggs: dict[str, tuple],
              zero_fill: dict[str, list[tuple[str, int]]] | None = None,
              post=None) -> DataFrame:
    """Aggregates by each key alone plus the grand total.

    ``aggs`` maps a name to ("count",), ("sum", column) or ("avg", column).
    Output: ``set`` (key name or 'total'), ``key`` (string), ``bin_order``
    (position of the key in ``zero_fill[set]``, else NULL), then ``aggs``.
    ``zero_fill`` adds every listed (set, key) even when absent (aggregates
    NULL).  ``post`` adds columns over the small aggregated frame (totals,
    ranks).  The result — a few dozen rows — is materialised once in a
    reliable checkpoint, so the scan + aggregate run exactly once and every
    report section afterwards is a plain filter/projection of it."""
    names = list(keys)
    alias = {k: f"_k{i}" for i, k in enumerate(names)}
    cols = [alias[k] for k in names]
    sums, rolled = [F.count(F.lit(1)).alias("_rows")], []
    for name, (kind, *of) in aggs.items():
        if kind == "count":
            rolled.append(F.sum("_rows").alias(name))
            continue
        sums.append(F.sum(of[0]).alias(f"_s_{name}"))
        total = F.sum(f"_s_{name}")
        if kind == "avg":
            sums.append(F.count(of[0]).alias(f"_n_{name}"))
            total = F.try_divide(total, F.sum(f"_n_{name}"))
        rolled.append(total.alias(name))
    small = df.groupBy(*[v.cast("string").alias(alias[k]) for k, v in keys.items()]).agg(*sums)
    g = small.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        *[F.grouping(c).alias(f"_g{c}") for c in cols], *rolled)
    # without rows the total is 0, as that of a plain count
    g = g.withColumns({name: F.coalesce(name, F.lit(0)) for name, (kind, *_) in aggs.items() if kind == "count"})
    which = F.lit("total")
    key = F.lit(None).cast("string")
    for k in reversed(names):
        c = alias[k]
        which = F.when(F.col(f"_g{c}") == 0, F.lit(k)).otherwise(which)
        key = F.when(F.col(f"_g{c}") == 0, F.col(c)).otherwise(key)
    agg_cols = [c for c in g.columns if c not in cols and not c.startswith("_g_k")]
    out = g.select(which.alias("set"), key.alias("key"), *agg_cols)
    spark = df.sparkSession
    fill = [(sname, lab, i) for sname, labs in (zero_fill or {}).items() for lab, i in labs]
    order = literal_frame(spark, fill, [("set", "string"), ("key", "string"), ("bin_order", "int")])
    if fill:
        # Union the zero rows in and re-aggregate: each (set, key) has at most
        # one real row and one fill row, so max() just picks the real value.
        z = order.select("set", "key", "bin_order",
                         *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in agg_cols])
        out = (out.withColumn("bin_order", F.lit(None).cast("int")).unionByName(z)
                  .groupBy("set", "key")
                  .agg(F.max("bin_order").alias("bin_order"), *[F.max(c).alias(c) for c in agg_cols]))
    else:
        out = out.withColumn("bin_order", F.lit(None).cast("int"))
    if post is not None:
        out = post(out)
    checkpoint_dir(spark)
    return out.checkpoint(eager=True)


def _grand(col: str) -> Column:
    """The 'total' row's value of ``col`` on every row (tiny frame window)."""
    return F.max(F.when(F.col("set") == "total", F.col(col))).over(_TINY())


def _rows(sec: str, key: Column, count: Column | None = None, pct: Column | None = None,
          rate: Column | None = None, value: Column | None = None) -> list[Column]:
    def d(c, t):
        return (c if c is not None else F.lit(None)).cast(t)
    return [F.lit(sec).alias("section"), key.cast("string").alias("key"),
            d(count, "long").alias("count"), d(pct, "double").alias("pct"),
            d(rate, "double").alias("churn_rate"), d(value, "double").alias("value")]


def _fill(bindef: BinDef) -> list[tuple[str, int]]:
    return [(lab, i) for i, lab in enumerate(bindef.labels)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- R1: batch clean -> bin -> aggregate --------------------------------------
def batch_summary(df: DataFrame) -> DataFrame:
    """R1 as a long frame (section, key, count, pct, churn_rate, value).

    Sections: averages (churned means, unrounded) and count, by_contract /
    by_payment (churned count and % of churned), tenure_ranges /
    monthly_charge_ranges (all batch bins, % of all churned), churn rate by
    contract / payment (percent, all customers), total_customers."""
    c = clean_batch(df)
    y = churn_flag()
    keys = {"Contract": F.col("Contract"), "PaymentMethod": F.col("PaymentMethod"),
            "tenure_range": TENURE_BATCH.label(F.col("tenure")),
            "monthly_charge_range": MONTHLY_BATCH.label(F.col("MonthlyCharges"))}
    g = _sets_agg(c, keys, {
        "n": ("count",), "churned": ("sum", y.cast("long")),
        "avg_tenure": ("avg", F.when(y == 1, F.col("tenure"))),
        "avg_monthly": ("avg", F.when(y == 1, F.col("MonthlyCharges"))),
        "avg_total": ("avg", F.when(y == 1, F.col("TotalCharges")))},
        zero_fill={"tenure_range": _fill(TENURE_BATCH),
                   "monthly_charge_range": _fill(MONTHLY_BATCH)},
        post=lambda t: t.withColumn("_total", _grand("churned")))
    tot = g.where(F.col("set") == "total")
    total = F.col("_total")
    parts = [
        tot.select(*_rows("averages", F.lit("avg_tenure"), value=F.col("avg_tenure"))),
        tot.select(*_rows("averages", F.lit("avg_monthly"), value=F.col("avg_monthly"))),
        tot.select(*_rows("averages", F.lit("avg_total"), value=F.col("avg_total"))),
        tot.select(*_rows("averages", F.lit("count"), count=F.col("churned"))),
        tot.select(*_rows("total_customers", F.lit("total"), count=F.col("n"))),
    ]
    for set_name, sec in (("Contract", "by_contract"), ("PaymentMethod", "by_payment")):
        s = g.where((F.col("set") == set_name) & (F.col("churned") > 0))
        parts.append(s.select(*_rows(sec, F.col("key"), F.col("churned"),
                                     safe_div("churned", total) * 100)))
    for set_name, sec in (("Contract", "churn_rate_by_contract"),
                          ("PaymentMethod", "churn_rate_by_payment")):
        s = g.where(F.col("set") == set_name)
        parts.append(s.select(*_rows(sec, F.col("key"),
                                     rate=F.col("churned") / F.col("n") * 100)))
    for set_name, sec in (("tenure_range", "tenure_ranges"),
                          ("monthly_charge_range", "monthly_charge_ranges")):
        s = g.where((F.col("set") == set_name) & F.col("bin_order").isNotNull())
        cnt = F.coalesce(F.col("churned"), F.lit(0))
        parts.append(s.select(*_rows(sec, F.col("key"), cnt, safe_div(cnt, total) * 100)))
    return _union(parts)


def summary_payload(long: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """R1 payload: one row, one nested struct, from the long summary frame."""
    def items(sec, name, *fields):
        # counts descending, then key; rates in the same way
        st = F.struct((-F.col(fields[0])).alias("_o"), F.col("key").alias(name), *[F.col(f) for f in fields])
        rows = F.sort_array(F.collect_list(F.when(F.col("section") == sec, st)))
        return F.transform(rows, lambda r: F.struct(r[name], *[r[f] for f in fields])).alias(sec)

    def avg_of(k):
        return F.max(F.when((F.col("section") == "averages") & (F.col("key") == k), F.col("value")))

    p = long.agg(
        F.struct(avg_of("avg_tenure").alias("avg_tenure"), avg_of("avg_monthly").alias("avg_monthly"),
                 avg_of("avg_total").alias("avg_total"),
                 F.max(F.when((F.col("section") == "averages") & (F.col("key") == "count"),
                              F.col("count"))).alias("count")).alias("averages"),
        items("by_contract", "key", "count", "pct"),
        items("by_payment", "key", "count", "pct"),
        items("tenure_ranges", "range", "count", "pct"),
        items("monthly_charge_ranges", "range", "count", "pct"),
        items("churn_rate_by_contract", "key", "churn_rate"),
        items("churn_rate_by_payment", "key", "churn_rate"),
        F.max(F.when(F.col("section") == "total_customers", F.col("count"))).alias("total_customers"))
    ts = generated_at if generated_at is not None else F.current_timestamp()
    return p.select(F.struct(*[c for c in p.columns], ts.cast("string").alias("generated_at"))
                    .alias("payload"))


# --- R2: dashboard-script summary ---------------------------------------------
def KEYS_JS(c: Column) -> Column:
    """A value as the dashboard script keys it: text, NULL -> 'null'."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def js_summary(df: DataFrame) -> DataFrame:
    """R2 long frame, one scan of the churned rows: churned total, 2-dp
    averages (NULL / unparseable add 0 but still count), churned mix by raw
    contract / payment value (2 dp), script tenure / charge bins (2 dp, all
    bins listed; a NULL value compares as 0)."""
    churned = df.where(F.col("Churn") == "Yes")
    keys = {"by_contract": KEYS_JS(F.col("Contract")), "by_payment": KEYS_JS(F.col("PaymentMethod")),
            "tenure_ranges": TENURE_JS.label(F.coalesce(F.col("tenure").cast("double"), F.lit(0.0))),
            "monthly_charge_ranges": MONTHLY_JS.label(F.coalesce(F.col("MonthlyCharges"), F.lit(0.0)))}
    g = _sets_agg(churned, keys, {
        "n": ("count",),
        "_st": ("sum", F.coalesce(F.col("tenure").cast("double"), F.lit(0.0))),
        "_sm": ("sum", F.coalesce(F.col("MonthlyCharges"), F.lit(0.0))),
        "_stc": ("sum", parse_or_zero("TotalCharges"))},
        zero_fill={"tenure_ranges": _fill(TENURE_JS), "monthly_charge_ranges": _fill(MONTHLY_JS)},
        post=lambda t: t.withColumn("_total", _grand("n")))
    tot = g.where(F.col("set") == "total")
    total = F.col("_total")
    parts = [tot.select(*_rows("totals", F.lit("churned"), count=F.col("n")))]
    for k, c in (("avgTenure", "_st"), ("avgMonthly", "_sm"), ("avgTotal", "_stc")):
        parts.append(tot.select(*_rows("averages", F.lit(k),
                                       value=F.round(safe_div(c, "n"), 2))))
    for sec in ("by_contract", "by_payment", "tenure_ranges", "monthly_charge_ranges"):
        s = g.where(F.col("set") == sec)
        cnt = F.coalesce(F.col("n"), F.lit(0))
        parts.append(s.select(*_rows(sec, F.col("key"), cnt, F.round(safe_div(cnt, total) * 100, 2))))
    return _union(parts)


# --- R3: dashboard payload (one scan) -----------------------------------------
def dashboard_aggregate(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Counts for every dashboard section in one GROUPING SETS aggregate, with
    bins and Yes/No feature keys zero-filled, rates and in-set ranks added."""
    feats = validate_features(features or DEFAULT_FEATURES)
    keys = {"contract": unknown_if_blank("Contract"), "payment": unknown_if_blank("PaymentMethod"),
            "tenure_bin": TENURE_API.label(F.col("tenure")),
            "monthly_bin": MONTHLY_API.label(F.col("MonthlyCharges"))}
    keys.update({f"feature:{f}": no_if_null(f) for f in feats})
    fill = {"tenure_bin": _fill(TENURE_API), "monthly_bin": _fill(MONTHLY_API)}
    fill.update({f"feature:{f}": [(k, 10 * i + j + 1) for j, k in enumerate(FEATURE_KEYS)]
                 for i, f in enumerate(feats)})

    def post(t: DataFrame) -> DataFrame:
        rate = F.coalesce(round_fp(safe_div("churned", "n"), 4), F.lit(0.0))
        known = F.col("bin_order").isNotNull()
        raw = safe_div("churned", "n")
        return (t.withColumn("_rate", rate)
                 .withColumn("_rank", F.row_number().over(
                     Window.partitionBy("set").orderBy(F.col("_rate").desc(), raw.desc(),
                                                       F.col("key"))))
                 .withColumn("_bin_total", F.sum(F.when(known, F.coalesce(F.col("churned"), F.lit(0))))
                             .over(Window.partitionBy("set"))))

    y = churn_flag()
    return _sets_agg(df, keys, {"n": ("count",), "churned": ("sum", y.cast("long")),
                                "avg_tenure": ("avg", F.col("tenure")), "avg_monthly": ("avg", F.col("MonthlyCharges"))},
                     zero_fill=fill, post=post)


def insight_payload_long(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """R3 as a long frame (section, item, sub_item, item_order, churn_rate, n,
    count, pct, value).

    Sections: overall_churn_rate, total_customers (re-derived as
    round(churned / rate), K6), churned_customers, average_tenure,
    average_monthly_charges, churn_by_contract, churn_by_payment (rate desc,
    key), churn_by_features (Yes/No rows per feature), tenure_distribution,
    monthly_charges_distribution (definition order)."""
    feats = validate_features(features or DEFAULT_FEATURES)
    g = dashboard_aggregate(df, feats)

    def row(section, item=None, sub=None, order=None, rate=None, n=None, count=None, pct=None,
            value=None):
        def d(c, t):
            return (c if c is not None else F.lit(None)).cast(t)
        return [F.lit(section).alias("section"), d(item, "string").alias("item"),
                d(sub, "string").alias("sub_item"), d(order, "int").alias("item_order"),
                d(rate, "double").alias("churn_rate"), d(n, "long").alias("n"),
                d(count, "long").alias("count"), d(pct, "double").alias("pct"),
                d(value, "double").alias("value")]

    tot = g.where(F.col("set") == "total")
    rate = F.col("_rate")
    churned = F.coalesce(F.col("churned"), F.lit(0))
    parts = [
        tot.select(*row("overall_churn_rate", order=F.lit(0), value=rate)),
        tot.select(*row("total_customers", order=F.lit(1),
                        count=F.when(rate > 0, F.round(churned / rate, 0)).otherwise(F.lit(0)))),
        tot.select(*row("churned_customers", order=F.lit(2), count=churned)),
        tot.select(*row("average_tenure", order=F.lit(3),
                        value=F.coalesce(round_fp("avg_tenure", 1), F.lit(0.0)))),
        tot.select(*row("average_monthly_charges", order=F.lit(4),
                        value=F.coalesce(round_fp("avg_monthly", 1), F.lit(0.0)))),
    ]
    for set_name, sec in (("contract", "churn_by_contract"), ("payment", "churn_by_payment")):
        s = g.where(F.col("set") == set_name)
        parts.append(s.select(*row(sec, item=F.col("key"), order=F.col("_rank"), rate=rate,
                                   n=F.col("n"))))
    fs = g.where(F.col("set").startswith("feature:") & F.col("bin_order").isNotNull())
    parts.append(fs.select(*row("churn_by_features", item=F.expr("substring(set, 9)"),
                                sub=F.col("key"), order=F.col("bin_order"), rate=rate,
                                n=F.coalesce(F.col("n"), F.lit(0)))))
    for set_name, sec in (("tenure_bin", "tenure_distribution"),
                          ("monthly_bin", "monthly_charges_distribution")):
        s = g.where((F.col("set") == set_name) & F.col("bin_order").isNotNull())
        parts.append(s.select(*row(sec, item=F.col("key"), order=F.col("bin_order"), count=churned,
                                   pct=F.coalesce(round_fp(safe_div(churned, "_bin_total"), 4),
                                                  F.lit(0.0)))))
    return _union(parts)


def insight_json(long: DataFrame) -> DataFrame:
    """The payload as JSON; NULL fields are omitted (``to_json`` default)."""
    sec = F.col("section")

    def scalar(name, col):
        return F.max(F.when(sec == name, F.col(col))).alias(name)

    def ordered(name, *fields):
        rows = F.sort_array(F.collect_list(F.when(sec == name, F.struct(
            F.col("item_order").alias("_o"), F.coalesce("sub_item", "item").alias("_k"), F.struct(*fields).alias("_r")))))
        return F.transform(rows, lambda r: r["_r"])

    def items(name, *fields):
        return ordered(name, *fields).alias(name)

    features = ordered("churn_by_features", F.col("item").alias("feature"), F.col("sub_item").alias("key"), "churn_rate", "n")
    names = F.array_distinct(F.transform(features, lambda r: r["feature"]))
    by_feature = F.map_from_arrays(names, F.transform(names, lambda f: F.transform(
        F.filter(features, lambda r: r["feature"] == f), lambda r: F.struct(r["key"], r["churn_rate"], r["n"]))))
    p = long.agg(F.count(F.lit(1)).alias("_rows"),
                 scalar("overall_churn_rate", "value"), scalar("total_customers", "count"),
                 scalar("churned_customers", "count"), scalar("average_tenure", "value"),
                 scalar("average_monthly_charges", "value"),
                 items("churn_by_contract", F.col("item").alias("key"), "churn_rate", "n"),
                 items("churn_by_payment", F.col("item").alias("key"), "churn_rate", "n"),
                 by_feature.alias("churn_by_features"),
                 items("tenure_distribution", F.col("item").alias("range"), "count", "pct"),
                 items("monthly_charges_distribution", F.col("item").alias("range"), "count", "pct"))
    payload = F.to_json(F.struct(*[c for c in p.columns if c != "_rows"]))
    return p.select(F.when(F.col("_rows") > 0, payload).otherwise(
        F.raise_error(F.lit("the payload has no rows"))).alias("payload_json"))


# --- R4 / IO6 / IO8: what a payload's JSON text says, as rows ---------------------
_KEYED = "array<struct<key:string,count:long,pct:double>>"
_RANGED = "array<struct<range:string,count:long,pct:double>>"
_RATED = "array<struct<key:string,churn_rate:double>>"
SUMMARY_JSON = (f"averages struct<avg_tenure:double,avg_monthly:double,avg_total:double,count:long>, by_contract {_KEYED}, "
                f"by_payment {_KEYED}, tenure_ranges {_RANGED}, monthly_charge_ranges {_RANGED}, churn_rate_by_contract {_RATED}, "
                f"churn_rate_by_payment {_RATED}, total_customers long")
_SEGMENT = "array<struct<key:string,churn_rate:double,n:long>>"
INSIGHT_JSON = ("overall_churn_rate double, total_customers long, churned_customers long, average_tenure double, "
                f"average_monthly_charges double, churn_by_contract {_SEGMENT}, churn_by_payment {_SEGMENT}, "
                f"churn_by_features map<string,{_SEGMENT}>, tenure_distribution {_RANGED}, monthly_charges_distribution {_RANGED}")


def json_fields(texts: DataFrame, schema: str, col: str = "json") -> DataFrame:
    """The content of payload JSON as rows (field, feature, position, name, count, rate, value).

    A list gives a row per element, with its position; a map of lists a row per
    element with its key as ``feature``; numbers one row.  Times and ids are not
    part of ``schema`` and are left out."""
    parsed = texts.select(F.from_json(F.col(col), schema).alias("p"))
    none = lambda t: F.lit(None).cast(t)

    def rows(df: DataFrame, field: str, kind, feature: Column) -> DataFrame:
        names = kind.elementType.names
        pick = lambda wanted, t: next((F.col(f"e.{n}") for n in names if n in wanted), none(t))
        return df.select(F.lit(field).alias("field"), feature.alias("feature"), F.col("pos").alias("position"),
                         pick(("key", "range"), "string").alias("name"), pick(("count", "n"), "long").alias("count"),
                         pick(("churn_rate", "pct"), "double").alias("rate"), none("double").alias("value"))

    def one(field: str, value: Column) -> DataFrame:
        return parsed.select(F.lit(field).alias("field"), none("string").alias("feature"), none("int").alias("position"),
                             none("string").alias("name"), none("long").alias("count"), none("double").alias("rate"),
                             value.cast("double").alias("value"))

    parts = []
    for f in parsed.schema["p"].dataType.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            parts.append(rows(parsed.select(F.posexplode(f"p.{f.name}").alias("pos", "e")), f.name, f.dataType, none("string")))
        elif kind == "map":
            each = parsed.select(F.explode(f"p.{f.name}").alias("feature", "list")).select("feature", F.posexplode("list").alias("pos", "e"))
            parts.append(rows(each, f.name, f.dataType.valueType, F.col("feature")))
        elif kind == "struct":
            parts += [one(f"{f.name}.{n}", F.col(f"p.{f.name}.{n}")) for n in f.dataType.names]
        else:
            parts.append(one(f.name, F.col(f"p.{f.name}")))
    return _union(parts)


# --- R5 / R6 -----------------------------------------------------------------
# Report section titles and line formats.
SECTION_TITLES = {
    1: "## Overall Metrics",
    2: "## Churn by Subscription Plan",
    3: "## Churn by Payment Method",
    4: "## Churn by Service Features",
    5: "## Churned Subscribers by Tenure",
    6: "## Churned Subscribers by Monthly Cost",
    7: "## Predictive Model Insights",
}
REPORT_FEATURES = 5  # model features listed


def model_lines(auc: float | None, features: Sequence[tuple[str, float]]) -> list[str]:
    """R5's model section: its AUC ('N/A' without one) and, if it has features,
    the first five of them (feature, weight) with the direction of their effect (M15)."""
    lines = [f"- Model Performance (AUC): {'N/A' if auc is None else auc}"]
    if features:
        lines.append("- Most Important Predictive Features:")
    for place, (name, weight) in enumerate(features[:REPORT_FEATURES], 1):
        effect = "increases" if weight > 0 else "decreases"
        lines.append(f"  {place}. {name} ({effect} churn likelihood)")
    return lines


def report_lines(long: DataFrame, model: tuple[float | None, Sequence[tuple[str, float]]] | None = None) -> DataFrame:
    """(section_no, line_no, text) lines of the text report, formatted as
    percent (2 dp / 1 dp), thousands separators and fixed decimals; absent
    sections are skipped.  ``model``: the AUC and the top features (feature,
    weight) of a trained model, for the last section."""
    s = F.col("section")
    overall = (
        F.when(s == "overall_churn_rate", F.concat(F.lit("- Overall Churn Rate: "), pct_text("value", 2)))
         .when(s == "total_customers", F.concat(F.lit("- Total Subscribers: "), thousands_text("count")))
         .when(s == "churned_customers", F.concat(F.lit("- Churned Subscribers: "), thousands_text("count")))
         .when(s == "average_tenure", F.concat(F.lit("- Average Subscription Tenure: "),
                                               fixed_text("value", 1), F.lit(" months")))
         .when(s == "average_monthly_charges", F.concat(F.lit("- Average Monthly Subscription Cost: $"),
                                                        fixed_text("value", 2))))
    seg_line = F.concat(F.lit("- "), F.col("item"), F.lit(": "), pct_text("churn_rate", 2),
                        F.lit(" churn rate ("), thousands_text("n"), F.lit(" subscribers)"))
    feat_line = F.concat(F.lit("- "), F.col("sub_item"), F.lit(": "), pct_text("churn_rate", 2),
                         F.lit(" churn rate ("), thousands_text("n"), F.lit(" subscribers)"))
    ten_line = F.concat(F.lit("- "), F.col("item"), F.lit(" months: "), thousands_text("count"),
                        F.lit(" subscribers ("), pct_text("pct", 1), F.lit(")"))
    mon_line = F.concat(F.lit("- $"), F.col("item"), F.lit(": "), thousands_text("count"),
                        F.lit(" subscribers ("), pct_text("pct", 1), F.lit(")"))
    sec_no = (F.when(s.isin("overall_churn_rate", "total_customers", "churned_customers",
                            "average_tenure", "average_monthly_charges"), 1)
               .when(s == "churn_by_contract", 2).when(s == "churn_by_payment", 3)
               .when(s == "churn_by_features", 4).when(s == "tenure_distribution", 5)
               .when(s == "monthly_charges_distribution", 6))
    text = (F.when(sec_no == 1, overall).when(sec_no.isin(2, 3), seg_line)
             .when(sec_no == 4, feat_line).when(sec_no == 5, ten_line).otherwise(mon_line))
    body = long.select(sec_no.alias("section_no"), F.col("item_order").alias("_k"), text.alias("text"))
    if model is not None:
        told = [(7, k, line) for k, line in enumerate(model_lines(*model))]
        body = body.unionByName(literal_frame(
            long.sparkSession, told, [("section_no", "int"), ("_k", "int"), ("text", "string")]))
    title = F.element_at(F.create_map(*[x for k, v in SECTION_TITLES.items()
                                        for x in (F.lit(k), F.lit(v))]), F.col("section_no"))
    heads = body.select("section_no").distinct().select("section_no", F.lit(-1).alias("_k"),
                                                        title.alias("text"))
    # One "### Feature" heading per feature, just before its Yes/No lines.
    fheads = (long.where(s == "churn_by_features").groupBy("item")
                  .agg(F.min("item_order").alias("_o"))
                  .select(F.lit(4).alias("section_no"), (F.col("_o") - 1).alias("_k"),
                          F.concat(F.lit("### "), F.col("item")).alias("text")))
    rows = body.unionByName(heads).unionByName(fheads)
    # A section has tens of lines at most; numbering runs per section.
    w = Window.partitionBy("section_no").orderBy("_k")
    return (rows.select("section_no", F.row_number().over(w).alias("line_no"), "text")
                .orderBy("section_no", "line_no"))


def data_points(long: DataFrame) -> DataFrame:
    """1 (overall rate) + contract rows + payment rows + feature rows."""
    s = F.col("section")
    return long.agg((F.count_if(s == "overall_churn_rate")
                     + F.count_if(s == "churn_by_contract")
                     + F.count_if(s == "churn_by_payment")
                     + F.count_if(s == "churn_by_features")).alias("data_points"))
