"""Registered queries: bins, features, churned profile, Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.functions import scalar as sc
from churnscope.functions.bins import (
    MONTHLY_API, MONTHLY_BATCH, MONTHLY_JS, TENURE_API, TENURE_BATCH, TENURE_JS, BinDef)
from churnscope.operators import features as feat
from churnscope.operators import histograms as hist
from churnscope.operators import profile
from churnscope.plans.oracle import with_base
from churnscope.plans.queries_core import CHURN, UNK_CONTRACT
from churnscope.plans.registry import on_base


def _case(col: str, b: BinDef, null_outside: bool) -> str:
    """SQL CASE for a bin definition (mirrors ``BinDef.label``)."""
    e, labs = list(b.edges), list(b.labels)
    parts = []
    if null_outside:
        parts.append(f"when {col} is null or {col} < {e[0]} then null")
    for i, lab in enumerate(labs):
        if not null_outside and i == len(labs) - 1:
            parts.append(f"else '{lab}'")
        else:
            parts.append(f"when {col} <= {e[i + 1]} then '{lab}'")
    return "case " + " ".join(parts) + " end"


def _dim(b: BinDef) -> str:
    rows = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(b.labels))
    return f"(select * from (values {rows}) t(\"range\", bin_order))"


def _hist_ctes(col: str, b: BinDef) -> str:
    return f"""
hc as (select {_case(col, b, False)} as "range", count(*) as count
       from subs where Churn = 'Yes' and {col} is not null group by 1),
h as (select d."range", coalesce(hc.count, 0) as count,
             coalesce(round(coalesce(hc.count, 0)::double
                            / nullif(sum(coalesce(hc.count, 0)) over (), 0), 4), 0.0) as pct,
             d.bin_order
      from {_dim(b)} d left join hc on hc."range" = d."range")"""


# --- H1/H2 (+ H3-H5 via the dimension join) --------------------------------
for _name, _col, _b in (("tenure_bins", "tenure", TENURE_API),
                        ("monthly_bins", "MonthlyCharges", MONTHLY_API)):
    on_base(_name, with_base('select "range", count, pct, bin_order from h', _hist_ctes(_col, _b)))(
        (lambda c, b: lambda df: hist.histogram(df, c, b))(_col, _b))
    # H6
    on_base(_name + "_meta", with_base(
        f"""select sum(count)::bigint as total_churned, count(*) as n_bins,
                  '{"|".join(_b.labels)}' as bin_labels, '{"|".join(str(e) for e in _b.edges)}' as bin_edges
           from h""", _hist_ctes(_col, _b)))(
        (lambda c, b: lambda df: hist.histogram_metadata(df, c, b))(_col, _b))
    # H7
    on_base(_name + "_summary", with_base(
        """select first("range" order by count desc, bin_order) as highest_count_range,
                  first(count order by count desc, bin_order) as highest_count,
                  first("range" order by count, bin_order) as lowest_count_range,
                  first(count order by count, bin_order) as lowest_count,
                  first("range" order by pct desc, bin_order) as most_common_range,
                  first(pct order by pct desc, bin_order) as most_common_pct,
                  sum(count)::bigint as total_churned_analyzed
           from h""", _hist_ctes(_col, _b)))(
        (lambda c, b: lambda df: hist.histogram_summary(df, c, b))(_col, _b))


def _insight_sql(col, b, split, kind, text_a, text_b, dom_fmt):
    return with_base(f"""
select * from (
  select '{kind}' as type, null::varchar as "range", pa as pct_a, pb as pct_b,
         cast(pa as varchar) || '{text_a}' || cast(pb as varchar) || '{text_b}' as insight
  from (select round(a::double / (a + b) * 100, 1) as pa, round(b::double / (a + b) * 100, 1) as pb, a + b as t
        from (select sum(case when bin_order < {split} then count else 0 end) as a,
                     sum(case when bin_order >= {split} then count else 0 end) as b from h))
  where t > 0
  union all
  select 'dominant_range', mr, round(mp * 100, 6), null::double,
         printf('{dom_fmt}', round(mp * 100, 1), mr)
  from (select first("range" order by pct desc, bin_order) as mr, first(pct order by pct desc, bin_order) as mp from h)
  where mp > 0)""", _hist_ctes(col, b))


on_base("tenure_insights", _insight_sql(
    "tenure", TENURE_API, 3, "early_vs_late_churn",
    "% of churned customers left within first year, ", "% after first year",
    "Most churned customers (%.1f%%) are in the %s months tenure range"))(hist.tenure_insights)
on_base("monthly_insights", _insight_sql(
    "MonthlyCharges", MONTHLY_API, 2, "low_vs_high_charges_churn",
    "% of churned customers have low charges ($0-65), ", "% have high charges ($66+)",
    "Most churned customers (%.1f%%) are in the $%s monthly charges range"))(hist.monthly_insights)

# --- H10-H13 ----------------------------------------------------------------
on_base("batch_binned", with_base(f"""
select customerID, tenure, MonthlyCharges,
       {_case('tenure', TENURE_BATCH, True)} as tenure_range,
       {_case('MonthlyCharges', MONTHLY_BATCH, True)} as monthly_charge_range
from subs"""))(hist.batch_binned)

for _name, _col, _b in (("batch_tenure_mix", "tenure", TENURE_BATCH),
                        ("batch_monthly_mix", "MonthlyCharges", MONTHLY_BATCH)):
    on_base(_name, with_base(f"""
select d."range", coalesce(c.count, 0) as count,
       coalesce(coalesce(c.count, 0)::double / nullif((select count(*) from subs where Churn = 'Yes'), 0), 0.0) * 100 as pct,
       d.bin_order
from {_dim(_b)} d left join
     (select {_case(_col, _b, True)} as "range", count(*) as count from subs where Churn = 'Yes' group by 1) c
  on c."range" = d."range" """))((lambda c, b: lambda df: hist.batch_bin_mix(df, c, b))(_col, _b))

_JS_BINS_SQL = " union all ".join(f"""
select '{c}' as attribute, d."range", coalesce(x.count, 0) as count,
       round(coalesce(coalesce(x.count, 0)::double / nullif(sum(coalesce(x.count, 0)) over (), 0), 0.0) * 100, 2) as pct,
       d.bin_order
from {_dim(b)} d left join
     (select {_case(f'coalesce(cast({c} as double), 0.0)', b, False)} as "range", count(*) as count
      from subs where Churn = 'Yes' group by 1) x on x."range" = d."range" """
    for c, b in (("tenure", TENURE_JS), ("MonthlyCharges", MONTHLY_JS)))
on_base("js_bins", with_base(f"select * from ({_JS_BINS_SQL})"))(hist.js_bins)


# --- F1, F4, F5, F7 ---------------------------------------------------------
_ALL = feat.ALLOWED_FEATURES
_FEAT_DIM = ", ".join(f"('{f}', '{k}', {i}, {j})" for i, f in enumerate(_ALL)
                      for j, k in enumerate(feat.FEATURE_KEYS))
_FEAT_CTES = f"""
fc as ({" union all ".join(f"select '{f}' as feature, coalesce({f}, 'No') as key, count(*) as n, "
                            f"sum({CHURN}) as churned from subs group by 2" for f in _ALL)}),
fr as (select d.feature, d.key, coalesce(round(fc.churned::double / nullif(fc.n, 0), 4), 0.0) as churn_rate,
              coalesce(fc.n, 0) as n, d.feature_order, d.key_order
       from (select * from (values {_FEAT_DIM}) t(feature, key, feature_order, key_order)) d
       left join fc on fc.feature = d.feature and fc.key = d.key),
fw as (select feature, feature_order,
              max(case when key = 'Yes' then churn_rate end) as yes_churn_rate,
              max(case when key = 'No' then churn_rate end) as no_churn_rate,
              max(case when key = 'Yes' then n end) as yes_customers,
              max(case when key = 'No' then n end) as no_customers
       from fr group by feature, feature_order)"""

on_base("feature_churn", with_base("select * from fr", _FEAT_CTES))(
    lambda df: feat.feature_churn(df, _ALL))
on_base("feature_meta", with_base(f"""
select '{",".join(_ALL)}' as analyzed_features, sum(n)::bigint as total_feature_combinations,
       '{",".join(_ALL)}' as available_features from fr""", _FEAT_CTES))(
    lambda df: feat.feature_metadata(df, _ALL))
on_base("feature_impact", with_base("""
select feature, yes_churn_rate, no_churn_rate, churn_reduction, yes_customers, no_customers, rank,
       rank = 1 as is_best, rank = count(*) over () as is_worst
from (select *, row_number() over (order by churn_reduction desc, feature_order)::integer as rank
      from (select *, round(no_churn_rate - yes_churn_rate, 4) as churn_reduction from fw
            where yes_customers > 0 and no_customers > 0))""", _FEAT_CTES))(
    lambda df: feat.feature_impact(df, _ALL))
on_base("feature_chart_series", with_base("""
select feature, yes_churn_rate * 100 as yes_pct, no_churn_rate * 100 as no_pct,
       yes_customers as yes_n, no_customers as no_n, feature_order from fw""", _FEAT_CTES))(
    lambda df: feat.feature_chart_series(df, _ALL))


# --- G9: churned profile ------------------------------------------------------
def _profile_sql() -> str:
    cats = " union all ".join(
        f"select '{a}' as attribute, coalesce(cast({c} as varchar), 'null') as value, count(*) as count "
        f"from ch group by 2" for a, c in profile.PROFILE_ATTRIBUTES)
    bins = " union all ".join(f"""
select '{a}' as attribute, d."range" as value, coalesce(x.count, 0) as count from {_dim(b)} d
left join (select {_case(f'coalesce(cast({c} as double), 0.0)', b, False)} as "range", count(*) as count
           from ch group by 1) x on x."range" = d."range" """
        for a, c, b in profile.PROFILE_BINS)
    return with_base(f"""
select attribute, value, count,
       round(count::double / (select count(*) from ch) * 100, 1) as pct
from ({cats} union all {bins})""", "ch as (select * from subs where Churn = 'Yes')")


on_base("churned_profile", _profile_sql())(profile.churned_profile)


# --- SC1-SC15 as Column functions over the base --------------------------------
_NUM = "try_cast(TotalCharges as double)"
on_base("clean_columns", with_base(f"""
select customerID,
  {_NUM} as total_charges_num,
  coalesce({_NUM}, 0.0) as total_charges_filled,
  coalesce(SeniorCitizen, 0) as senior_citizen,
  {UNK_CONTRACT} as contract_key,
  coalesce(PaymentMethod, 'Unknown') as payment_key,
  coalesce(OnlineSecurity, 'No') as online_security_key,
  case when OnlineSecurity = 'Yes' then 1 else 0 end as online_security_flag,
  coalesce(try_cast(regexp_extract(TotalCharges, '^\\s*([-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?)', 1) as double), 0.0) as total_charges_js,
  {CHURN} as churn,
  case when {_NUM} is null or tenure is null or abs(tenure) < 1e-10 then 0.0
       else round({_NUM} / tenure, 4) end as charge_per_month,
  round(MonthlyCharges, 1) as monthly_1dp,
  {_case('tenure', TENURE_BATCH, True)} as tenure_range
from subs"""))(lambda df: df.select(
    "customerID",
    sc.to_number("TotalCharges").alias("total_charges_num"),
    sc.to_number("TotalCharges", 0.0).alias("total_charges_filled"),
    sc.senior_filled().alias("senior_citizen"),
    sc.unknown_if_blank("Contract").alias("contract_key"),
    sc.unknown_if_null("PaymentMethod").alias("payment_key"),
    sc.no_if_null("OnlineSecurity").alias("online_security_key"),
    sc.yes_flag("OnlineSecurity").alias("online_security_flag"),
    sc.parse_or_zero("TotalCharges").alias("total_charges_js"),
    sc.churn_flag().alias("churn"),
    F.coalesce(sc.round_fp(sc.safe_div(sc.to_number("TotalCharges"), "tenure"), 4),
               F.lit(0.0)).alias("charge_per_month"),
    sc.round_fp("MonthlyCharges", 1).alias("monthly_1dp"),
    TENURE_BATCH.label(F.col("tenure")).alias("tenure_range")))

on_base("safe_aggregates", with_base(f"""
select round(avg({_NUM}), 4) as mean_total_charges,
       round(coalesce(sum({_NUM}), 0.0), 2) as sum_total_charges,
       count(*) as n_rows, count_if(Churn = 'Yes')::bigint as n_churned,
       count_if({_NUM} is null)::bigint as n_unparseable
from subs"""))(lambda df: df.agg(
    F.round(sc.safe_mean(sc.to_number("TotalCharges")), 4).alias("mean_total_charges"),
    F.round(sc.safe_sum(sc.to_number("TotalCharges")), 2).alias("sum_total_charges"),
    sc.safe_count().alias("n_rows"),
    sc.safe_count(F.col("Churn") == "Yes").alias("n_churned"),
    sc.safe_count(sc.to_number("TotalCharges").isNull()).alias("n_unparseable")))
