"""Registered queries over the subscription base with their DuckDB oracles."""

from __future__ import annotations

from churnscope.operators import segments as seg
from churnscope.plans.oracle import with_base
from churnscope.plans.registry import on_base

# Shared SQL fragments (DuckDB).
UNK_CONTRACT = "case when Contract is null or trim(Contract) = '' then 'Unknown' else Contract end"
UNK_PAYMENT = "case when PaymentMethod is null or trim(PaymentMethod) = '' then 'Unknown' else PaymentMethod end"
CHURN = "case when Churn = 'Yes' then 1 else 0 end"


def _seg_sql(key_expr: str, raw: bool = False) -> str:
    extra = f", sum({CHURN})::double / count(*) as raw_rate" if raw else ""
    return f"""
select {key_expr} as key,
       round(sum({CHURN})::double / count(*), 4) as churn_rate,
       count(*) as n{extra}
from subs group by 1"""


# --- G1 / G2 ----------------------------------------------------------------
on_base("churn_by_contract", with_base(_seg_sql(UNK_CONTRACT)))(seg.churn_by_contract)
on_base("churn_by_payment", with_base(_seg_sql(UNK_PAYMENT)))(seg.churn_by_payment)


# --- IO1-IO3, IO5: scans ------------------------------------------------------
from churnscope.sources import subscriptions as src  # noqa: E402

on_base("subscriptions_scan", with_base("select * from subs"))(src.require_rows)
on_base("churned_scan", with_base("select * from subs where Churn = 'Yes'"))(src.churned_scan)
on_base("model_input_scan", with_base(f"""
select {CHURN} as churn, tenure, MonthlyCharges, Contract, PaymentMethod, OnlineSecurity, TechSupport
from subs where tenure is not null and MonthlyCharges is not null"""))(src.model_input_scan)
on_base("sample_rows", with_base("select * from subs order by customerID limit 3"))(src.sample_rows)


# --- K1-K6, R7, G10, H14, M14: overall metrics -------------------------------
from pyspark.sql import functions as F  # noqa: E402

from churnscope.operators import kpis  # noqa: E402
from churnscope.plans.registry import register  # noqa: E402
from churnscope.sources.subscriptions import churn_customers  # noqa: E402

KPI_SQL = f"""
select coalesce(sum({CHURN}), 0)::bigint as churned_users,
       coalesce(round(sum({CHURN})::double / nullif(count(*), 0), 4), 0.0) as churn_rate_overall,
       coalesce(round(avg(tenure), 1), 0.0) as avg_tenure,
       coalesce(round(avg(MonthlyCharges), 1), 0.0) as avg_monthly
from subs"""
on_base("kpis", with_base(KPI_SQL))(kpis.compute_kpis)


@register("kpis_table", with_base(KPI_SQL))
def _kpis_table(spark, sf_dir):
    """K2: KPIs over the allow-listed catalog table ``churn_customers``."""
    churn_customers(spark, sf_dir)
    return kpis.compute_kpis_for_table(spark, "churn_customers")


on_base("kpis_meta", with_base(f"""
select coalesce(sum({CHURN}), 0)::bigint as churned_users,
       coalesce(round(sum({CHURN})::double / nullif(count(*), 0), 4), 0.0) as churn_rate_overall,
       coalesce(round(avg(tenure), 1), 0.0) as avg_tenure,
       coalesce(round(avg(MonthlyCharges), 1), 0.0) as avg_monthly,
       count(*) as total_records, 'churn_customers' as table_name
from subs"""))(lambda df: kpis.kpis_with_metadata(df, with_timestamp=False))


@on_base("churned_averages", with_base("""
select round(avg(tenure), 6) as avg_tenure, round(avg(MonthlyCharges), 6) as avg_monthly,
       round(avg(try_cast(TotalCharges as double)), 6) as avg_total, count(*) as count
from subs where Churn = 'Yes'"""))
def _churned_averages(df):
    """K4 (means rounded to 6 dp only for the value comparison)."""
    a = kpis.churned_averages(df)
    return a.select(*[F.round(c, 6).alias(c) for c in ("avg_tenure", "avg_monthly", "avg_total")], "count")


JS_NUM = r"coalesce(try_cast(regexp_extract(TotalCharges, '^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)', 1) as double), 0.0)"
on_base("churned_averages_js", with_base(f"""
select count(*) as churned,
  round(case when count(*) = 0 then 0.0 else sum(coalesce(tenure, 0))::double / count(*) end, 2) as avg_tenure,
  round(case when count(*) = 0 then 0.0 else sum(coalesce(MonthlyCharges, 0.0)) / count(*) end, 2) as avg_monthly,
  round(case when count(*) = 0 then 0.0 else sum({JS_NUM}) / count(*) end, 2) as avg_total
from subs where Churn = 'Yes'"""))(kpis.churned_averages_js)

on_base("implied_total", with_base(f"""
select churned_users, rate as churn_rate_overall,
       case when rate > 0 then cast(round(churned_users / rate) as bigint) else 0 end as implied_total_customers,
       total_customers
from (select coalesce(sum({CHURN}), 0)::bigint as churned_users, count(*) as total_customers,
             coalesce(round(sum({CHURN})::double / nullif(count(*), 0), 4), 0.0) as rate from subs)"""))(
    kpis.implied_total)

on_base("readiness", with_base(f"""
select count(*) as total_rows, count_if(Churn = 'Yes')::bigint as churned_rows,
       count(distinct {UNK_CONTRACT}) as contract_types,
       count(distinct {UNK_PAYMENT}) as payment_methods,
       count_if(Churn = 'Yes' and tenure is not null)::bigint as churned_with_tenure,
       count_if(Churn = 'Yes' and MonthlyCharges is not null)::bigint as churned_with_charges,
       count_if(tenure is not null and MonthlyCharges is not null)::bigint as model_usable_rows
from subs"""))(kpis.readiness)

on_base("churned_with_value", with_base("""
select count_if(Churn = 'Yes' and tenure is not null)::bigint as churned_with_tenure,
       count_if(Churn = 'Yes' and MonthlyCharges is not null)::bigint as churned_with_charges
from subs"""))(kpis.churned_with_value)

on_base("model_usable_rows", with_base("""
select count_if(tenure is not null and MonthlyCharges is not null)::bigint as usable_rows from subs"""))(
    kpis.model_usable_rows)

on_base("distinct_segments", with_base(f"""
select count(distinct {UNK_CONTRACT}) as contract_types, count(distinct {UNK_PAYMENT}) as payment_methods
from subs"""))(seg.distinct_segments)


# --- G3-G13: segment metadata, summaries, comparison, mixes -------------------
def _meta_sql(key_expr):
    return with_base(f"select coalesce(sum(n), 0)::bigint as total_customers, count(*) as total_groups "
                     f"from ({_seg_sql(key_expr)}) g")


on_base("contract_meta", _meta_sql(UNK_CONTRACT))(lambda df: seg.segment_metadata(df, "Contract"))
on_base("payment_meta", _meta_sql(UNK_PAYMENT))(lambda df: seg.segment_metadata(df, "PaymentMethod"))


def _summary_sql(key_expr):
    return with_base(f"""
select first(key order by churn_rate desc, raw_rate desc, key) as highest_key,
       first(churn_rate order by churn_rate desc, raw_rate desc, key) as highest_rate,
       first(n order by churn_rate desc, raw_rate desc, key) as highest_n,
       first(key order by churn_rate, raw_rate desc, key) as lowest_key,
       first(churn_rate order by churn_rate, raw_rate desc, key) as lowest_rate,
       first(n order by churn_rate, raw_rate desc, key) as lowest_n,
       coalesce(round(sum(churn_rate * n) / nullif(sum(n), 0), 4), 0.0) as average_churn_rate,
       count(*) as total_types
from ({_seg_sql(key_expr, raw=True)}) g""")


on_base("contract_summary", _summary_sql(UNK_CONTRACT))(lambda df: seg.segment_summary(df, "Contract"))
on_base("payment_summary", _summary_sql(UNK_PAYMENT))(lambda df: seg.segment_summary(df, "PaymentMethod"))

_CMP_CTES = f"""
g as (select 'PaymentMethod' as seg, * from ({_seg_sql(UNK_PAYMENT)})
      union all select 'Contract' as seg, * from ({_seg_sql(UNK_CONTRACT)})),
a as (select coalesce(max(case when seg = 'PaymentMethod' then churn_rate end), 0.0) as payment_highest_rate,
             coalesce(min(case when seg = 'PaymentMethod' then churn_rate end), 0.0) as payment_lowest_rate,
             count_if(seg = 'PaymentMethod')::bigint as payment_count,
             coalesce(max(case when seg = 'Contract' then churn_rate end), 0.0) as contract_highest_rate,
             coalesce(min(case when seg = 'Contract' then churn_rate end), 0.0) as contract_lowest_rate,
             count_if(seg = 'Contract')::bigint as contract_count
      from g),
c as (select *, round(payment_highest_rate - payment_lowest_rate, 4) as payment_rate_spread,
             round(contract_highest_rate - contract_lowest_rate, 4) as contract_rate_spread from a)"""
on_base("payment_vs_contract", with_base("""
select *, case when payment_rate_spread > contract_rate_spread then 'payment' else 'contract' end as higher_spread_segment,
       coalesce(round(case when abs(contract_rate_spread) < 1e-10 then 0.0
                           else payment_rate_spread / contract_rate_spread end, 4), 0.0) as payment_vs_contract_spread_ratio
from c""", _CMP_CTES))(seg.payment_vs_contract)

on_base("spread_bars", with_base("""
select 'payment' as segment, payment_rate_spread as spread,
       round(case when abs(greatest(payment_rate_spread, contract_rate_spread)) < 1e-10 then 0.0
             else payment_rate_spread / greatest(payment_rate_spread, contract_rate_spread) end * 100, 2) as bar_pct from c
union all
select 'contract', contract_rate_spread,
       round(case when abs(greatest(payment_rate_spread, contract_rate_spread)) < 1e-10 then 0.0
             else contract_rate_spread / greatest(payment_rate_spread, contract_rate_spread) end * 100, 2) from c""",
    _CMP_CTES))(seg.spread_bars)


def _two_segments(select_for):
    return " union all ".join(select_for(s) for s in ("Contract", "PaymentMethod"))


on_base("batch_churn_rate", with_base(_two_segments(lambda s: f"""
select '{s}' as segment, coalesce({s}, 'Unknown') as key,
       sum({CHURN})::double / count(*) * 100 as churn_rate from subs group by 2""")))(seg.batch_churn_rate)


def _mix_sql(key_fmt, digits=None):
    pct = "count::double / sum(count) over (partition by segment) * 100"
    if digits is not None:
        pct = f"round({pct}, {digits})"
    inner = _two_segments(lambda s: f"""
select '{s}' as segment, {key_fmt.format(c=s)} as key, count(*) as count
from subs where Churn = 'Yes' group by 2""")
    return with_base(f"select segment, key, count, {pct} as pct from ({inner}) m")


on_base("churned_mix", _mix_sql("coalesce({c}, 'Unknown')"))(seg.churned_mix)
on_base("churned_mix_js", _mix_sql("coalesce(cast({c} as varchar), 'null')", 2))(
    lambda df: seg.churned_mix(df, rule="js", digits=2))

on_base("segment_shares", with_base(_two_segments(lambda s: f"""
select '{s}' as segment, key, n, churn_rate,
       round(n::double / sum(n) over () * 100, 1) as share_pct,
       round(churn_rate * 100, 2) as churn_rate_pct, round(churn_rate * 100, 1) as churn_rate_label
from ({_seg_sql(UNK_CONTRACT if s == 'Contract' else UNK_PAYMENT)})""")))(seg.segment_shares)
