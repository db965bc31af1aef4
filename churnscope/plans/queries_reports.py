"""Registered queries: reports (R1-R6), customers (P1-P5), sinks and SQL args
(IO4, IO6, IO8), streaming (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.functions.bins import (
    MONTHLY_API, MONTHLY_BATCH, TENURE_API, TENURE_BATCH)
from churnscope.operators import customers as cust
from churnscope.operators import reports as rep
from churnscope.operators.features import DEFAULT_FEATURES, FEATURE_KEYS
from churnscope.plans.oracle import with_base
from churnscope.plans.queries_core import CHURN, UNK_CONTRACT, UNK_PAYMENT, _seg_sql
from churnscope.operators.features import ALLOWED_FEATURES
from churnscope.plans.queries_dist import _FEAT_CTES, _JS_BINS_SQL, _case, _dim, _hist_ctes
from churnscope.plans.registry import on_base, register
from churnscope.sources import base_table, sinks
from churnscope.sources.subscriptions import SUBSCRIPTION_COLUMNS, churned_scan, subscriptions
from churnscope.streaming import running


# --- R1: batch summary (long form) -------------------------------------------
_R1_CTES = f"""
cb as (select *, try_cast(TotalCharges as double) as tc_num,
              coalesce(Contract, 'Unknown') as c_key, coalesce(PaymentMethod, 'Unknown') as p_key,
              {_case('tenure', TENURE_BATCH, True)} as tr,
              {_case('MonthlyCharges', MONTHLY_BATCH, True)} as mr,
              {CHURN} as y from subs),
tc as (select count_if(y = 1)::bigint as tch from cb)"""


def _r1_bins(col, b, sec):
    return f"""
select '{sec}', d."range", coalesce(x.c, 0)::bigint,
       coalesce(coalesce(x.c, 0)::double / nullif((select tch from tc), 0), 0.0) * 100, null::double, null::double
from {_dim(b)} d left join (select {col} as r, count(*) as c from cb where y = 1 group by 1) x on x.r = d."range" """


_R1_SQL = f"""
select 'averages' as section, 'avg_tenure' as key, null::bigint as count, null::double as pct,
       null::double as churn_rate, round(avg(case when y = 1 then tenure end), 6) as value from cb
union all select 'averages', 'avg_monthly', null, null, null, round(avg(case when y = 1 then MonthlyCharges end), 6) from cb
union all select 'averages', 'avg_total', null, null, null, round(avg(case when y = 1 then tc_num end), 6) from cb
union all select 'averages', 'count', count_if(y = 1)::bigint, null, null, null from cb
union all select 'total_customers', 'total', count(*), null, null, null from cb
union all select 'by_contract', c_key, count(*), count(*)::double / (select tch from tc) * 100, null, null
          from cb where y = 1 group by c_key
union all select 'by_payment', p_key, count(*), count(*)::double / (select tch from tc) * 100, null, null
          from cb where y = 1 group by p_key
union all select 'churn_rate_by_contract', c_key, null, null, sum(y)::double / count(*) * 100, null from cb group by c_key
union all select 'churn_rate_by_payment', p_key, null, null, sum(y)::double / count(*) * 100, null from cb group by p_key
union all {_r1_bins('tr', TENURE_BATCH, 'tenure_ranges')}
union all {_r1_bins('mr', MONTHLY_BATCH, 'monthly_charge_ranges')}"""

on_base("batch_summary", with_base(_R1_SQL, _R1_CTES))(
    lambda df: rep.batch_summary(df).withColumn("value", F.round("value", 6)))


@register("summary_snapshot")
def _snapshot(spark, sf_dir):
    """IO6: append the batch summary payload as a snapshot; return the row."""
    from churnscope.sources.subscriptions import require_rows
    payload = rep.summary_payload(rep.batch_summary(require_rows(subscriptions(spark, sf_dir))))
    path = running.scratch(spark, "snapshots")
    sinks.append_snapshot(payload, path)
    return sinks.latest_snapshot(spark, path)


@on_base("summary_json")
def _summary_json(df):
    """IO8: the batch summary payload as JSON text."""
    return sinks.to_json_lines(rep.summary_payload(rep.batch_summary(df)))


_LISTS = "('by_contract', 'by_payment', 'tenure_ranges', 'monthly_charge_ranges', 'churn_rate_by_contract', 'churn_rate_by_payment')"
_SUMMARY_FIELDS_SQL = with_base(f"""
select section as field, null::varchar as feature,
       (row_number() over (partition by section order by coalesce(count::double, churn_rate) desc, key) - 1)::integer as position,
       key as name, count, round(coalesce(pct, churn_rate), 6) as rate, null::double as value
from r1 where section in {_LISTS}
union all
select case section when 'averages' then 'averages.' || key else 'total_customers' end, null, null, null, null, null,
       round(coalesce(value, count), 6)
from r1 where section in ('averages', 'total_customers')""", _R1_CTES + f""",
r1 as ({_R1_SQL})""")


def _summary_fields(texts):
    return rep.json_fields(texts, rep.SUMMARY_JSON).withColumns(
        {"rate": F.round("rate", 6), "value": F.round("value", 6)})


on_base("summary_json_fields", _SUMMARY_FIELDS_SQL)(
    lambda df: _summary_fields(sinks.to_json_lines(rep.summary_payload(rep.batch_summary(df)))))


@register("snapshot_fields", _SUMMARY_FIELDS_SQL)
def _snapshot_fields(spark, sf_dir):
    """IO6: what the latest of two appended snapshots says."""
    payload = rep.summary_payload(rep.batch_summary(subscriptions(spark, sf_dir)))
    path = running.scratch(spark, "snapshots")
    for _ in range(2):
        sinks.append_snapshot(payload, path)
    return _summary_fields(sinks.to_json_lines(sinks.latest_snapshot(spark, path)))


# --- R2: dashboard-script summary ------------------------------------------------
_MIX_JS = " union all ".join(f"""
select '{s}' as segment, coalesce(cast({s} as varchar), 'null') as key, count(*) as count
from subs where Churn = 'Yes' group by 2""" for s in ("Contract", "PaymentMethod"))
_R2_CTES = f"""
ja as (select count(*) as churned,
         round(case when count(*) = 0 then 0.0 else sum(coalesce(tenure, 0))::double / count(*) end, 2) as avg_tenure,
         round(case when count(*) = 0 then 0.0 else sum(coalesce(MonthlyCharges, 0.0)) / count(*) end, 2) as avg_monthly,
         round(case when count(*) = 0 then 0.0 else sum(coalesce(try_cast(regexp_extract(TotalCharges,
               '^\\s*([-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?)', 1) as double), 0.0)) / count(*) end, 2) as avg_total
       from subs where Churn = 'Yes'),
jm as (select segment, key, count, round(count::double / sum(count) over (partition by segment) * 100, 2) as pct
       from ({_MIX_JS})),
jb as ({_JS_BINS_SQL})"""
on_base("js_summary", with_base("""
select 'totals' as section, 'churned' as key, churned::bigint as count, null::double as pct,
       null::double as churn_rate, null::double as value from ja
union all select 'averages', 'avgTenure', null, null, null, avg_tenure from ja
union all select 'averages', 'avgMonthly', null, null, null, avg_monthly from ja
union all select 'averages', 'avgTotal', null, null, null, avg_total from ja
union all select case when segment = 'Contract' then 'by_contract' else 'by_payment' end, key, count, pct, null, null from jm
union all select case when attribute = 'tenure' then 'tenure_ranges' else 'monthly_charge_ranges' end,
                 "range", count, pct, null, null from jb""", _R2_CTES))(rep.js_summary)

# --- R3, R5, R6: dashboard payload, report lines, data points ---------------------
_FD = ", ".join(f"('{f}', '{k}', {10 * i + j + 1})" for i, f in enumerate(DEFAULT_FEATURES)
                for j, k in enumerate(FEATURE_KEYS))
_FC = " union all ".join(f"select '{f}' as feature, coalesce({f}, 'No') as key, count(*) as n, "
                         f"sum({CHURN}) as churned from subs group by 2" for f in DEFAULT_FEATURES)


def _dist(col, b, sec, tag):
    ctes = _hist_ctes(col, b).replace("hc as", f"hc{tag} as").replace("from hc", f"from hc{tag}") \
        .replace("hc.", f"hc{tag}.").replace("h as", f"h{tag} as").replace("join hc ", f"join hc{tag} ")
    return ctes, (f"select '{sec}', \"range\", null, bin_order, null, null, count, pct, null from h{tag}")


_T_CTES, _T_SEL = _dist("tenure", TENURE_API, "tenure_distribution", "t")
_M_CTES, _M_SEL = _dist("MonthlyCharges", MONTHLY_API, "monthly_charges_distribution", "m")
_R3_CTES = f"""
tt as (select count(*) as n, sum({CHURN})::bigint as churned, avg(tenure) as avg_t, avg(MonthlyCharges) as avg_m from subs),
tr as (select *, coalesce(round(churned::double / nullif(n, 0), 4), 0.0) as rate from tt),
fc as ({_FC}),
fr as (select d.feature, d.key, d.item_order, coalesce(round(fc.churned::double / nullif(fc.n, 0), 4), 0.0) as churn_rate,
              coalesce(fc.n, 0) as n
       from (select * from (values {_FD}) t(feature, key, item_order)) d
       left join fc on fc.feature = d.feature and fc.key = d.key),
{_T_CTES.strip()},
{_M_CTES.strip()},
ipl as (
  select 'overall_churn_rate' as section, null::varchar as item, null::varchar as sub_item, 0 as item_order,
         null::double as churn_rate, null::bigint as n, null::bigint as count, null::double as pct, rate as value from tr
  union all select 'total_customers', null, null, 1, null, null,
         case when rate > 0 then cast(round(coalesce(churned, 0) / rate) as bigint) else 0 end, null, null from tr
  union all select 'churned_customers', null, null, 2, null, null, coalesce(churned, 0), null, null from tr
  union all select 'average_tenure', null, null, 3, null, null, null, null, coalesce(round(avg_t, 1), 0.0) from tr
  union all select 'average_monthly_charges', null, null, 4, null, null, null, null, coalesce(round(avg_m, 1), 0.0) from tr
  union all select 'churn_by_contract', key, null, row_number() over (order by churn_rate desc, raw_rate desc, key),
                   churn_rate, n, null, null, null
            from ({_seg_sql(UNK_CONTRACT, raw=True)})
  union all select 'churn_by_payment', key, null, row_number() over (order by churn_rate desc, raw_rate desc, key),
                   churn_rate, n, null, null, null
            from ({_seg_sql(UNK_PAYMENT, raw=True)})
  union all select 'churn_by_features', feature, key, item_order, churn_rate, n, null, null, null from fr
  union all {_T_SEL}
  union all {_M_SEL})"""

on_base("insight_payload", with_base(
    "select section, item, sub_item, item_order::integer as item_order, churn_rate, n, count, pct, value from ipl",
    _R3_CTES))(rep.insight_payload_long)

on_base("data_points", with_base("""
select (count_if(section = 'overall_churn_rate')::bigint + count_if(section = 'churn_by_contract')::bigint
        + count_if(section = 'churn_by_payment')::bigint + count_if(section = 'churn_by_features')::bigint)::bigint as data_points
from ipl""", _R3_CTES))(lambda df: rep.data_points(rep.insight_payload_long(df)))


@on_base("insight_json")
def _insight_json(df):
    """Payload JSON with NULL fields dropped."""
    return rep.insight_json(rep.insight_payload_long(df))


on_base("insight_json_fields", with_base("""
select section as field, case when section = 'churn_by_features' then item end as feature,
       (row_number() over (partition by section, case when section = 'churn_by_features' then item end order by item_order) - 1)::integer as position,
       coalesce(sub_item, item) as name, coalesce(count, n) as count, coalesce(churn_rate, pct) as rate, null::double as value
from ipl where section like 'churn_by%' or section like '%distribution'
union all
select section, null, null, null, null, null, coalesce(value, count)::double
from ipl where not (section like 'churn_by%' or section like '%distribution')""", _R3_CTES))(
    lambda df: rep.json_fields(rep.insight_json(rep.insight_payload_long(df)), rep.INSIGHT_JSON, "payload_json"))


def _titles_values():
    return ", ".join(f"({k}, '{v}')" for k, v in rep.SECTION_TITLES.items())


_PCT2 = "printf('%.2f%%', round(churn_rate * 100, 2))"
_R5_SQL = f"""
select section_no, row_number() over (partition by section_no order by k)::integer as line_no, text from (
  select sn as section_no, item_order as k,
    case
      when section = 'overall_churn_rate' then '- Overall Churn Rate: ' || printf('%.2f%%', round(value * 100, 2))
      when section = 'total_customers' then '- Total Subscribers: ' || format('{{:,}}', count)
      when section = 'churned_customers' then '- Churned Subscribers: ' || format('{{:,}}', count)
      when section = 'average_tenure' then '- Average Subscription Tenure: ' || printf('%.1f', round(value, 1)) || ' months'
      when section = 'average_monthly_charges' then '- Average Monthly Subscription Cost: $' || printf('%.2f', round(value, 2))
      when sn in (2, 3) then '- ' || item || ': ' || {_PCT2} || ' churn rate (' || format('{{:,}}', n) || ' subscribers)'
      when sn = 4 then '- ' || sub_item || ': ' || {_PCT2} || ' churn rate (' || format('{{:,}}', n) || ' subscribers)'
      when sn = 5 then '- ' || item || ' months: ' || format('{{:,}}', count) || ' subscribers ('
                       || printf('%.1f%%', round(pct * 100, 1)) || ')'
      else '- $' || item || ': ' || format('{{:,}}', count) || ' subscribers (' || printf('%.1f%%', round(pct * 100, 1)) || ')'
    end as text
  from (select *, case when section in ('overall_churn_rate', 'total_customers', 'churned_customers',
                                        'average_tenure', 'average_monthly_charges') then 1
                       when section = 'churn_by_contract' then 2 when section = 'churn_by_payment' then 3
                       when section = 'churn_by_features' then 4 when section = 'tenure_distribution' then 5
                       else 6 end as sn from ipl)
  union all
  select t.sn, -1, t.title from (values {_titles_values()}) t(sn, title)
  union all
  select 4, min(item_order) - 1, '### ' || item from ipl where section = 'churn_by_features' group by item
  union all
  select * from (values
    (7, 0, '- Model Performance (AUC): 0.8412'), (7, 1, '- Most Important Predictive Features:'),
    (7, 2, '  1. tenure (decreases churn likelihood)'), (7, 3, '  2. Contract_Two year (decreases churn likelihood)'),
    (7, 4, '  3. MonthlyCharges (increases churn likelihood)')) m(section_no, k, text))"""

# The trained model's values depend on the solver, so its section gets a fixed record here.
on_base("report_lines", with_base(_R5_SQL, _R3_CTES))(
    lambda df: rep.report_lines(rep.insight_payload_long(df), (
        0.8412, [("tenure", -1.3052), ("Contract_Two year", -0.9), ("MonthlyCharges", 0.7411)])))


# --- P1-P5: customer list -------------------------------------------------------
_PARSE = r"coalesce(try_cast(regexp_extract(cast({c} as varchar), '^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)', 1) as double), 0.0)"
_LIST_COLS = ("customerID, gender, " + _PARSE.format(c="SeniorCitizen") + " as SeniorCitizen, Partner, Dependents, "
              + _PARSE.format(c="tenure") + " as tenure, PhoneService, MultipleLines, InternetService, "
              "OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies, "
              "Contract, PaperlessBilling, PaymentMethod, " + _PARSE.format(c="MonthlyCharges")
              + " as MonthlyCharges, " + _PARSE.format(c="TotalCharges") + " as TotalCharges, Churn")

# Fixed request parameters for the registered list queries.
PAGE_NO, TERM, AFTER = 3, "00001", "00000000000000012000-AUTOM"

on_base("customer_page", with_base(
    f"select {_LIST_COLS} from subs order by customerID limit 20 offset {(PAGE_NO - 1) * 20}"))(
    lambda df: cust.page(df, PAGE_NO))
on_base("customer_search", with_base(
    f"select * from subs where customerID ilike '%{TERM}%'"))(lambda df: cust.search(df, f"  {TERM} "))
on_base("customer_search_page", with_base(
    f"select {_LIST_COLS} from subs where customerID ilike '%{TERM}%' order by customerID limit 20 offset 20"))(
    lambda df: cust.page(df, 2, TERM))
on_base("page_stats", with_base(f"""
select count(*) as total_count, ceil(count(*) / 20)::bigint as total_pages,
       {(PAGE_NO - 1) * 20 + 1}::bigint as start_index,
       least({PAGE_NO * 20}, count(*))::bigint as end_index
from subs where customerID ilike '%{TERM}%'"""))(lambda df: cust.page_stats(df, PAGE_NO, TERM))
on_base("keyset_page", with_base(
    f"select {_LIST_COLS} from subs where customerID > '{AFTER}' order by customerID limit 20"))(
    lambda df: cust.keyset_page(df, AFTER))


DEEP_PAGE = 50


def _indexed(spark, sf_dir):
    """A written base and its positional index."""
    path = running.scratch(spark, "paged")
    base_table.append_batch(subscriptions(spark, sf_dir), path, "base")
    rows = base_table.read_base(spark, path)
    cust.build_page_index(rows, f"{path}/index", rows_per_range=1_000)
    return rows, spark.read.parquet(f"{path}/index")


@register("deep_page", with_base(f"select {_LIST_COLS} from subs order by customerID limit 20 offset {(DEEP_PAGE - 1) * 20}"))
def _deep_page(spark, sf_dir):
    """P1 on the written base: a page far into the list, through the positional index."""
    rows, index = _indexed(spark, sf_dir)
    return cust.indexed_page(rows, index, DEEP_PAGE)


@register("deep_page_stats", with_base(f"""
select count(*) as total_count, ceil(count(*) / 20)::bigint as total_pages, {(DEEP_PAGE - 1) * 20 + 1}::bigint as start_index,
       least({DEEP_PAGE * 20}, count(*))::bigint as end_index from subs"""))
def _deep_stats(spark, sf_dir):
    """P3 from the positional index alone."""
    return cust.index_stats(_indexed(spark, sf_dir)[1], DEEP_PAGE)


def _u_sql(salt):
    return (f"(cast(('0x' || substr(md5(customerID || ':{salt}'), 1, 8)) as bigint)::double / 4294967296.0)")


def _choice_sql(salt, opts):
    idx = f"cast(floor({_u_sql(salt)} * {len(opts)}) as integer)"
    return "case " + " ".join(f"when {idx} = {i} then '{o}'" for i, o in enumerate(opts)) + " end"


_LET = "cast(('0x' || substr(md5(customerID || ':letters'), 1, 8)) as bigint)"
_GEN_SQL = f"""
select cast(cast(floor({_u_sql('id')} * 90000) + 10000 as integer) as varchar) || '-' ||
       {' || '.join(f"chr(cast(({_LET} // {26 ** i}) % 26 + 65 as integer))" for i in range(5))} as customerID,
       {_choice_sql('gender', cust.GENDERS)} as gender,
       case when {_u_sql('senior')} * 100 < {cust.SENIOR_PERCENT} then 1 else 0 end as SeniorCitizen,
       {_choice_sql('partner', cust.YES_NO)} as Partner,
       {_choice_sql('dependents', cust.YES_NO)} as Dependents,
       cast(floor({_u_sql('tenure')} * {cust.TENURE_MAX + 1}) as integer) as tenure,
       ph as PhoneService,
       case when ph = 'No' then 'No phone service' else {_choice_sql('lines', cust.YES_NO)} end as MultipleLines,
       inet as InternetService,
       {', '.join(f"case when inet = 'No' then 'No internet service' else {_choice_sql(n, cust.YES_NO)} end as {n}"
                  for n in ('OnlineSecurity', 'OnlineBackup', 'DeviceProtection', 'TechSupport',
                            'StreamingTV', 'StreamingMovies'))},
       {_choice_sql('contract', cust.CONTRACTS)} as Contract,
       {_choice_sql('paperless', cust.YES_NO)} as PaperlessBilling,
       {_choice_sql('payment', cust.PAYMENT_METHODS)} as PaymentMethod,
       mc as MonthlyCharges,
       round(greatest(0.0, mc * cast(floor({_u_sql('tenure')} * {cust.TENURE_MAX + 1}) as integer) + nz), 2) as TotalCharges,
       case when {_u_sql('churn')} * 100 < {cust.CHURN_PERCENT} then 'Yes' else 'No' end as Churn
from (select customerID, {_choice_sql('phone', cust.YES_NO)} as ph, {_choice_sql('internet', cust.INTERNET_SERVICES)} as inet,
             round({cust.CHARGE_MIN} + {_u_sql('charge')} * {cust.CHARGE_MAX - cust.CHARGE_MIN}, 2) as mc,
             round({cust.NOISE_MIN} + {_u_sql('noise')} * {cust.NOISE_MAX - cust.NOISE_MIN}, 2) as nz
      from subs)"""
on_base("generated_customers", with_base(_GEN_SQL))(cust.generate_customers)


# --- IO4: parameterised query ----------------------------------------------------
PARAM_CONTRACT = "One year"


@register("param_query", with_base(f"""
select count(*) as n, count_if(Churn = 'Yes')::bigint as churned,
       round(count_if(Churn = 'Yes')::double / nullif(count(*), 0), 4) as churn_rate
from subs where Contract = '{PARAM_CONTRACT}'"""))
def _param_query(spark, sf_dir):
    """IO4: named-parameter SQL over the base (the value is bound, not spliced)."""
    return sinks.param_query(
        spark,
        "SELECT count(*) AS n, count_if(Churn = 'Yes')::bigint AS churned, "
        "round(try_divide(CAST(count_if(Churn = 'Yes')::bigint AS DOUBLE), count(*)), 4) AS churn_rate "
        "FROM {base} WHERE Contract = :contract",
        {"contract": PARAM_CONTRACT}, base=subscriptions(spark, sf_dir))


# --- ST1 / ST2: streaming --------------------------------------------------------
def _streamed(spark, sf_dir, build, post=None, snapshots=None):
    """ST1 over a growing source: half of the rows, then a restart from the checkpoint with the other half added."""
    src, ckpt, out = (running.scratch(spark, kind) for kind in ("stream-src", "stream-ckpt", "stream-out"))
    rows = subscriptions(spark, sf_dir)
    half = F.pmod(F.xxhash64("customerID"), F.lit(2))
    for part in (0, 1):
        running.stage_rows(rows.where(half == part), src)
        result = running.run_running(spark, src, build, out, snapshots, trigger_bytes=1 << 20, checkpoint=ckpt, post=post)
    return result


_KPI_SQL = with_base(f"""
select coalesce(sum({CHURN}), 0)::bigint as churned_users,
       coalesce(round(sum({CHURN})::double / nullif(count(*), 0), 4), 0.0) as churn_rate_overall,
       coalesce(round(avg(tenure), 1), 0.0) as avg_tenure,
       coalesce(round(avg(MonthlyCharges), 1), 0.0) as avg_monthly
from subs""")


@register("streaming_kpis", _KPI_SQL)
def _streaming_kpis(spark, sf_dir):
    """ST1: KPIs as a streaming aggregate; the final state equals the batch result."""
    return _streamed(spark, sf_dir, running.kpi_stream)


@register("streaming_churn_by_contract", with_base(_seg_sql(UNK_CONTRACT)))
def _streaming_contract(spark, sf_dir):
    """ST1: churn by contract as a streaming aggregate."""
    return _streamed(spark, sf_dir, running.segment_stream("Contract"))


@register("streaming_churn_by_payment", with_base(_seg_sql(UNK_PAYMENT)))
def _streaming_payment(spark, sf_dir):
    """ST1: churn by payment method as a streaming aggregate."""
    return _streamed(spark, sf_dir, running.segment_stream("PaymentMethod"))


@register("streaming_feature_churn", with_base("select * from fr", _FEAT_CTES))
def _streaming_features(spark, sf_dir):
    """ST1: feature churn (all allow-listed features) over a stream."""
    return _streamed(spark, sf_dir, running.feature_stream(ALLOWED_FEATURES), running.feature_post(ALLOWED_FEATURES))


@register("streaming_snapshots")
def _streaming_snapshots(spark, sf_dir):
    """ST2: one appended KPI snapshot per micro-batch (idempotent per batch id)."""
    snaps = running.scratch(spark, "stream-snapshots")
    _streamed(spark, sf_dir, running.kpi_stream, snapshots=snaps)
    return spark.read.parquet(snaps).select("batch_id", "payload")


@register("streaming_last_snapshot", _KPI_SQL)
def _streaming_last_snapshot(spark, sf_dir):
    """ST2: what the last snapshot of the growing stream says."""
    snaps = running.scratch(spark, "stream-snapshots")
    _streamed(spark, sf_dir, running.kpi_stream, snapshots=snaps)
    return running.last_snapshot(
        spark, snaps, "churned_users long, churn_rate_overall double, avg_tenure double, avg_monthly double")


@register("bulk_append", with_base(_GEN_SQL))
def _bulk_append(spark, sf_dir):
    """IO7: append a generated batch to a (fresh) customer table; read it back."""
    path = running.scratch(spark, "customers")
    cust.append_customers(cust.generate_customers(subscriptions(spark, sf_dir)), path)
    return spark.read.parquet(path)


_RENEWED = "'renewed-' || customerID"
_OTHERS = ", ".join(c for c in SUBSCRIPTION_COLUMNS if c not in ("customerID", "tenure", "TotalCharges", "Churn"))


@register("base_append", with_base(f"""
select * from subs
union all by name
select {_RENEWED} as customerID, {_OTHERS}, 0 as tenure, ' ' as TotalCharges, 'No' as Churn from subs where Churn = 'Yes'"""))
def _base_append(spark, sf_dir):
    """IO7: churned customers come back as a batch appended to the written base; the batch is sent twice, and counts once."""
    path = running.scratch(spark, "base-table")
    base_table.append_batch(subscriptions(spark, sf_dir), path, "base")
    churned = churned_scan(base_table.read_base(spark, path))
    back = churned.withColumns({"customerID": F.expr(_RENEWED), "tenure": F.lit(0), "TotalCharges": F.lit(" "), "Churn": F.lit("No")})
    for _ in range(2):
        base_table.append_batch(back, path, "renewals")
    return base_table.read_base(spark, path)


# --- Materialised base: pushdown and partition pruning ---------------------------
def _materialized(spark, sf_dir):
    from churnscope.sources.subscriptions import materialize_subscriptions, read_subscriptions
    path = running.scratch(spark, "subscriptions")
    return read_subscriptions(spark, materialize_subscriptions(spark, sf_dir, path))


@register("materialized_churned_scan", with_base("select * from subs where Churn = 'Yes'"))
def _mat_churned(spark, sf_dir):
    """IO1/IO2 on the written base: the Churn filter prunes partitions."""
    return churned_scan(_materialized(spark, sf_dir))


@register("materialized_keyset_page", with_base(
    f"select {_LIST_COLS} from subs where customerID > '{AFTER}' order by customerID limit 20"))
def _mat_keyset(spark, sf_dir):
    """P4 on the written base: ``customerID > last`` is pushed to the scan."""
    return cust.keyset_page(_materialized(spark, sf_dir), AFTER)
