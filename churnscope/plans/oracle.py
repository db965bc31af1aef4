"""DuckDB-runnable SQL used as the correctness oracle.

``with_base(select_sql)`` prefixes a query with the subscription-base
definition as CTEs; the query then reads the view name ``subs``.
"""

from __future__ import annotations

BASE_CTES = """
li as (
  select l_orderkey, count(*) n_lines, max(l_discount) max_disc, max(l_tax) max_tax, max(l_quantity) max_qty,
         sum(case when l_linestatus='O' then 1 else 0 end) n_open,
         sum(case when l_returnflag='R' then l_quantity else 0 end)/sum(l_quantity) ret
  from lineitem group by l_orderkey),
o as (
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
    coalesce(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey),
             (select max(o_orderdate) from orders)) end_dt
  from orders),
b as (
  select o.*, li.*, c_mktsegment, c_acctbal, c_nationkey,
    case when o_orderkey % 103 = 0 then null else (year(end_dt)-year(o_orderdate))*12 + month(end_dt)-month(o_orderdate) end tenure,
    case when o_orderkey % 101 = 0 then null else round(o_totalprice/4000, 2) end mc,
    case when n_lines is null then null when n_lines >= 2 then 'Yes' else 'No' end phone,
    case when o_custkey % 5 = 0 then 'No' when o_custkey % 5 in (1,2) then 'DSL' else 'Fiber optic' end isvc
  from o left join li on l_orderkey = o_orderkey join customer on c_custkey = o_custkey),
subs as (
select lpad(cast(o_orderkey as string), 20, '0') || '-' || substr(c_mktsegment, 1, 5) as customerID,
  case when o_custkey % 2 = 0 then 'Male' else 'Female' end as gender,
  case when o_orderkey % 107 = 0 then null when o_custkey % 10 < 3 then 1 else 0 end as SeniorCitizen,
  case when c_acctbal >= 4500 then 'Yes' else 'No' end as Partner,
  case when c_nationkey % 3 = 0 then 'Yes' else 'No' end as Dependents,
  cast(tenure as int) as tenure,
  phone as PhoneService,
  case when phone = 'No' then 'No phone service' when n_lines >= 4 then 'Yes' when n_lines is null then null else 'No' end as MultipleLines,
  isvc as InternetService,
  case when isvc='No' then 'No internet service' when n_lines is null then null when max_disc >= 0.08 then 'Yes' else 'No' end as OnlineSecurity,
  case when isvc='No' then 'No internet service' when n_lines is null then null when n_open >= 2 then 'Yes' else 'No' end as OnlineBackup,
  case when isvc='No' then 'No internet service' when n_lines is null then null when max_qty >= 45 then 'Yes' else 'No' end as DeviceProtection,
  case when isvc='No' then 'No internet service' when n_lines is null then null when max_tax >= 0.06 then 'Yes' else 'No' end as TechSupport,
  case when isvc='No' then 'No internet service' when o_orderkey % 3 = 0 then 'Yes' else 'No' end as StreamingTV,
  case when isvc='No' then 'No internet service' when o_orderkey % 4 < 2 then 'Yes' else 'No' end as StreamingMovies,
  case when o_orderkey % 97 = 0 then null when o_orderkey % 89 = 0 then '  ' when o_orderstatus='O' then 'Month-to-month' when o_orderstatus='F' then 'One year' else 'Two year' end as Contract,
  case when o_custkey % 4 = 0 then 'No' else 'Yes' end as PaperlessBilling,
  case o_orderpriority when '1-URGENT' then 'Electronic check' when '2-HIGH' then 'Mailed check' when '3-MEDIUM' then 'Bank transfer (automatic)' when '5-LOW' then 'Credit card (automatic)' else null end as PaymentMethod,
  mc as MonthlyCharges,
  case when tenure = 0 then ' ' else cast(cast(cast(mc as decimal(10,2)) * tenure as decimal(18,2)) as string) end as TotalCharges,
  case when ret is null then null when ret >= (case o_orderstatus when 'O' then 0.35 when 'F' then 0.55 else 0.8 end) then 'Yes' else 'No' end as Churn
from b)"""


def with_base(sql: str, extra_ctes: str = "") -> str:
    """``WITH <base>[, extra] <sql>`` — ``sql`` reads ``subs``."""
    ctes = BASE_CTES + ("," + extra_ctes if extra_ctes else "")
    return "with " + ctes + "\n" + sql
