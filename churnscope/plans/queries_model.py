"""Registered model queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from churnscope.functions.dims import literal_frame
from churnscope.operators import model as M
from churnscope.plans.oracle import with_base
from churnscope.plans.registry import on_base, register
from churnscope.session import checkpoint_dir
from churnscope.sources.subscriptions import subscriptions

# Model rows, the DuckDB way (M1 + M4 cut of each class in md5 order).
_M_CTES = """
m0 as (select customerID, case when Churn = 'Yes' then 1 else 0 end as churn, tenure, MonthlyCharges,
              Contract, PaymentMethod, OnlineSecurity, TechSupport
       from subs where tenure is not null and MonthlyCharges is not null),
m as (select customerID, churn,
             coalesce(cast(tenure as double), (select median(tenure) from m0)) as tenure,
             coalesce(MonthlyCharges, (select median(MonthlyCharges) from m0)) as MonthlyCharges,
             coalesce(Contract, 'Unknown') as Contract, coalesce(PaymentMethod, 'Unknown') as PaymentMethod,
             case when OnlineSecurity = 'Yes' then 1 else 0 end as OnlineSecurity,
             case when TechSupport = 'Yes' then 1 else 0 end as TechSupport,
             row_number() over (partition by churn order by md5(customerID))
               <= round(0.2 * count(*) over (partition by churn)) as is_test
       from m0),
cats as (select 'Contract' as col, Contract as v from m group by 2
         union all select 'PaymentMethod', PaymentMethod from m group by 2),
onehot as (select c.col, c.v from cats c
           where c.v > (select min(v) from cats c2 where c2.col = c.col)),
fl as (select customerID, is_test, 'tenure' as feature, tenure as value from m
       union all select customerID, is_test, 'MonthlyCharges', MonthlyCharges from m
       union all select customerID, is_test, 'OnlineSecurity', OnlineSecurity::double from m
       union all select customerID, is_test, 'TechSupport', TechSupport::double from m
       union all select m.customerID, m.is_test, o.col || '_' || o.v,
                        case when (o.col = 'Contract' and m.Contract = o.v)
                               or (o.col = 'PaymentMethod' and m.PaymentMethod = o.v) then 1.0 else 0.0 end
                 from m cross join onehot o)"""

on_base("model_imputed", with_base("""
select customerID, churn, tenure, MonthlyCharges, Contract, PaymentMethod, OnlineSecurity, TechSupport from m""",
    _M_CTES))(lambda df: M.impute_encode(M.training_set(df), {}).select(
        "customerID", "churn", "tenure", "MonthlyCharges", "Contract", "PaymentMethod",
        "OnlineSecurity", "TechSupport"))

on_base("model_features", with_base("select customerID, feature, value from fl", _M_CTES))(M.features_long)

on_base("model_split", with_base("select customerID, churn, is_test from m", _M_CTES))(
    lambda df: M.with_split(M.materialised(M.training_set(df).select("customerID", "churn"))).select("customerID", "churn", "is_test"))

on_base("model_scaling", with_base("""
select feature, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std
from fl where not is_test group by feature""", _M_CTES))(
    lambda df: M.scaling_frame(df).select("feature", F.round("mean", 6).alias("mean"),
                                          F.round("std", 6).alias("std")))

on_base("class_weights", with_base("""
select churn, count(*) as n_class, sum(count(*)) over () / (2 * count(*)) as weight
from m where not is_test group by churn""", _M_CTES))(M.class_weights)

on_base("model_training_info", with_base("""
select count(*) as total_samples,
       (4 + count(distinct Contract) - 1 + count(distinct PaymentMethod) - 1)::bigint as total_features,
       count_if(not is_test)::bigint as train_samples, count_if(is_test)::bigint as test_samples,
       round(avg(churn), 4) as positive_rate
from m""", _M_CTES))(M.training_info)

# M9 on a fixed score: charge per month of tenure (higher -> likelier churn).
on_base("auc_fixed_score", with_base("""
select round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 4) as auc,
       sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg
from (select score, pos, neg,
             coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as neg_below
      from (select MonthlyCharges / (tenure + 1) as score, sum(churn) as pos, count(*) - sum(churn) as neg
            from m group by 1))""", _M_CTES))(
    lambda df: M.rank_auc(M.training_set(df).select(
        "churn", (F.col("MonthlyCharges") / (F.col("tenure") + 1)).alias("score")), "churn", "score"))


# Positions of the one-hot vector, z-scored training rows and the objective's gradient at fixed coefficients.
_G_CTES = _M_CTES + """,
pos as (select feature, row_number() over (order by k, feature) - 1 as position
        from (select * from (values ('tenure', 0), ('MonthlyCharges', 1), ('OnlineSecurity', 2), ('TechSupport', 3)) t(feature, k)
              union all select col || '_' || v, case col when 'Contract' then 4 else 5 end from onehot)),
sc as (select feature, avg(value) as mean, stddev_pop(value) as std from fl where not is_test group by feature),
wt as (select churn, sum(count(*)) over () / (2 * count(*)) as weight from m where not is_test group by churn),
z as (select fl.customerID, position, fl.feature,
             (value - mean) / case when std > 0 then std else 1 end as x,
             (position + 1) * 0.05 * case when position % 2 = 0 then -1 else 1 end as w
      from fl join sc using (feature) join pos using (feature) where not is_test
      union all
      select customerID, (select count(*) from pos), '(intercept)', 1.0, 0.25 from m where not is_test),
r as (select m.customerID, weight * (1 / (1 + exp(-margin)) - churn) as r
      from m join (select customerID, sum(x * w) as margin from z group by 1) s on s.customerID = m.customerID
        join wt using (churn))"""


def _fixed(n: int) -> list[float]:
    """Coefficients at which the gradient is compared: 0.05, 0.1, ... of alternating sign, and 0.25 for the constant."""
    return [(i + 1) * 0.05 * (-1 if i % 2 == 0 else 1) for i in range(n)] + [0.25]


@register("model_gradient", with_base("""
select feature, round(sum(x * r) + max(w), 4) as gradient
from z join r on r.customerID = z.customerID group by feature""", _G_CTES))
def _gradient(spark, sf_dir):
    """M7: the objective's gradient at fixed coefficients, through the pipeline's own preprocessing."""
    rows, counts, cats, weights = M.fitted_inputs(subscriptions(spark, sf_dir))
    train = rows.where(~F.col("is_test"))
    ready = M.Pipeline(stages=M.preprocessing(cats, weights, counts["n_train"])).fit(train).transform(train)
    names = M.feature_names(cats)
    found = M.gradient(ready, _fixed(len(names)))
    return literal_frame(spark, [(n, round(float(g), 4)) for n, g in zip([*names, "(intercept)"], found)],
                         [("feature", "string"), ("gradient", "double")])


@register("model_converged", with_base("""
select true as converged, (select count(*) from pos)::bigint as features,
       (select count(*) from m where not is_test)::bigint as train_samples""", _G_CTES))
def _converged(spark, sf_dir):
    """M7: the fit's certificate, that the gradient at the fitted coefficients is zero to within the tolerance."""
    _, metrics = _trained(spark, sf_dir)
    return literal_frame(spark, [(metrics["converged"], metrics["total_features"], metrics["train_samples"])],
                         [("converged", "boolean"), ("features", "bigint"), ("train_samples", "bigint")])


on_base("model_sparse_features", with_base("""
select customerID, position::integer as position, value from fl join pos using (feature) where value <> 0""", _G_CTES))(
    lambda df: M.sparse_features(M.materialised(M.training_set(df))).select(
        "customerID", F.explode(F.arrays_zip("places", "values")).alias("e")).select(
        "customerID", F.col("e.places").alias("position"), F.col("e.values").alias("value")))


@register("model_saved_scores", with_base("""
select count(*) as rows, count(*) as equal_scores, (4 + (select count(*) from onehot))::bigint as features from m where is_test""", _M_CTES))
def _saved_scores(spark, sf_dir):
    """Train, save, load and score again; the loaded model must give every held-out row the score of the trained one."""
    inputs = M.fitted_inputs(subscriptions(spark, sf_dir))
    path = os.path.join(checkpoint_dir(spark), "models", uuid.uuid4().hex)
    model, metrics, scored = M.fit_inputs(*inputs)
    M.save(model, metrics, path)
    loaded, known = M.load(spark, path)
    # the rows that were split for the fit: the base is derived and cut once
    again = M.score(loaded, inputs[0].where("is_test")).withColumnRenamed("score", "again")
    pairs = scored.join(again, "customerID")
    return pairs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") == F.col("again")).alias("equal_scores")).withColumn(
        "features", F.lit(known["total_features"]).cast("long"))


# --- Trained-model outputs: rows-only checks (solver output) -----------------
def _trained(spark, sf_dir):
    return M.train(subscriptions(spark, sf_dir))


@register("model_coefficients")
def _coefs(spark, sf_dir):
    """M7: fitted weight per feature plus the intercept."""
    _, metrics = _trained(spark, sf_dir)
    c = M.coefficients_frame(spark, metrics).drop("position")
    return c.unionByName(spark.createDataFrame([("(intercept)", metrics["intercept"])],
                                               "feature string, weight double"))


@register("model_scores")
def _scores(spark, sf_dir):
    """M8: P(churn) on the held-out rows."""
    return M.train_with_scores(subscriptions(spark, sf_dir))[2]


@register("model_auc")
def _auc(spark, sf_dir):
    """M9 on the trained model's held-out scores."""
    _, m = _trained(spark, sf_dir)
    return literal_frame(spark, [(m["auc"], m["auc_positive"], m["auc_negative"])],
                         [("auc", "double"), ("n_pos", "bigint"), ("n_neg", "bigint")])


@register("model_top_features")
def _top(spark, sf_dir):
    """Top 10 features by |weight|."""
    _, metrics = _trained(spark, sf_dir)
    return M.top_features(M.coefficients_frame(spark, metrics))


@register("model_directions")
def _dirs(spark, sf_dir):
    """Direction of effect for the top 5 features."""
    _, metrics = _trained(spark, sf_dir)
    return M.directions(M.coefficients_frame(spark, metrics))


@register("model_info")
def _info(spark, sf_dir):
    """M12 + M13: load-or-train into the checkpoint folder, then report."""
    path = os.path.join(checkpoint_dir(spark), "models", "baseline")
    M.load_or_train(subscriptions(spark, sf_dir), path, retrain=True)
    return M.model_info(spark, path)
