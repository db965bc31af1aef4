"""M3 and M7: sparse one-hot rows of many categories, and the objective's gradient and optimum."""

import numpy as np
from conftest import SF_SMALL
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnscope.operators import model as M
from churnscope.plans.registry import queries
from churnscope.sources.subscriptions import subscriptions


def rows(spark, n=400):
    return spark.range(n).selectExpr(
        "lpad(id, 6, '0') as customerID", "if(id * 7 % 11 < 3 + id % 3, 'Yes', 'No') as Churn", "cast(id % 50 as int) as tenure",
        "20.0D + id % 83 as MonthlyCharges", "element_at(array('M', 'One', null, ' '), cast(id % 4 + 1 as int)) as Contract",
        "element_at(array('card', 'check'), cast(id * id % 2 + 1 as int)) as PaymentMethod",
        "if(id % 3 = 0, 'Yes', null) as OnlineSecurity", "if(id % 5 < 2, 'Yes', 'No') as TechSupport")


def test_gradient_matches_plain_numpy(spark):
    rng = np.random.default_rng(0)
    x, y, weight = rng.normal(size=(300, 5)), rng.integers(0, 2, 300), rng.uniform(0.1, 3, 300)
    x[rng.random(x.shape) < 0.4] = 0
    vector = lambda i, a: Vectors.dense(a) if i % 2 else Vectors.sparse(5, [(j, v) for j, v in enumerate(a) if v])
    df = spark.createDataFrame([(vector(i, a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, weight, strict=True))],
                               ["features", "churn", "weight"])
    w = rng.normal(size=5)
    want = w + x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y))
    assert np.allclose(M.gradient(df, w.tolist()), want, atol=1e-9)
    assert np.allclose(M.gradient(df.limit(0), w.tolist()), w)


def test_fit_is_the_optimum_of_the_penalised_objective(spark):
    df = rows(spark)
    model, metrics = M.train(df)
    assert metrics["converged"] and metrics["gradient"] <= M.GRADIENT_TOLERANCE
    # the same objective by Newton's method on the pipeline's own inputs, intercept penalised as a coefficient
    split, counts, cats, weights = M.fitted_inputs(df)
    train = split.where(~F.col("is_test"))
    ready = M.Pipeline(stages=M.preprocessing(cats, weights, counts["n_train"])).fit(train).transform(train).select("features", "churn", "weight").collect()
    x, y, c = np.array([r[0].toArray() for r in ready]), np.array([r[1] for r in ready]), np.array([r[2] for r in ready])
    assert np.allclose(x[:, -1], 1) and np.allclose(x[:, :-1].mean(axis=0), 0, atol=1e-9)
    stds = x[:, :-1].std(axis=0)
    assert np.allclose(stds[stds > 0], 1, atol=1e-9)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(np.eye(len(w)) + (x * (c * p * (1 - p))[:, None]).T @ x, w + x.T @ (c * (p - y)))
    assert np.allclose(w, [*metrics["coefficients"], metrics["intercept"]], atol=1e-4)


def test_unseen_categories_score_as_the_dropped_one(spark):
    df = rows(spark)
    model, _ = M.train(df)
    split = M.with_split(M.training_set(df))
    first, unseen = (split.withColumn("PaymentMethod", F.lit(v)) for v in ("card", "never seen"))
    a, b = (sorted((r.customerID, r.score) for r in M.score(model, x).collect()) for x in (first, unseen))
    assert a == b


def test_one_hot_of_fifty_thousand_categories(spark):
    df = spark.range(120_000).selectExpr(
        "lpad(id, 6, '0') as customerID", "'No' as Churn", "1 as tenure", "cast(id % 2 as double) as MonthlyCharges",
        "concat('plan ', lpad(id % 50000, 5, '0')) as Contract", "if(id % 3 = 0, null, 'card') as PaymentMethod",
        "'Yes' as OnlineSecurity", "cast(null as string) as TechSupport")
    base = M.training_set(df)
    found = M.sparse_features(base)
    got = {r.customerID: (r.places, r["values"]) for r in found.where("cast(customerID as int) % 9973 = 0").collect()}
    before = len(M.NUMERIC_FEATURES) + len(M.BOOLEAN_FEATURES)
    for id_, (places, values) in got.items():
        k = int(id_)
        want = [(0, 1.0)] + ([(1, 1.0)] if k % 2 else []) + [(2, 1.0)]
        want += [(before + k % 50000 - 1, 1.0)] if k % 50000 else []
        want += [(before + 49_999, 1.0)] if k % 3 else []  # 'Unknown' sorts first and is dropped; 'card' follows
        assert list(zip(places, values, strict=True)) == want
    assert found.count() == 120_000
    sizes = found.agg(F.max(F.array_max("places")).alias("top"), F.max(F.size("places")).alias("most")).first()
    assert sizes.top == before + 49_999 and sizes.most <= 6


def test_statistics_give_the_plain_moments(spark):
    base = M.with_split(M.materialised(M.training_set(rows(spark))))
    got = {r.feature: (r["mean"], r["std"]) for r in M.scaling(M.statistics(base)).collect()}
    wide = M.impute_encode(base.where(~F.col("is_test")), {}).collect()
    for c in M.NUMERIC_FEATURES + M.BOOLEAN_FEATURES:
        v = np.array([float(r[c]) for r in wide])
        assert np.allclose(got[c], (v.mean(), v.std()))
    for c in M.CATEGORICAL_FEATURES:
        for value in sorted({r[c] for r in M.impute_encode(base, {}).collect()})[1:]:
            v = np.array([r[c] == value for r in wide], dtype=float)
            assert np.allclose(got[f"{c}_{value}"], (v.mean(), v.std()))
    plan = M.scaling(M.statistics(base))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "FileScan" not in plan


def test_saved_scores_derive_the_rows_once(spark, monkeypatch):
    derived, plain = [], M.training_set
    monkeypatch.setattr(M, "training_set", lambda df: derived.append(1) or plain(df))
    got = queries()["model_saved_scores"](spark, SF_SMALL).first()
    held_out = M.with_split(plain(subscriptions(spark, SF_SMALL))).where("is_test").count()
    assert got.rows == got.equal_scores == held_out > 0 and len(derived) == 1
