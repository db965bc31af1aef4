"""Empty input, all-NULL columns, single-class labels, materialised base."""

import re
from pyspark.sql import functions as F

from churnscope.operators import features as feat
from churnscope.operators import histograms as hist
from churnscope.operators import kpis
from churnscope.operators import model as M
from churnscope.operators import reports as rep
from churnscope.operators import segments as seg
from churnscope.sources import subscriptions as S
from conftest import SF_SMALL


def _base(spark):
    return S.subscriptions(spark, SF_SMALL)


def test_empty_input_everywhere(spark):
    empty = _base(spark).where(F.lit(False))
    assert kpis.compute_kpis(empty).first().churn_rate_overall == 0.0
    assert seg.churn_by_contract(empty).count() == 0
    bins = hist.tenure_bins(empty).collect()
    assert len(bins) == 5 and all(r["count"] == 0 and r.pct == 0.0 for r in bins)
    fc = feat.feature_churn(empty).collect()
    assert len(fc) == 4 and all(r.n == 0 and r.churn_rate == 0.0 for r in fc)
    assert feat.feature_impact(empty).count() == 0
    long = rep.batch_summary(empty)
    assert long.where("section = 'tenure_ranges'").count() == 4
    assert rep.insight_payload_long(empty).where("section = 'tenure_distribution'").count() == 5
    assert rep.report_lines(rep.insight_payload_long(empty)).count() > 0


def test_all_null_columns(spark):
    b = _base(spark).withColumn("tenure", F.lit(None).cast("int")) \
                    .withColumn("Contract", F.lit(None).cast("string"))
    r = kpis.compute_kpis(b).first()
    assert r.avg_tenure == 0.0
    rows = seg.churn_by_contract(b).collect()
    assert [x.key for x in rows] == ["Unknown"]
    assert all(x["count"] == 0 for x in hist.tenure_bins(b).collect())
    assert hist.tenure_insights(b).count() == 0


def test_single_class_label(spark):
    b = _base(spark).withColumn("Churn", F.lit("No"))
    model, metrics = M.train(b)
    assert metrics["auc"] is None            # no positives: AUC undefined, not an error
    assert metrics["positive_rate"] == 0.0


def test_materialized_base_prunes_and_pushes(spark, tmp_path):
    path = S.materialize_subscriptions(spark, SF_SMALL, str(tmp_path / "subs"), files=4)
    m = S.read_subscriptions(spark, path)
    assert m.columns == S.SUBSCRIPTION_COLUMNS
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, _base(spark).collect()))
    plan = S.churned_scan(m)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*Churn[^]]*Yes", plan)
    ks = m.where(F.col("customerID") > "00000000000000000500")
    assert "GreaterThan(customerID" in ks._jdf.queryExecution().executedPlan().toString()


def test_require_rows(spark):
    import pytest
    base = _base(spark)
    assert S.require_rows(base) is base
    with pytest.raises(ValueError):
        S.require_rows(base.where(F.lit(False)))
