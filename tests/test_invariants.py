"""Cross-operator invariants on the derived base (SURVEY §5 (3))."""

from pyspark.sql import functions as F

from churnscope.operators import features as feat
from churnscope.operators import histograms as hist
from churnscope.operators import kpis
from churnscope.operators import reports as rep
from churnscope.operators import segments as seg
from churnscope.sources.subscriptions import subscriptions
from conftest import SF_SMALL


def test_invariants(spark):
    base = subscriptions(spark, SF_SMALL)
    total = base.count()
    withv = kpis.churned_with_value(base).first()
    # Σ bin counts = churned rows with a value (H1/H2 vs H14).
    tb = hist.tenure_bins(base).collect()
    mb = hist.monthly_bins(base).collect()
    assert sum(r["count"] for r in tb) == withv.churned_with_tenure
    assert sum(r["count"] for r in mb) == withv.churned_with_charges
    # Every pct / rate is a fraction.
    assert all(0.0 <= r.pct <= 1.0 for r in tb + mb)
    # Σ segment n = all rows, for both segmentations.
    for c in ("Contract", "PaymentMethod"):
        rows = seg.churn_by(base, c).collect()
        assert sum(r.n for r in rows) == total
        assert all(0.0 <= r.churn_rate <= 1.0 for r in rows)
    # Per feature, Yes + No + dropped values = all rows.
    fc = feat.feature_churn(base, ["OnlineSecurity"]).collect()
    other = base.where(~F.coalesce("OnlineSecurity", F.lit("No")).isin("Yes", "No")).count()
    assert sum(r.n for r in fc) + other == total
    # Batch percents over all churned add up to 100 per section.
    long = rep.batch_summary(base).collect()
    for sec in ("by_contract", "by_payment"):
        assert abs(sum(r.pct for r in long if r.section == sec) - 100.0) < 1e-9
    # KPI churned users = readiness churned rows.
    assert kpis.compute_kpis(base).first().churned_users == kpis.readiness(base).first().churned_rows
