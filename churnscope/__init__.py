"""churnscope: subscription-retention analytics as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (or builds one from
the session), so Catalyst sees the whole plan: filters reach the parquet
scan, aggregates run partial/final, and small fixed dimensions are
broadcast only where their size is bounded by construction.
"""

from churnscope.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
