"""Registered queries: name -> (Spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame built from the
given parquet tables.  The oracle SQL is the same computation written for
DuckDB over the same tables (see ``churnscope.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnscope.plans.oracle import with_base
from churnscope.sources.subscriptions import subscriptions

Builder = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[DataFrame], DataFrame] | Builder):
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def on_base(name: str, sql: str | None = None):
    """Register ``fn(base_df) -> DataFrame`` as a query over the subscription base."""
    def deco(fn: Callable[[DataFrame], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(subscriptions(spark, sf_dir))
        build.__name__ = f"q_{name}"
        build.__doc__ = fn.__doc__
        _REGISTRY[name] = (build, sql)
        return fn
    return deco


def queries() -> dict[str, Builder]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}


def _load():
    # Importing the query modules fills the registry.
    from churnscope.plans import (  # noqa: F401
        queries_core, queries_dist, queries_model, queries_reports)


__all__ = ["register", "on_base", "queries", "oracle_sql", "with_base"]
