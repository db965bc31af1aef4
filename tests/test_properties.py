"""Property tests: Spark expressions against plain-Python statements of the
same rules, on generated inputs (few examples each: every one runs a job)."""

import math
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.functions import scalar as sc
from churnscope.operators.model import rank_auc


def round_half_up(x: float, d: int) -> float:
    """The library's documented rounding: half-up on the shortest decimal form
    (as Spark and DuckDB round), not Python's round-half-even on binary."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP))


SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def py_bin(x, edges, labels, open_ends):
    if x is None:
        return None
    if open_ends:
        for e, lab in zip(edges[1:-1], labels[:-1]):
            if x <= e:
                return lab
        return labels[-1]
    if x < edges[0] or x > edges[-1]:
        return None
    for e, lab in zip(edges[1:], labels):
        if x <= e:
            return lab


@SETTINGS
@given(st.lists(st.sampled_from([-5.0, 0.0, 0.5, 3.0, 3.5, 12.0, 24.0, 48.0, 120.0, 121.0, None]),
                min_size=1, max_size=30),
       st.lists(st.integers(1, 30), min_size=1, max_size=4, unique=True),
       st.booleans())
def test_bins_match_python(spark, xs, steps, open_ends):
    edges = [0.0]
    for s in sorted(steps):
        edges.append(edges[-1] + s)
    labels = [f"b{i}" for i in range(len(edges) - 1)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.r for r in df.select(sc.right_closed_bins(F.col("x"), edges, labels,
                                                       open_ends=open_ends).alias("r")).collect()]
    assert got == [py_bin(x, edges, labels, open_ends) for x in xs]


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-1e6, 1e6)),
                          st.one_of(st.none(), st.floats(-1e3, 1e3))), min_size=1, max_size=20))
def test_safe_div_matches_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r.r for r in df.select(sc.safe_div("a", "b").alias("r")).collect()]
    for (a, b), g in zip(pairs, got):
        if a is None or b is None or abs(b) < 1e-10 or not math.isfinite(a / b):
            assert g == 0.0
        else:
            assert g == a / b


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.25, 0.5, 0.7, 0.9])),
                min_size=2, max_size=40))
def test_rank_auc_matches_bruteforce(spark, rows):
    df = spark.createDataFrame(rows, "churn int, score double")
    got = rank_auc(df).first().auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        assert got is None
    else:
        u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got == round_half_up(u / (len(pos) * len(neg)), 4)
