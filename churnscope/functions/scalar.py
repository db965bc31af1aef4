"""Column expressions: safe arithmetic, cleaning rules, flags, formatting.

All of these are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPS = 1e-10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_double(v) -> Column:
    return F.lit(v).cast("double")


def is_finite(x) -> Column:
    """True for non-NULL, non-NaN, non-infinite doubles."""
    x = _c(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def safe_div(num, den, default: float | None = 0.0) -> Column:
    """num / den; NULL operand, |den| < 1e-10 or a non-finite result -> default."""
    num, den = _c(num).cast("double"), _c(den).cast("double")
    q = F.try_divide(num, den)
    bad = (num.isNull() | den.isNull() | (F.abs(den) < EPS) | ~is_finite(q))
    return F.when(bad, _lit_double(default)).otherwise(q)


def round_fp(x, digits: int = 4) -> Column:
    """round(x, d); NULL, NaN and +-Inf become NULL.  Ties round half-up."""
    x = _c(x).cast("double")
    return F.when(~is_finite(x), _lit_double(None)).otherwise(F.round(x, digits))


def safe_mean(x) -> Column:
    """Aggregate: mean of the finite values, NULL when there are none."""
    x = _c(x).cast("double")
    return F.avg(F.when(is_finite(x), x))


def safe_sum(x) -> Column:
    """Aggregate: sum of the finite values, 0.0 when there are none."""
    x = _c(x).cast("double")
    return F.coalesce(F.sum(F.when(is_finite(x), x)), F.lit(0.0))


def safe_count(cond: Column | None = None) -> Column:
    """Aggregate: row count (NULLs included) or count of rows meeting ``cond``."""
    if cond is None:
        return F.count(F.lit(1))
    return F.count_if(F.coalesce(cond, F.lit(False)))


def array_safe_mean(arr) -> Column:
    """Per-row mean of the finite elements of an array column (NULL if none)."""
    fin = F.filter(_c(arr), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF))
    total = F.aggregate(fin, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(fin) > 0, total / F.size(fin))


_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def to_number(x, fill: float | None = None) -> Column:
    """Coerce a string/numeric column to double; bad values -> NULL or ``fill``."""
    s = F.trim(_c(x).cast("string"))
    # plain decimal numbers only: a cast also takes 'NaN', '12d' and '0x1p3'
    v = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    return v if fill is None else F.coalesce(v, F.lit(float(fill)))


def clean_numeric_column(df, column: str, fill_value: float | None = None):
    """SC6 on a frame: the column coerced to double (bad values -> NULL or
    ``fill_value``); a missing column gives an empty one-column frame."""
    if column not in df.columns:
        return df.select(F.lit(None).cast("double").alias(column)).where(F.lit(False))
    return df.select(to_number(column, fill_value).alias(column))


# JavaScript ``parseFloat``: optional leading blanks, sign, digits with an
# optional fraction, optional exponent; the longest such prefix is used.
_JS_NUMBER_PREFIX = r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)"


def parse_or_zero(x) -> Column:
    """Numeric prefix of a string as double (``'12abc'`` -> 12), else 0."""
    s = _c(x).cast("string")
    return F.coalesce(F.regexp_extract(s, _JS_NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


def unknown_if_blank(x) -> Column:
    """NULL or all-space value -> 'Unknown'; any other value kept untrimmed."""
    x = _c(x)
    return F.when(x.isNull() | (F.trim(x) == ""), F.lit("Unknown")).otherwise(x)


def unknown_if_null(x) -> Column:
    """NULL -> 'Unknown'; blanks stay their own value."""
    return F.coalesce(_c(x), F.lit("Unknown"))


def no_if_null(x) -> Column:
    """NULL feature value -> 'No'; blanks stay their own value."""
    return F.coalesce(_c(x), F.lit("No"))


def yes_flag(x) -> Column:
    """'Yes' -> 1, anything else (NULL included) -> 0."""
    return F.when(_c(x) == "Yes", F.lit(1)).otherwise(F.lit(0))


def churn_flag(col: str = "Churn") -> Column:
    return yes_flag(col)


def senior_filled(x="SeniorCitizen") -> Column:
    return F.coalesce(_c(x), F.lit(0)).cast("int")


def right_closed_bins(x, edges: Sequence[float], labels: Sequence[str],
                      include_lowest: bool = True, open_ends: bool = False) -> Column:
    """Label of the right-closed interval ``(e_i, e_{i+1}]`` holding ``x``.

    The first edge is inclusive when ``include_lowest``; values outside the
    edges give NULL, unless ``open_ends`` (the first bin also takes everything
    below, the last everything above).  Duplicate edges are dropped first.
    """
    x = _c(x)
    e = []
    for v in edges:
        if not e or v != e[-1]:
            e.append(v)
    if len(labels) != len(e) - 1:
        raise ValueError("need exactly one label per interval")
    # Branches are tested in order, so each one only needs its upper edge.
    if open_ends:
        expr = F.when(x.isNull(), F.lit(None).cast("string"))
    elif include_lowest:
        expr = F.when(x.isNull() | (x < F.lit(e[0])), F.lit(None).cast("string"))
    else:
        expr = F.when(x.isNull() | (x <= F.lit(e[0])), F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        if open_ends and i == len(labels) - 1:
            return expr.otherwise(F.lit(label))
        expr = expr.when(x <= F.lit(e[i + 1]), F.lit(label))
    return expr


def pct_text(x, digits: int = 2) -> Column:
    """Python ``format(x, '.2%')``: fraction -> '26.54%' (rounded half-up first)."""
    v = F.round(_c(x).cast("double") * 100, digits)
    return F.format_string(f"%.{digits}f%%", v)


def fixed_text(x, digits: int = 1) -> Column:
    """``format(x, '.1f')`` on a double (rounded half-up first)."""
    return F.format_string(f"%.{digits}f", F.round(_c(x).cast("double"), digits))


def thousands_text(x) -> Column:
    """``format(n, ',')`` for integers: 7043 -> '7,043'."""
    return F.format_number(_c(x).cast("long"), 0)
