"""Bin definitions and their dimension frames.

A bin definition is a handful of rows, so its dimension frame has a size
bound by construction and is safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.dims import literal_frame
from churnscope.functions.scalar import right_closed_bins


@dataclass(frozen=True)
class BinDef:
    name: str
    edges: Sequence[float]
    labels: Sequence[str]
    # open_ends: first bin takes everything below, last everything above
    # (the CASE WHEN form); otherwise values outside the edges are NULL.
    open_ends: bool = False

    def label(self, x) -> Column:
        return right_closed_bins(x, self.edges, self.labels, include_lowest=True,
                                 open_ends=self.open_ends)

    def order(self, label_col) -> Column:
        """0-based position of a label in the definition, NULL if unknown."""
        expr = None
        for i, lab in enumerate(self.labels):
            cond = F.col(label_col) == F.lit(lab) if isinstance(label_col, str) else label_col == F.lit(lab)
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        return expr

    def frame(self, spark: SparkSession, label_name: str = "range") -> DataFrame:
        rows = [(lab, i) for i, lab in enumerate(self.labels)]
        return literal_frame(spark, rows, [(label_name, "string"), ("bin_order", "int")])


# --- fixed values: bin edges and labels that must match the reference -------
# API tenure bins (labels use an EN DASH): <=3, <=6, <=12, <=24, above.
TENURE_API = BinDef("tenure", [0, 3, 6, 12, 24, 999],
                    ["0–3", "4–6", "7–12", "13–24", "25+"], open_ends=True)
# API monthly-charge bins: <=35, <=65, <=95, above.
MONTHLY_API = BinDef("monthly", [0, 35, 65, 95, 999],
                     ["0–35", "36–65", "66–95", "96+"], open_ends=True)
# Batch job bins (ASCII hyphen), right-closed, lowest edge included,
# values outside the edges get no bin.
TENURE_BATCH = BinDef("tenure_batch", [0, 12, 24, 48, 120],
                      ["0-12", "13-24", "25-48", "49+"])
MONTHLY_BATCH = BinDef("monthly_batch", [0, 35, 65, 95, 1e6],
                       ["0-35", "36-65", "66-95", "96+"])
# Dashboard-script bins: same labels as the batch job, no range check.
TENURE_JS = BinDef("tenure_js", [0, 12, 24, 48, 120],
                   ["0-12", "13-24", "25-48", "49+"], open_ends=True)
MONTHLY_JS = BinDef("monthly_js", [0, 35, 65, 95, 1e6],
                    ["0-35", "36-65", "66-95", "96+"], open_ends=True)
# ---------------------------------------------------------------------------

ALL_BINDEFS = [TENURE_API, MONTHLY_API, TENURE_BATCH, MONTHLY_BATCH, TENURE_JS, MONTHLY_JS]


def definitions_frame(spark: SparkSession) -> DataFrame:
    """All bin definitions as one long frame (name, bin_order, range, lower, upper)."""
    rows = []
    for d in ALL_BINDEFS:
        for i, lab in enumerate(d.labels):
            rows.append((d.name, i, lab, float(d.edges[i]), float(d.edges[i + 1])))
    return literal_frame(spark, rows, [("bin_set", "string"), ("bin_order", "int"),
                                       ("range", "string"), ("lower_edge", "double"),
                                       ("upper_edge", "double")])
