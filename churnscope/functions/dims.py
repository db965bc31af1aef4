"""Small literal dimension frames.

``spark.createDataFrame(list)`` becomes an RDD scan whose size Catalyst does
not know, so joins against it plan as shuffled sort-merge joins.  A SQL
``VALUES`` list is a local relation with an exact size: it is planned as a
``LocalTableScan`` and broadcast without a job of its own.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(v, t: str) -> str:
    if v is None:
        return f"CAST(NULL AS {t})"
    if t == "string":
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if t == "boolean":
        return "TRUE" if v else "FALSE"
    return f"CAST({v!r} AS {t})"


def literal_frame(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[tuple[str, str]]
                  ) -> DataFrame:
    """A local relation with the given rows; ``columns`` = [(name, sql type)]."""
    names = ", ".join(f"`{n}`" for n, _ in columns)
    if not rows:
        cols = ", ".join(f"CAST(NULL AS {t}) AS `{n}`" for n, t in columns)
        return spark.sql(f"SELECT {cols} WHERE FALSE")
    vals = ", ".join("(" + ", ".join(_literal(v, t) for v, (_, t) in zip(r, columns)) + ")"
                     for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {vals} AS t({names})")
