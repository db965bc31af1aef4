import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from churnscope.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 8, app="churnscope-tests")
    # Tests only: use a scratch checkpoint folder when the session names none.
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="churnscope-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
    yield s


def counts_frame(spark, column, groups):
    """Rows for (value, total, churned) groups: ``churned`` of them 'Yes'."""
    parts = []
    for value, total, churned in groups:
        v = F.lit(value).cast("string")
        parts.append(spark.range(total).select(
            v.alias(column),
            F.when(F.col("id") < churned, "Yes").otherwise("No").alias("Churn")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
