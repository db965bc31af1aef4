"""IO7: batches committed to a written base."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from churnscope.sources import base_table as B
from churnscope.sources.subscriptions import SUBSCRIPTION_COLUMNS, SUBSCRIPTION_SCHEMA, churned_scan, subscriptions
from conftest import SF_SMALL


def rows_of(df):
    return sorted(map(tuple, df.select(*SUBSCRIPTION_COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def base(spark):
    return subscriptions(spark, SF_SMALL).limit(300).checkpoint()


def test_append_returns_old_and_new_rows(spark, base, tmp_path):
    path = str(tmp_path / "t")
    assert rows_of(B.read_base(spark, path)) == []
    new = base.limit(50).withColumn("customerID", F.concat(F.lit("new-"), F.col("customerID")))
    assert B.append_batch(base, path, "first") == 300
    assert B.append_batch(new, path, "second") == new.count()
    assert rows_of(B.read_base(spark, path)) == rows_of(base.union(new))
    assert {r.batch_id: r.n_rows for r in B.batches(spark, path).collect()} == {"first": 300, "second": 50}


def test_replay_adds_nothing_and_a_corrected_batch_replaces_itself(spark, base, tmp_path):
    path = str(tmp_path / "t")
    B.append_batch(base, path, "a")
    for _ in range(2):
        B.append_batch(base.where("Churn = 'Yes'"), path, "b")
    both = base.union(base.where("Churn = 'Yes'"))
    assert rows_of(B.read_base(spark, path)) == rows_of(both)
    # fewer Churn values and fewer rows than before: nothing of the old attempt stays
    less = base.where("Churn = 'No'").limit(3).checkpoint()
    B.append_batch(less, path, "b")
    assert rows_of(B.read_base(spark, path)) == rows_of(base.union(less))
    B.append_batch(base.limit(0), path, "a")
    assert rows_of(B.read_base(spark, path)) == rows_of(less)


def test_a_job_that_dies_before_its_commit_leaves_no_rows(spark, base, tmp_path):
    path = str(tmp_path / "t")
    B.stage_batch(base, path)
    assert rows_of(B.read_base(spark, path)) == []
    B.append_batch(base.limit(10), path, "a")
    attempt, n = B.stage_batch(base, path)
    before = rows_of(B.read_base(spark, path))
    assert len(before) == 10
    B.commit_batch(spark, path, "b", attempt, n)
    assert len(rows_of(B.read_base(spark, path))) == 310


def test_wrong_schema_is_refused_before_anything_is_written(spark, base, tmp_path):
    path = str(tmp_path / "t")
    for bad in (base.withColumn("tenure", F.col("tenure").cast("long")), base.drop("Churn"), base.withColumn("extra", F.lit(1)),
                base.select("*", "tenure")):
        with pytest.raises(ValueError):
            B.append_batch(bad, path, "a")
    with pytest.raises(ValueError):
        B.append_batch(base, path, "")
    assert not (tmp_path / "t").exists()
    with pytest.raises((PySparkException, Py4JJavaError)):
        B.append_batch(base.withColumn("Churn", F.lit(" ")), path, "a")
    assert rows_of(B.read_base(spark, path)) == []
    # another column order is no other schema
    assert B.append_batch(base.select(*reversed(SUBSCRIPTION_COLUMNS)), path, "a") == 300
    assert rows_of(B.read_base(spark, path)) == rows_of(base)


def test_nulls_repeated_rows_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], SUBSCRIPTION_SCHEMA)
    assert B.append_batch(empty, path, "none") == 0
    assert rows_of(B.read_base(spark, path)) == []
    odd = spark.createDataFrame([(None,) * 21, (None,) * 21, ("x", *(None,) * 19, "Yes"), ("x", *(None,) * 19, "1")], SUBSCRIPTION_SCHEMA)
    B.append_batch(odd, path, "odd")
    assert rows_of(B.read_base(spark, path)) == rows_of(odd)


def test_scans_of_the_table_prune(spark, base, tmp_path):
    path = str(tmp_path / "t")
    B.append_batch(base, path, "a")
    B.append_batch(base, path, "b")
    plan = churned_scan(B.read_base(spark, path)).select("customerID").where("customerID > '5'")._jdf.queryExecution().executedPlan().toString()
    assert "(Churn" in plan.split("PartitionFilters")[1][:200]
    assert "GreaterThan(customerID,5)" in plan
    assert "dynamicpruning" in plan
