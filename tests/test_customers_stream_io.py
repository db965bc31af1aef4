from pyspark.sql import functions as F

from churnscope.operators import customers as cust
from churnscope.operators import kpis
from churnscope.operators import reports as rep
from churnscope.sources import sinks
from churnscope.sources.subscriptions import SUBSCRIPTION_COLUMNS, subscriptions
from churnscope.streaming import running
from conftest import SF_SMALL


def test_search_page_keyset(spark):
    base = subscriptions(spark, SF_SMALL)
    ids = sorted(r.customerID for r in base.select("customerID").collect())
    p2 = [r.customerID for r in cust.page(base, 2).collect()]
    assert p2 == ids[20:40]
    assert [r.customerID for r in cust.keyset_page(base, ids[19]).collect()] == p2
    assert cust.search(base, "   ").count() == len(ids)
    hits = [i for i in ids if "auto" in i.lower()]
    assert cust.search(base, " auto ").count() == len(hits)
    st = cust.page_stats(base, 2, "auto").first()
    assert st.total_count == len(hits) and st.total_pages == -(-len(hits) // 20)
    assert (st.start_index, st.end_index) == (21, min(40, len(hits)))


def test_keyset_pages_keep_repeated_ids(spark):
    cols = "customerID string, MonthlyCharges double, TotalCharges string, tenure int, SeniorCitizen int"
    rows = [(i, float(c), None, 1, 0) for i, c in [("A", 1), ("B", 1), ("B", 2), ("B", 2), ("B", 2), ("C", 1), ("C", 3)]]
    df = spark.createDataFrame(rows, cols)
    for size in (1, 2, 3):
        seen, cursor = [], None
        while (following := cust.next_cursor(df, cursor, size=size)) is not None:
            seen += [(r.customerID, r.MonthlyCharges) for r in cust.keyset_page(df, cursor, size=size).collect()]
            cursor = following
        assert sorted(seen) == sorted((r[0], r[1]) for r in rows)


def test_indexed_pages_equal_plain_pages(spark, tmp_path):
    cols = "customerID string, MonthlyCharges double, TotalCharges string, tenure int, SeniorCitizen int"
    rows = [(f"c{k % 37:03d}", float(k), None, 1, 0) for k in range(150)] + [(None, 1.0, "x", 2, 1), (None, 0.5, "x", 2, 1)]
    rows += [("hot", float(k % 3), "1", 1, 0) for k in range(60)]
    df = spark.createDataFrame(rows, cols).repartition(5)
    cust.build_page_index(df, str(tmp_path / "i"), rows_per_range=20)
    index = spark.read.parquet(str(tmp_path / "i"))
    assert index.count() > 5 and index.agg(F.sum("n")).first()[0] == len(rows)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for no in (1, 2, 5, 8, 11, 12, 40):
        got = [(r.customerID, r.MonthlyCharges) for r in cust.indexed_page(df, index, no).collect()]
        assert got == [(r[0], r[1]) for r in want[(no - 1) * 20:no * 20]]
        assert [(r.customerID, r.MonthlyCharges) for r in cust.page(df, no).collect()] == got
    assert cust.index_stats(index, 3).first() == cust.page_stats(df, 3).first()
    empty = df.limit(0)
    cust.build_page_index(empty, str(tmp_path / "e"))
    none = spark.read.parquet(str(tmp_path / "e"))
    assert cust.indexed_page(empty, none, 1).collect() == [] and cust.index_stats(none).first().total_count == 0


def test_the_page_index_takes_no_more_tasks_than_a_sort(spark, tmp_path):
    sc = spark.sparkContext
    sc.setJobGroup("page index", "")
    try:
        cust.build_page_index(spark.range(3_000).selectExpr("lpad(id, 6, '0') as customerID"), str(tmp_path / "i"), rows_per_range=10)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    index = spark.read.parquet(str(tmp_path / "i"))
    assert index.count() >= 300 and index.agg(F.max("n")).first()[0] <= 10
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("page index") for s in told.getJobInfo(j).stageIds]
    # the driver's sample for a range sort grows with its tasks, so these must not grow with the ranges
    assert max(s.numTasks for s in stages if s) <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)


def test_a_deep_page_reads_one_range(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(60_000).selectExpr("lpad(id, 8, '0') as customerID", "1.0D as MonthlyCharges", "'2' as TotalCharges", "1 as tenure",
                                   "0 as SeniorCitizen").repartitionByRange(12, "customerID").sortWithinPartitions("customerID").write.parquet(path)
    df = spark.read.parquet(path)
    cust.build_page_index(df, str(tmp_path / "i"), rows_per_range=5_000)
    page = cust.indexed_page(df, spark.read.parquet(str(tmp_path / "i")), 2_500)
    assert [r.customerID for r in page.collect()] == [f"{k:08d}" for k in range(49_980, 50_000)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(customerID," in plan and "LessThanOrEqual(customerID," in plan and "md5" not in plan


def test_generated_customers_rules(spark):
    g = cust.generate(spark, 20000)
    assert g.columns == SUBSCRIPTION_COLUMNS
    r = g.agg(F.avg(F.when(F.col("Churn") == "Yes", 1).otherwise(0)).alias("churn"),
              F.avg("SeniorCitizen").alias("senior"),
              F.min("tenure").alias("tmin"), F.max("tenure").alias("tmax"),
              F.min("MonthlyCharges").alias("cmin"), F.max("MonthlyCharges").alias("cmax"),
              F.min("TotalCharges").alias("tot_min")).first()
    assert abs(r.churn - 0.27) < 0.02 and abs(r.senior - 0.30) < 0.02
    assert (r.tmin, r.tmax) == (0, 72) and 18 <= r.cmin and r.cmax <= 120 and r.tot_min >= 0
    bad = g.where(((F.col("InternetService") == "No") & (F.col("TechSupport") != "No internet service"))
                  | ((F.col("PhoneService") == "No") & (F.col("MultipleLines") != "No phone service")))
    assert bad.count() == 0
    assert g.where(~F.col("customerID").rlike("^[1-9][0-9]{4}-[A-Z]{5}$")).count() == 0


def test_param_query_binds_values(spark):
    base = subscriptions(spark, SF_SMALL)
    out = sinks.param_query(spark, "SELECT count(*) AS n FROM {b} WHERE Contract = :c",
                            {"c": "One year'; DROP TABLE x; --"}, b=base)
    assert sinks.fetch_scalar(out) == 0


def test_snapshot_append_and_json(spark, tmp_path):
    base = subscriptions(spark, SF_SMALL)
    payload = rep.summary_payload(rep.batch_summary(base))
    path = str(tmp_path / "snaps")
    sinks.append_snapshot(payload, path)
    sinks.append_snapshot(payload, path)
    assert spark.read.parquet(path).count() == 2
    latest = sinks.latest_snapshot(spark, path).first()
    assert latest.payload.total_customers == base.count()
    js = sinks.to_json_lines(payload).first().json
    assert '"by_contract"' in js and '"generated_at"' in js


def test_streaming_kpis_equal_batch(spark, tmp_path):
    base = subscriptions(spark, SF_SMALL)
    src = running.stage_rows(base, str(tmp_path / "src"), files=3)
    snaps = str(tmp_path / "snaps")
    out = running.run_running(spark, src, running.kpi_stream, str(tmp_path / "out"),
                              snapshots=snaps, trigger_bytes=1, checkpoint=str(tmp_path / "ck"))
    assert out.collect() == kpis.compute_kpis(base).collect()
    assert spark.read.parquet(snaps).select("batch_id").distinct().count() >= 3


def test_a_restarted_stream_takes_only_what_was_added(spark, tmp_path):
    base = subscriptions(spark, SF_SMALL).checkpoint()
    first, more = base.where("customerID < '00000000000000000700'"), base.where("customerID >= '00000000000000000700'")
    paths = [str(tmp_path / x) for x in ("src", "out", "snaps", "ck")]
    src, out, snaps, ck = paths
    run = lambda: running.run_running(spark, src, running.kpi_stream, out, snaps, 1, ck).collect()
    running.stage_rows(first, src, files=2)
    assert run() == kpis.compute_kpis(first).collect()
    before = spark.read.parquet(snaps).count()
    running.stage_rows(more, src, files=3)
    assert run() == kpis.compute_kpis(base).collect()
    assert spark.read.parquet(snaps).count() == before + 3
    assert run() == kpis.compute_kpis(base).collect()  # nothing new


def test_a_replayed_snapshot_leaves_one_row(spark, tmp_path):
    path = str(tmp_path / "snaps")
    result = spark.createDataFrame([(1, 0.5)], "churned_users long, churn_rate_overall double")
    for batch, rows in ((0, result), (1, result.limit(0).union(result)), (1, result.selectExpr("7L", "0.25D").toDF(*result.columns))):
        running.write_snapshot(rows, batch, path)
    assert spark.read.parquet(path).count() == 2
    last = running.last_snapshot(spark, path, "churned_users long, churn_rate_overall double").collect()
    assert [tuple(r) for r in last] == [(7, 0.25)]


def test_append_customers(spark, tmp_path):
    path = str(tmp_path / "cust")
    cust.append_customers(cust.generate(spark, 20), path)
    cust.append_customers(cust.generate(spark, 20, start=20), path)
    assert spark.read.parquet(path).count() == 40


def test_streaming_features_equal_batch(spark, tmp_path):
    from churnscope.operators import features as feat
    base = subscriptions(spark, SF_SMALL)
    src = running.stage_rows(base, str(tmp_path / "src"), files=3)
    out = running.run_running(spark, src, running.feature_stream(), str(tmp_path / "out"),
                              checkpoint=str(tmp_path / "ck"), post=running.feature_post())
    key = ["feature", "key"]
    assert sorted(map(tuple, out.select(*key, "churn_rate", "n").collect())) == \
        sorted(map(tuple, feat.feature_churn(base).select(*key, "churn_rate", "n").collect()))
