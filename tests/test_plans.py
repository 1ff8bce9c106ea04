"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from martlet import registry
from martlet.operators import quality, sales as sa
from martlet.sources.star import Star

# These write tables or fit models when built; their parts are covered by other queries.
EAGER = {n for n in registry.QUERIES if n.startswith(("churn_", "risk_")) and n not in ("churn_features", "churn_balance", "churn_rate")} | {
    "read_star", "read_cleaned", "append_cleaned", "load_reconcile", "write_quality_outputs", "profile_upload", "preview_upload",
    "write_ml_outputs", "recommendation_cards", "answer_questions"}
# Single-task windows over frames whose length is bounded: calendar months or days, and value buckets.
BOUNDED = ("order_date", "month", "_coarse")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER))
def test_plan_scales(no_broadcast, name):
    plan = plan_of(registry.QUERIES[name](no_broadcast, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"[- ]Window \[", line) and any("SinglePartition" in below for below in lines[i + 1:i + 4]):
            order = re.findall(r"windowspecdefinition\((.*?) ASC", line)
            assert order and all(any(word in o for word in BOUNDED) for o in order), line


def test_scan_reads_only_what_a_metric_needs(spark):
    plan = plan_of(entry.queries()["return_rate"](spark, SMALL))
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<l_returnflag:string>" in plan
    assert "Join" not in plan


def test_date_range_reaches_the_reader(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(entry.queries()["total_revenue_in_range"](spark, SMALL))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate,1996-03-01", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate,1998-03-01", plan)


def test_top_k_keeps_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["top_products"](spark, SMALL))


@pytest.mark.parametrize("name", ["category_performance", "top_products", "bottom_products", "most_profitable_products", "low_margin_products",
                                  "revenue_by_product", "answer_losing_products", "rec_unprofitable_products", "total_profit", "profit_margin"])
def test_fact_is_summed_before_it_meets_products(no_broadcast, name):
    """One scan of the lines, one of the parts, and the only join stands above the sum per product."""
    plan = plan_of(registry.QUERIES[name](no_broadcast, SMALL))
    joins = [i for i, line in enumerate(plan.split("\n")) if "Join" in line]
    assert len(joins) == 1 and plan.count("FileScan") == 2
    below = plan.split("\n")[joins[0]:]
    assert sum("partial_sum" in line for line in below) == 1
    assert not any("lineitem" in line for line in plan.split("\n")[:joins[0]])


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        Star(spark, SMALL).sales("salary")


def test_one_shuffle_of_the_fact_serves_rows_and_latest_date(spark):
    for name in ("rfm_base", "churn_features", "churn_rate", "executive_summary"):
        df = registry.QUERIES[name](spark, SMALL)
        df.collect()
        assert "ReusedExchange" in plan_of(df), name


def test_hot_customer_is_split_in_the_join(spark):
    """A third of all lines belong to one customer: AQE cuts that partition of the join in pieces."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 60000, 1, 8).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 5000 END AS customer_id",
                                                     "id % 40 AS product_id", "rpad(CAST(id AS STRING), 60, 'x') AS order_id")
        marked = quality.mark_foreign_keys(ids, spark.range(0, 5000, 2).select(F.col("id").alias("customer_id")),
                                           spark.range(30).select(F.col("id").alias("product_id")))
        rows = marked.groupBy("dq_orphan_customer", "dq_orphan_product").count()
        got = {tuple(r)[:2]: r["count"] for r in rows.collect()}
        assert "skew=true" in plan_of(rows)
        expected = {}
        for i in range(60000):
            c = 7 if i % 3 == 0 else i % 5000
            key = (c % 2 == 1, i % 40 >= 30)
            expected[key] = expected.get(key, 0) + 1
        assert got == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_operators_stay_lazy(spark):
    """Building a query runs no job."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    star = Star(spark, SMALL)
    sa.monthly_revenue(star.sales("order_date", "revenue", "profit"))
    registry.QUERIES["rfm_segments"](spark, SMALL)
    registry.QUERIES["quality_report"](spark, SMALL)
    spark.sparkContext.setJobGroup("", "")
    # Reading a parquet footer is the one job that opening a file may start.
    assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in tracker.getJobIdsForGroup("lazy"))
