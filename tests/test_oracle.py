"""Registered queries against their SQL: on the given tables, and on skewed ones."""

import pytest

import __spark_entry__ as entry
import oracle
from compare import TABLES, difference, duck
from conftest import SMALL

from martlet.registry import QUERIES  # noqa: E402

SQL = oracle.all_sql()
SKEWED = [
    "category_performance", "top_products", "monthly_revenue", "customer_lifetime_value", "churn_rate", "executive_summary",
    "returning_customers", "kpi_total_customers", "kpi_retention_rate", "kpi_churn_rate_90", "kpi_all_by_category",
    "revenue_rank", "dq_full_duplicates", "dq_duplicate_key", "dq_outliers_iqr", "dq_fk_violations", "clean_orders",
    "reject_reasons", "transformation_log", "quality_report", "orphan_orders", "constraint_violations",
    "rfm_scores", "segment_profile", "apply_segments", "churn_features", "feature_summary", "churn_split",
    "daily_metrics", "detect_anomalies", "compare_periods", "recommendation_cards", "answer_questions",
]


def test_registry_and_sql_belong_together():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "churn_logistic", "churn_forest", "churn_evaluate", "churn_select", "churn_feature_impact", "churn_score",
        "risk_counts", "risk_filter", "churn_model_io"}


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == ["category", "revenue", "profit", "orders", "return_rate_pct"]


@pytest.fixture(scope="module")
def small():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_on_given_tables(spark, small, name):
    assert difference(QUERIES[name](spark, SMALL), small, SQL[name]) is None


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The small tables with a third of the lines in one order, a third of one product, a third of the orders of one customer."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duck(SMALL)
    changed = {
        "lineitem": "SELECT * EXCLUDE (i) REPLACE (CASE WHEN i % 3 = 0 THEN 1 ELSE l_partkey END AS l_partkey, CASE WHEN i % 3 = 1 THEN "
                    "(SELECT MIN(o_orderkey) FROM orders) ELSE l_orderkey END AS l_orderkey) "
                    "FROM (SELECT *, row_number() OVER () AS i FROM lineitem)",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey) FROM orders",
    }
    for table in TABLES:
        con.execute(f"COPY ({changed.get(table, f'SELECT * FROM {table}')}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return folder, duck(folder)


@pytest.mark.parametrize("name", SKEWED)
def test_equal_on_skewed_tables(spark, skewed, name):
    folder, con = skewed
    assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None
