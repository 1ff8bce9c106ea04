"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores.
Every query runs to the end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "category_performance", "total_revenue", "profit_margin_in_range", "monthly_revenue", "revenue_by_region",
    "discount_analysis", "top_products", "return_rate_by_product", "regional_operational_performance",
    "customer_lifetime_value", "churn_rate", "executive_summary",
    "kpi_retention_rate", "kpi_all_by_category", "kpi_revenue_mom_growth", "revenue_rank",
    "dq_full_duplicates", "dq_outliers_iqr", "clean_orders", "quality_report", "orphan_orders",
    "rfm_segments", "segment_profile", "churn_features", "feature_summary", "churn_split",
    "daily_metrics", "detect_anomalies", "compare_periods", "recommendation_cards",
    "classify_questions", "answer_questions",
]


def main() -> None:
    from martlet.plans.session import local_session
    from martlet.registry import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
