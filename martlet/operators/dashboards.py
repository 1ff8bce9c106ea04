"""One-row KPI bundles behind the summary pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exact
from ..functions.shared import latest


def home_summary(sales: DataFrame, customers: DataFrame) -> DataFrame:
    n = F.sum("orders") if "orders" in sales.columns else F.count("revenue")
    sums = sales.agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), n.alias("n"))
    zero = F.lit(0.0)
    return sums.select(
        F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
        customers.agg(F.count("*").alias("n")).scalar().alias("total_customers"),
        F.coalesce(exact.mean_money(F.col("revenue"), F.col("n")), zero).alias("average_order_value"),
        F.coalesce(exact.money_percent(F.col("profit"), F.col("revenue")), zero).alias("profit_margin_pct"),
    )


def executive_summary(sales: DataFrame, customers: DataFrame, inactivity_days: int = 90) -> DataFrame:
    """Money, orders, retention and churn from one pass: per customer, then per last-order date."""
    per_customer = sales.groupBy("customer_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.count("revenue").alias("n"),
        F.count("*").alias("orders"), F.max("order_date").alias("last_order"))
    cells = per_customer.groupBy("last_order").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.sum("n").alias("n"),
        F.sum("orders").alias("orders"), F.count("*").alias("customers"), F.count_if(F.col("orders") > 1).alias("back"))
    gone = F.when(F.datediff(latest(cells, "last_order"), F.col("last_order")) > inactivity_days, F.col("customers")).otherwise(0)
    sums = cells.agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.sum("n").alias("n"),
        F.sum("orders").alias("orders"), F.sum("customers").alias("customers"), F.sum("back").alias("back"),
        F.sum(gone).alias("gone"))
    zero = F.lit(0.0)
    return sums.select(
        F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
        F.coalesce("profit", F.lit(0)).alias("total_profit"),
        F.coalesce("orders", F.lit(0)).alias("total_orders"),
        customers.agg(F.count("*").alias("n")).scalar().alias("total_customers"),
        F.coalesce(exact.count_percent(F.col("back"), F.col("customers")), zero).alias("retention_rate_pct"),
        F.coalesce(exact.count_percent(F.col("gone"), F.col("customers")), zero).alias(f"churn_rate_{inactivity_days}d_pct"),
        F.coalesce(exact.mean_money(F.col("revenue"), F.col("n")), zero).alias("average_order_value"),
    )
