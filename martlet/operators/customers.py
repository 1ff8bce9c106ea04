"""Customer metrics.  "Now" is the latest order date, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from ..functions.shared import latest


def total_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count("*").alias("total_customers"))


def new_customers_by_month(customers: DataFrame) -> DataFrame:
    month = F.trunc("signup_date", "month").alias("month")
    return customers.groupBy(month).agg(F.count("*").alias("new_customers")).orderBy("month")


def _orders_per_customer(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.count("*").alias("orders"))


def returning_customers(sales: DataFrame) -> DataFrame:
    return _orders_per_customer(sales).agg(F.count_if(F.col("orders") > 1).alias("returning_customers"))


def retention_rate(sales: DataFrame) -> DataFrame:
    counts = _orders_per_customer(sales).agg(F.count_if(F.col("orders") > 1).alias("back"), F.count("*").alias("all"))
    return counts.select(F.coalesce(exact.count_percent(F.col("back"), F.col("all")), F.lit(0.0)).alias("retention_rate"))


def average_purchase_frequency(sales: DataFrame) -> DataFrame:
    counts = _orders_per_customer(sales).agg(F.sum("orders").alias("orders"), F.count("*").alias("all"))
    mean = exact.mean_count(F.col("orders"), F.col("all"))
    return counts.select(F.coalesce(mean, F.lit(0.0)).alias("average_purchase_frequency"))


def last_order_histogram(sales: DataFrame) -> DataFrame:
    """Customers per date of their last order: at most one row per calendar day."""
    last = sales.groupBy("customer_id").agg(F.max("order_date").alias("last_order"))
    return last.groupBy("last_order").agg(F.count("*").alias("customers"))


def _churn_percent(histogram: DataFrame, inactivity_days: int, name: str) -> DataFrame:
    gone: Column = F.sum(F.when(F.datediff(latest(histogram, "last_order"), F.col("last_order")) > inactivity_days, F.col("customers")).otherwise(0))
    counts = histogram.agg(gone.alias("gone"), F.sum("customers").alias("all"))
    return counts.select(F.coalesce(exact.count_percent(F.col("gone"), F.col("all")), F.lit(0.0)).alias(name))


def churn_rate(sales: DataFrame, inactivity_days: int = 90) -> DataFrame:
    return _churn_percent(last_order_histogram(sales), inactivity_days, "churn_rate")


def customer_lifetime_value(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Every customer, also those who never ordered; the fact is summed before the join."""
    spent = sales.groupBy("customer_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.count("*").alias("orders")
    )
    return (
        customers.select("customer_id", "name", "region")
        .join(spent, "customer_id", "left")
        .select(
            "customer_id", "name", "region",
            F.coalesce("revenue", F.lit(0)).alias("lifetime_revenue"),
            F.coalesce("profit", F.lit(0)).alias("lifetime_profit"),
            F.coalesce("orders", F.lit(0)).alias("total_orders"),
        )
        .orderBy(F.desc("lifetime_revenue"), "customer_id")
    )


def top_customers(sales: DataFrame, customers: DataFrame, n: int = 15) -> DataFrame:
    return customer_lifetime_value(sales, customers).limit(n)


def customers_summary(sales: DataFrame, customers: DataFrame, inactivity_days: int = 90) -> DataFrame:
    """Four customer KPIs in one row, from one aggregate per customer."""
    per_customer = sales.groupBy("customer_id").agg(F.count("*").alias("orders"), F.max("order_date").alias("last_order"))
    cells = per_customer.groupBy("last_order").agg(
        F.count("*").alias("customers"), F.count_if(F.col("orders") > 1).alias("back"), F.sum("orders").alias("orders"))
    known = customers.agg(F.count("*").alias("n")).scalar()
    sums = cells.agg(
        F.sum("customers").alias("all"), F.sum("back").alias("back"), F.sum("orders").alias("orders"),
        F.sum(F.when(F.datediff(latest(cells, "last_order"), F.col("last_order")) > inactivity_days,
                     F.col("customers")).otherwise(0)).alias("gone"),
    )
    zero = F.lit(0.0)
    return sums.select(
        known.alias("total_customers"),
        F.coalesce(exact.count_percent(F.col("back"), F.col("all")), zero).alias("retention_rate_pct"),
        F.coalesce(exact.count_percent(F.col("gone"), F.col("all")), zero).alias(f"churn_rate_{inactivity_days}d_pct"),
        F.coalesce(exact.mean_count(F.col("orders"), F.col("all")), zero).alias("avg_purchase_frequency"),
    )
