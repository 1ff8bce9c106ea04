"""Delivery, return and cancellation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from .products import totals_by


def _status(name: str) -> Column:
    return exact.count_if(F.col("return_status") == name)


def _rate(sales: DataFrame, status: str, name: str) -> DataFrame:
    counts = sales.agg(_status(status).alias("hits"), F.count("*").alias("orders"))
    return counts.select(F.coalesce(exact.count_percent(F.col("hits"), F.col("orders")), F.lit(0.0)).alias(name))


def average_delivery_time(sales: DataFrame) -> DataFrame:
    sums = sales.agg(F.sum("delivery_days").alias("days"), F.count("delivery_days").alias("n"))
    return sums.select(
        F.coalesce(exact.mean_count(F.col("days"), F.col("n")), F.lit(0.0)).alias("average_delivery_time"))


def cancellation_rate(sales: DataFrame) -> DataFrame:
    return _rate(sales, "Cancelled", "cancellation_rate")


def return_rate(sales: DataFrame) -> DataFrame:
    return _rate(sales, "Returned", "return_rate")


def regional_operational_performance(sales: DataFrame) -> DataFrame:
    sums = sales.groupBy("region").agg(
        F.sum("delivery_days").alias("days"), F.count("delivery_days").alias("timed"),
        _status("Returned").alias("returned"), _status("Cancelled").alias("cancelled"), F.count("*").alias("total_orders"),
    )
    return sums.select(
        "region",
        exact.mean_count(F.col("days"), F.col("timed")).alias("avg_delivery_days"),
        exact.count_percent(F.col("returned"), F.col("total_orders")).alias("return_rate_pct"),
        exact.count_percent(F.col("cancelled"), F.col("total_orders")).alias("cancellation_rate_pct"),
        "total_orders",
    ).orderBy(F.asc_nulls_last("avg_delivery_days"), "region")


def delivery_time_by_category(sales: DataFrame, products: DataFrame) -> DataFrame:
    totals = totals_by(sales, products, ["category"], ["days", "timed", "orders"])
    return totals.select(
        "category", exact.mean_count(F.col("days"), F.col("timed")).alias("avg_delivery_days"), "orders"
    ).orderBy(F.desc_nulls_first("avg_delivery_days"), "category")


def operations_summary(sales: DataFrame) -> DataFrame:
    sums = sales.agg(
        F.sum("delivery_days").alias("days"), F.count("delivery_days").alias("timed"),
        _status("Returned").alias("returned"), _status("Cancelled").alias("cancelled"), F.count("*").alias("orders"),
    )
    return sums.select(
        F.coalesce(exact.mean_count(F.col("days"), F.col("timed")), F.lit(0.0)).alias("avg_delivery_days"),
        F.coalesce(exact.count_percent(F.col("returned"), F.col("orders")), F.lit(0.0)).alias("return_rate_pct"),
        F.coalesce(exact.count_percent(F.col("cancelled"), F.col("orders")), F.lit(0.0)).alias("cancellation_rate_pct"),
    )
