"""Sales metrics.  Percentages are times 100 with two decimals; empty input gives 0."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exact
from .products import sums as sums_of

# Discount bracket labels and their upper bounds.
DISCOUNT_BRACKETS = [("No discount", "0"), ("1-10%", "0.10"), ("11-20%", "0.20")]
TOP_DISCOUNT_BRACKET = "21%+"


def in_range(df: DataFrame, start: date | None = None, end: date | None = None, column: str = "order_date") -> DataFrame:
    """Rows between two dates, both included; a missing bound is open."""
    if start:
        df = df.where(F.col(column) >= F.lit(start))
    if end:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def _totals(sales: DataFrame, start, end, **aggregates: Column) -> DataFrame:
    return in_range(sales, start, end).agg(*[c.alias(name) for name, c in aggregates.items()])


def total_revenue(sales: DataFrame, start=None, end=None) -> DataFrame:
    return _totals(sales, start, end, total_revenue=F.coalesce(F.sum("revenue"), F.lit(0)))


def total_profit(sales: DataFrame, start=None, end=None) -> DataFrame:
    return _totals(sales, start, end, total_profit=F.coalesce(F.sum("profit"), F.lit(0)))


def profit_margin(sales: DataFrame, start=None, end=None) -> DataFrame:
    sums = _totals(sales, start, end, profit=F.sum("profit"), revenue=F.sum("revenue"))
    margin = exact.money_percent(F.col("profit"), F.col("revenue"))
    return sums.select(F.coalesce(margin, F.lit(0.0)).alias("profit_margin"))


def average_order_value(sales: DataFrame, start=None, end=None) -> DataFrame:
    sums = _totals(sales, start, end, revenue=F.sum("revenue"), orders=F.count("revenue"))
    mean = exact.mean_money(F.col("revenue"), F.col("orders"))
    return sums.select(F.coalesce(mean, F.lit(0.0)).alias("average_order_value"))


def _revenue_by(sales: DataFrame, key: Column, name: str) -> DataFrame:
    return sales.groupBy(key.alias(name)).agg(*sums_of(sales, ["revenue", "profit", "orders"]))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return _revenue_by(sales, F.trunc("order_date", "month"), "month").orderBy("month")


def quarterly_revenue(sales: DataFrame) -> DataFrame:
    return _revenue_by(sales, F.trunc("order_date", "quarter"), "quarter").orderBy("quarter")


def revenue_growth_mom(sales: DataFrame) -> DataFrame:
    """Growth against the previous month present; null for the first month and after a zero."""
    monthly = sales.groupBy(F.trunc("order_date", "month").alias("month")).agg(F.sum("revenue").alias("revenue"))
    # One row per calendar month, so one ordered window over all of them is small.
    previous = F.lag("revenue").over(Window.orderBy("month"))
    growth = exact.money_percent(F.col("revenue") - F.col("previous"), F.col("previous"))
    return (
        monthly.withColumn("previous", previous)
        .select("month", "revenue", growth.alias("revenue_growth_pct"))
        .orderBy("month")
    )


def recent_growth(sales: DataFrame, months: int = 12) -> DataFrame:
    latest = revenue_growth_mom(sales).orderBy(F.desc("month")).limit(months)
    return latest.orderBy("month")


def revenue_by_region(sales: DataFrame) -> DataFrame:
    return _revenue_by(sales, F.col("region"), "region").orderBy(F.desc("revenue"), "region")


def discount_bracket(discount: Column) -> Column:
    bracket = F.lit(TOP_DISCOUNT_BRACKET)
    for label, upper in reversed(DISCOUNT_BRACKETS):
        bound = F.lit(upper).cast("decimal(5,2)")
        bracket = F.when((discount == bound) if upper == "0" else (discount <= bound), label).otherwise(bracket)
    return bracket


def discount_analysis(sales: DataFrame) -> DataFrame:
    """`sales` may be cells that hold profit and orders per discount."""
    profits = F.sum(F.when(F.col("profit").isNotNull(), F.col("orders"))) if "orders" in sales.columns else F.count("profit")
    per_bracket = sales.groupBy(discount_bracket(F.col("discount")).alias("discount_bracket")).agg(
        *sums_of(sales, ["revenue", "profit", "orders"]), profits.alias("profits"), F.min("discount").alias("lowest"))
    return per_bracket.orderBy("lowest").select(
        "discount_bracket", "orders", "revenue",
        exact.mean_money(F.col("profit"), F.col("profits")).alias("avg_profit_per_order"),
    )


def with_discount_bracket(sales: DataFrame) -> DataFrame:
    """The bracket as a column of every order line."""
    return sales.withColumn("discount_bracket", discount_bracket(F.col("discount")))


def order_count(sales: DataFrame) -> DataFrame:
    return sales.agg(F.count("*").alias("order_count"))


def sales_summary(sales: DataFrame) -> DataFrame:
    n = F.sum("orders") if "orders" in sales.columns else F.count("revenue")
    sums = sales.agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), n.alias("n"))
    return sums.select(
        F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
        F.coalesce("profit", F.lit(0)).alias("total_profit"),
        F.coalesce(exact.money_percent(F.col("profit"), F.col("revenue")), F.lit(0.0)).alias("profit_margin_pct"),
        F.coalesce(exact.mean_money(F.col("revenue"), F.col("n")), F.lit(0.0)).alias("average_order_value"),
    )
