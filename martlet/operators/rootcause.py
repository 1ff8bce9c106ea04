"""Which slices of the business moved between two months."""

from __future__ import annotations

import calendar
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from ..functions.order_stats import attach
from .sales import in_range

METRICS = ("revenue", "profit", "cost", "quantity")
DIMENSIONS = ("region", "category", "payment_method", "return_status")
TOP = 5


def month_bounds(month: str) -> tuple[date, date]:
    """First and last day of a month written as YYYY-MM."""
    year, number = (int(part) for part in month.split("-"))
    return date(year, number, 1), date(year, number, calendar.monthrange(year, number)[1])


def month_table(sales: DataFrame) -> DataFrame:
    """First and last day of every month that has orders."""
    months = sales.select(F.trunc("order_date", "month").alias("first_day")).distinct()
    return months.select(F.date_format("first_day", "yyyy-MM").alias("month"), "first_day",
                         F.last_day("first_day").alias("last_day"))


def _checked(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return metric


def _amount(metric: str) -> Column:
    return F.col(_checked(metric)).cast("decimal(12,2)")


def period_total(sales: DataFrame, start: date, end: date, metric: str = "revenue") -> DataFrame:
    total = F.coalesce(F.sum(_amount(metric)), F.lit(0))
    return in_range(sales, start, end).agg(total.alias("period_total"))


def period_breakdown(sales: DataFrame, products: DataFrame, start: date, end: date, dimension: str,
                     metric: str = "revenue") -> DataFrame:
    """The metric per value of one dimension; products are read only for the category."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"dimension must be one of {DIMENSIONS}")
    lines = in_range(sales, start, end)
    if dimension == "category":
        per_product = lines.groupBy("product_id").agg(F.sum(_amount(metric)).alias("value"))
        sums = per_product.join(products.select("product_id", "category"), "product_id").groupBy("category").agg(
            F.sum("value").alias("value"))
    else:
        sums = lines.groupBy(dimension).agg(F.sum(_amount(metric)).alias("value"))
    return sums.select(F.lit(dimension).alias("dimension_type"), F.col(dimension).alias("dimension_value"), "value").orderBy(
        F.desc("value"), "dimension_value")


def _changes(sales: DataFrame, products: DataFrame, period_a: str, period_b: str, metric: str) -> DataFrame:
    """Before and after of every slice of every dimension, from one pass over the two months.

    Lines are summed per product and the three dimensions of the fact before
    the product join and before they are laid out under four headings.
    """
    a, b = month_bounds(period_a), month_bounds(period_b)
    in_a, in_b = F.col("order_date").between(*map(F.lit, a)), F.col("order_date").between(*map(F.lit, b))
    derived = _checked(metric) in ("profit", "cost") and metric not in sales.columns
    read = ["revenue", "quantity"] if derived else [metric]
    cells = sales.where(in_a | in_b).groupBy("product_id", "region", "payment_method", "return_status").agg(*[
        F.sum(F.when(hit, _amount(m))).alias(f"{name}_{m}") for m in read for name, hit in (("before", in_a), ("after", in_b))])
    # The product table gives the category and, for a fact without it, the cost; an unknown product has neither.
    named = cells.join(products.select("product_id", "category", F.col("cost").alias("unit_cost")), "product_id", "left")
    for name in ("before", "after"):
        cost = F.col("unit_cost") * F.col(f"{name}_quantity") if derived else None
        value = F.col(f"{name}_{metric}") if not derived else cost if metric == "cost" else F.col(f"{name}_revenue") - cost
        named = named.withColumn(name, value.cast("decimal(28,2)"))
    laid_out = named.select("before", "after", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension_type"), F.col(d).alias("dimension_value")) for d in DIMENSIONS])).alias("slice"))
    zero = F.lit(0).cast("decimal(12,2)")
    # Lines of unknown products have no category; they count in every other dimension and in the total.
    known = (F.col("slice.dimension_type") != "category") | F.col("slice.dimension_value").isNotNull()
    return laid_out.where(known).groupBy("slice.dimension_type", "slice.dimension_value").agg(
        F.coalesce(F.sum("before"), zero).alias("before"), F.coalesce(F.sum("after"), zero).alias("after"))


def compare_periods(sales: DataFrame, products: DataFrame, period_a: str, period_b: str, metric: str = "revenue") -> DataFrame:
    """Slices that moved by at least 1 % of the first period's total, largest decline first."""
    changes = _changes(sales, products, period_a, period_b, metric)
    # The total is the slice of the region's dimension taken as a whole: every line has its place in it.
    totals = changes.where(F.col("dimension_type") == "region").agg(F.struct(F.sum("before").alias("a"), F.sum("after").alias("b")).alias("sums"))
    moved = attach(changes.withColumn("change", F.col("after") - F.col("before")), "sums", totals).withColumns(
        {"total_a": F.col("sums.a"), "total_b": F.col("sums.b")})
    relevant = moved.where(F.abs("change") * 100 >= F.abs("total_a"))
    per_slice = exact.half_up(exact.cents(F.col("change")), exact.cents(F.col("before")), 1000).cast("double") / 10
    of_total = exact.money_percent(F.col("change"), F.col("total_b") - F.col("total_a"))
    return relevant.select(
        "dimension_type", "dimension_value", "before", "after", "change",
        F.coalesce(per_slice, F.lit(0.0)).alias("pct_change"), F.coalesce(of_total, F.lit(0.0)).alias("pct_of_total_change"),
    ).orderBy("change", "dimension_type", "dimension_value")


def compare_totals(sales: DataFrame, period_a: str, period_b: str, metric: str = "revenue") -> DataFrame:
    a, b = month_bounds(period_a), month_bounds(period_b)
    in_a, in_b = F.col("order_date").between(*map(F.lit, a)), F.col("order_date").between(*map(F.lit, b))
    zero = F.lit(0).cast("decimal(12,2)")
    totals = sales.where(in_a | in_b).agg(
        F.coalesce(F.sum(F.when(in_a, _amount(metric))), zero).alias("total_a"),
        F.coalesce(F.sum(F.when(in_b, _amount(metric))), zero).alias("total_b"))
    change = exact.money_percent(F.col("total_b") - F.col("total_a"), F.col("total_a"))
    return totals.select(
        F.lit(metric).alias("metric"), F.lit(period_a).alias("period_a"), F.lit(period_b).alias("period_b"),
        "total_a", "total_b", F.coalesce(change, F.lit(0.0)).alias("pct_change"))


def top_negative_contributors(contributors: DataFrame, n: int = TOP) -> DataFrame:
    return contributors.orderBy("change", "dimension_type", "dimension_value").limit(n)


def top_positive_contributors(contributors: DataFrame, n: int = TOP) -> DataFrame:
    return contributors.orderBy(F.desc("change"), F.desc("dimension_type"), F.desc("dimension_value")).limit(n)


def auto_periods(sales: DataFrame) -> DataFrame:
    """The last two full months: one and two before the month of the latest order."""
    latest = sales.agg(F.trunc(F.max("order_date"), "month").alias("latest"))
    return latest.select(F.date_format(F.add_months("latest", -2), "yyyy-MM").alias("period_a"),
                         F.date_format(F.add_months("latest", -1), "yyyy-MM").alias("period_b"))
