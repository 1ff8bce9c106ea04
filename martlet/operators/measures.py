"""KPI measures under any grouping.

`kpis` evaluates measures per combination of dimension values.  Ratios are
fractions, and a zero or missing divisor gives 0.  These definitions differ on
purpose from the metrics in `sales` and `customers` (percentages, all customers,
previous present month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exact
from ..functions.order_stats import attach, with_rank

INACTIVITY_DAYS = 90
TOP_RANK = 10

_SUMS = {
    "total_revenue": lambda: F.sum("revenue"),
    "total_profit": lambda: F.sum("profit"),
    "total_orders": lambda: F.count("*"),
    "returned": lambda: exact.count_if(F.col("return_status") == "Returned"),
    "cancelled": lambda: exact.count_if(F.col("return_status") == "Cancelled"),
    "days": lambda: F.sum("delivery_days"),
    "timed": lambda: F.count("delivery_days"),
}
# Measures of customers: these need the finer grain of one row per group and customer.
_CUSTOMER_SUMS = {
    "total_customers": lambda: F.count("customer_id"),
    "returning_customers": lambda: F.count_if(F.col("customer_id").isNotNull() & (F.col("total_orders") > 1)),
}
_RATIOS: dict[str, tuple[str, str]] = {
    "avg_order_value": ("total_revenue", "total_orders"),
    "profit_margin": ("total_profit", "total_revenue"),
    "return_rate": ("returned", "total_orders"),
    "cancellation_rate": ("cancelled", "total_orders"),
    "retention_rate": ("returning_customers", "total_customers"),
    "clv": ("total_revenue", "total_customers"),
    "avg_delivery_days": ("days", "timed"),
}
_BLANK_WITHOUT_DIVISOR = {"avg_delivery_days"}


def _needed(measures: list[str]) -> list[str]:
    names = {part for m in measures for part in _RATIOS.get(m, (m,))}
    return [n for n in [*_SUMS, *_CUSTOMER_SUMS] if n in names]


def kpis(fact: DataFrame, group_by: list[str], measures: list[str], where: Column | None = None) -> DataFrame:
    """The measures for every combination of the grouping columns (one row if there are none), over the rows that `where` keeps.

    Customer measures are counted from one row per group and customer, so the
    distinct count is spread over customers and a hot group stays divided.
    """
    unknown = [m for m in measures if m not in _RATIOS and m not in _SUMS and m not in _CUSTOMER_SUMS]
    if unknown:
        raise ValueError(f"unknown measures: {unknown}")
    fact = fact.where(where) if where is not None else fact
    needed = _needed(measures)
    per_customer = [n for n in needed if n in _CUSTOMER_SUMS]
    if per_customer:
        partial = list(dict.fromkeys([n for n in needed if n in _SUMS] + ["total_orders"]))
        cells = fact.groupBy(*group_by, "customer_id").agg(*[_SUMS[n]().alias(n) for n in partial])
        sums = cells.groupBy(*group_by).agg(
            *[F.sum(n).alias(n) for n in partial], *[_CUSTOMER_SUMS[n]().alias(n) for n in per_customer])
    else:
        sums = fact.groupBy(*group_by).agg(*[_SUMS[n]().alias(n) for n in needed])
    return sums.select(*group_by, *[_measure(m).alias(m) for m in measures])


def _measure(name: str) -> Column:
    if name not in _RATIOS:
        return F.col(name)
    num, den = _RATIOS[name]
    if name in _BLANK_WITHOUT_DIVISOR:
        return F.col(num).cast("double") / F.nullif(F.col(den).cast("double"), F.lit(0.0))
    return exact.fraction(F.col(num), F.col(den))


def churn_rate_90(fact: DataFrame, group_by: list[str], days: int = INACTIVITY_DAYS) -> DataFrame:
    """Share of a group's customers whose last order lies more than `days` before the group's last.

    Customers are first counted per group and last-order date, so the window
    holds at most one row per calendar day of a group.
    """
    last = fact.groupBy(*group_by, "customer_id").agg(F.max("order_date").alias("last_order"))
    cells = last.groupBy(*group_by, "last_order").agg(F.count("*").alias("customers"))
    dated = cells.withColumn("latest", F.max("last_order").over(Window.partitionBy(*group_by)))
    gone = F.when(F.datediff("latest", "last_order") > days, F.col("customers")).otherwise(0)
    sums = dated.groupBy(*group_by).agg(F.sum(gone).alias("gone"), F.sum("customers").alias("all"))
    return sums.select(*group_by, exact.fraction(F.col("gone"), F.col("all")).alias("churn_rate_90"))


def date_table(fact: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last order."""
    span = fact.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    days = span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month_num"),
        F.date_format("date", "MMM yyyy").alias("month_name"),
        F.concat(F.lit("Q"), F.quarter("date"), F.lit(" "), F.year("date")).alias("quarter"),
    )


def prior_month(fact: DataFrame, measure: str, group_by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Monthly total of revenue or profit, that of the same dates one month earlier, and the growth, per group.

    Every month of the calendar from the first to the last order has a row (of each
    group, every month that has a total or a prior one): a month without orders has no
    total, but still its prior value and a growth of -1.  A month that the calendar
    holds only in part, the last one, is compared with the same days of the month before.
    """
    if measure not in ("revenue", "profit"):
        raise ValueError("measure must be revenue or profit")
    groups = group_by or []
    span = fact.agg(F.struct(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")).alias("span"))
    kept = fact.where(where) if where is not None else fact
    daily = kept.where(F.col("order_date").isNotNull()).groupBy(*groups, "order_date").agg(F.sum(measure).alias("amount"))
    current = daily.groupBy(*groups, F.trunc("order_date", "month").alias("month")).agg(F.sum("amount").alias("current"))
    ends = attach(daily, "span", span)
    hi = F.col("span.hi")
    month = F.add_months(F.trunc("order_date", "month"), 1)
    whole = (month < F.trunc(hi, "month")) | (hi == F.last_day(hi))
    same_days = (month == F.trunc(hi, "month")) & (F.dayofmonth("order_date") <= F.dayofmonth(hi))
    shifted = ends.where((month <= F.trunc(hi, "month")) & (whole | same_days)).groupBy(*groups, month.alias("month")).agg(
        F.sum("amount").alias("prior"))
    both = current.join(shifted, [*groups, "month"], "full")
    if not groups:
        months = date_table(fact).select(F.trunc("date", "month").alias("month")).distinct()
        both = months.join(both, "month", "left")
    growth = exact.fraction(F.coalesce("current", F.lit(0)) - F.col("prior"), F.col("prior"))
    return both.select(
        *groups, "month", F.col("current").alias(f"total_{measure}"), F.col("prior").alias(f"{measure}_prior_month"),
        growth.alias(f"{measure}_mom_growth"))


def new_customers(fact: DataFrame, customers: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Customers by signup month, for the months of the date table and days inside its span.

    `group_by` names columns of the customers; a group then has the months in which it has signups.
    """
    groups = group_by or []
    span = fact.agg(F.struct(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")).alias("span"))
    inside = attach(customers, "span", span).where(F.col("signup_date").between(F.col("span.lo"), F.col("span.hi")))
    signups = inside.groupBy(*groups, F.trunc("signup_date", "month").alias("month")).agg(
        F.countDistinct("customer_id").alias("new_customers"))
    if groups:
        return signups
    months = date_table(fact).select(F.trunc("date", "month").alias("month")).distinct()
    return months.join(signups, "month", "left").select("month", F.coalesce("new_customers", F.lit(0)).alias("new_customers"))


def revenue_rank(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Rank of every product name by revenue, ties sharing a rank; and whether it is in the top ten."""
    per_product = fact.groupBy("product_id").agg(F.sum("revenue").alias("revenue"))
    named = per_product.join(products.select("product_id", "product_name"), "product_id", "right")
    totals = named.groupBy("product_name").agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"))
    units = totals.withColumn("units", exact.cents(F.col("total_revenue")).cast("bigint"))
    ranked = with_rank(units, "units", "revenue_rank")
    return ranked.select(
        "product_name", "total_revenue", "revenue_rank",
        F.when(F.col("revenue_rank") <= TOP_RANK, "Top 10").otherwise("Other").alias("top10_flag"))
