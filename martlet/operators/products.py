"""Product and category metrics.

The fact is reduced to one row per product before it meets the product table:
a best-selling product is summed map-side and crosses the network as a few rows,
and the join sees each product once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact

PAIR = ["product_name", "category"]
MINIMUM_ORDERS = 5

AMOUNT = "decimal(24,2)"

_MEASURES = {
    "revenue": lambda: F.sum("revenue"),
    "quantity": lambda: F.sum("quantity"),
    "profit": lambda: F.sum("profit"),
    "orders": lambda: F.count("*"),
    "returned": lambda: exact.count_if(F.col("return_status") == "Returned"),
    "days": lambda: F.sum("delivery_days"),
    "timed": lambda: F.count("delivery_days"),
}


def sums(sales: DataFrame, measures: list[str]) -> list[Column]:
    """Aggregates of order lines, or of a summary that already holds the measure as a column."""
    return [(F.sum(m) if m in sales.columns else _MEASURES[m]()).alias(m) for m in measures]


def totals_by(sales: DataFrame, products: DataFrame, keys: list[str], measures: list[str],
              extra_keys: list[str] | None = None) -> DataFrame:
    """Sums of the measures per product attribute (and per `extra_keys` of the fact).

    `sales` may be a summary that already carries the attributes; products are then not
    read, and cells of products that the product table lacks (blank attributes) are left out.
    """
    extra_keys = extra_keys or []
    if all(k in sales.columns for k in keys):
        known = sales.dropna(subset=keys) if keys else sales
        return known.groupBy(*keys, *extra_keys).agg(*sums(sales, measures))
    named = named_cells(sales, products, keys, measures, extra_keys, "inner")
    return named.groupBy(*keys, *extra_keys).agg(*[F.sum(m).alias(m) for m in measures])


def named_cells(sales: DataFrame, products: DataFrame, keys: list[str], measures: list[str], extra_keys: list[str],
                how: str) -> DataFrame:
    """Sums per product and `extra_keys`, with product attributes; the only join is made on these sums.

    A fact without profit gives it all the same if it has quantities: the cost of a
    product's lines is its unit cost times the sum of their quantities, exactly.
    """
    derived = "profit" in measures and "profit" not in sales.columns
    summed = list(dict.fromkeys([m for m in measures if m != "profit"] + ["revenue", "quantity"])) if derived else measures
    per_product = sales.groupBy("product_id", *extra_keys).agg(*sums(sales, summed))
    columns = [*keys, F.col("cost").alias("unit_cost")] if derived else keys
    named = per_product.join(products.select("product_id", *columns), "product_id", how)
    if derived:
        named = named.withColumn("profit", (F.col("revenue") - F.col("unit_cost") * F.col("quantity")).cast(AMOUNT))
    return named.select("product_id", *keys, *extra_keys, *measures)


def profit_cells(sales: DataFrame, products: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Revenue, profit and orders per product and `keys`: a summary that metrics over `keys` sum further.

    Lines of products that the product table lacks have no profit, but keep revenue and orders.
    """
    return named_cells(sales, products, [], ["revenue", "profit", "orders"], keys or [], "left")


def monthly_summary(sales: DataFrame, products: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Sums per product name, category, region and month (`order_date` is its first day).

    Reports that roll the fact up in several ways read this instead, once it is
    stored.  Lines of unknown products are kept under blank names.  Its size follows the names, regions and months there are, not the
    number of orders, and every measure in it can be summed further.
    """
    lines = sales.withColumn("order_date", F.trunc("order_date", "month"))
    wanted = measures or [m for m in _MEASURES if m != "quantity"]
    cells = named_cells(lines, products, PAIR, wanted, ["region", "order_date"], "left")
    return cells.groupBy(*PAIR, "region", "order_date").agg(*[F.sum(m).alias(m) for m in wanted])


def top_products(sales: DataFrame, products: DataFrame, n: int = 10, by: str = "revenue") -> DataFrame:
    by = by if by in ("revenue", "profit", "orders") else "revenue"
    totals = totals_by(sales, products, PAIR, ["revenue", "profit", "orders"])
    return totals.orderBy(F.desc(by), *PAIR).limit(n)


def revenue_by_product(sales: DataFrame, products: DataFrame, top_n: int = 10) -> DataFrame:
    return top_products(sales, products, top_n, "revenue")


def bottom_products(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    totals = totals_by(sales, products, PAIR, ["revenue", "profit", "orders"])
    return totals.orderBy("revenue", *PAIR).limit(n)


def most_profitable_products(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    totals = totals_by(sales, products, PAIR, ["revenue", "profit"])
    return totals.orderBy(F.desc("profit"), *PAIR).limit(n).select(
        *PAIR, F.col("profit").alias("total_profit"),
        exact.money_percent(F.col("profit"), F.col("revenue")).alias("margin_pct"),
    )


def low_margin_products(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    totals = totals_by(sales, products, PAIR, ["revenue", "profit", "orders"]).where(F.col("orders") >= MINIMUM_ORDERS)
    return (
        totals.select(*PAIR, "revenue",
                      exact.money_percent(F.col("profit"), F.col("revenue")).alias("margin_pct"), "orders")
        .orderBy(F.asc_nulls_last("margin_pct"), *PAIR)
        .limit(n)
    )


def return_rate_by_product(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    totals = totals_by(sales, products, PAIR, ["orders", "returned"]).where(F.col("orders") >= MINIMUM_ORDERS)
    return (
        totals.select(*PAIR, F.col("orders").alias("total_orders"), F.col("returned").alias("returned_orders"),
                      exact.count_percent(F.col("returned"), F.col("orders")).alias("return_rate_pct"))
        .orderBy(F.desc("return_rate_pct"), *PAIR)
        .limit(n)
    )


def category_performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    totals = totals_by(sales, products, ["category"], ["revenue", "profit", "orders", "returned"])
    return totals.select(
        "category", "revenue", "profit", "orders",
        exact.count_percent(F.col("returned"), F.col("orders")).alias("return_rate_pct"),
    ).orderBy(F.desc("revenue"), "category")
