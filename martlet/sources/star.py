"""The star schema bound to the given tables.

`Star.sales(...)` builds only the joins its requested columns need: a question
about return status reads two columns of `lineitem` and joins nothing, as it
would on a denormalised fact.  This rests on the declared foreign keys (every
line has its order, customer and part); `quality.orphan_orders` checks them.
Customers meet the orders before the orders meet the lines, so the wide shuffle
on the customer key moves orders, not lines.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.session import prepare

_LINE = {
    "order_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))",
    "product_id": "l_partkey",
    "quantity": "CAST(l_quantity AS INT)",
    "revenue": "CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - 3 * CAST(l_discount AS DECIMAL(5,2))), 2)"
               " AS DECIMAL(12,2))",
    "discount": "CAST(3 * CAST(l_discount AS DECIMAL(5,2)) AS DECIMAL(5,2))",
    "return_status": "CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Cancelled' ELSE 'Not Returned' END",
}
_ORDER = {
    "customer_id": "o_custkey",
    "order_date": "CAST(o_orderdate AS DATE)",
    "payment_method": "o_orderpriority",
}
_GEOGRAPHY = {
    "region": "r_name",
    "delivery_days": "CAST(CASE WHEN n_regionkey IN (1, 3) THEN 1 + (l_orderkey + l_linenumber + l_suppkey) % 3"
                     " ELSE 2 + (l_orderkey + l_linenumber + l_suppkey) % 6 END AS INT)",
}
_LINE_COST = "CAST(CAST(l_quantity AS INT) * unit_cost AS DECIMAL(12,2))"
_UNIT = {
    "cost": _LINE_COST,
    "profit": f"CAST({_LINE['revenue']} - {_LINE_COST} AS DECIMAL(12,2))",
}
SALES_COLUMNS = ["order_id", "customer_id", "product_id", "order_date", "quantity", "revenue", "cost", "discount",
                 "profit", "region", "payment_method", "delivery_days", "return_status"]
_EXPRESSIONS = {**_LINE, **_ORDER, **_GEOGRAPHY, **_UNIT}


class Star:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def customers(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .selectExpr(
                "c_custkey AS customer_id", "c_name AS name", "CAST(18 + c_custkey % 47 AS INT) AS age",
                "n_name AS city", "r_name AS region",
                "date_add(DATE '1995-01-01', CAST(c_custkey * 37 % 2400 AS INT)) AS signup_date",
                "CAST(NULL AS STRING) AS customer_segment",
            )
        )

    def products(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS product_id", "p_name AS product_name", "p_type AS category", "p_brand AS sub_category",
            "CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2)) * 1.6BD, 2) AS DECIMAL(10,2)) AS cost",
            "CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2)) * 2.2BD, 2) AS DECIMAL(10,2)) AS price",
        )

    def sales(self, *columns: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """Order lines with the named columns (all by default), optionally of a date range.

        The range is inclusive and is put on the stored timestamp, so that it
        reaches the parquet reader.
        """
        wanted = list(columns) or SALES_COLUMNS
        unknown = [c for c in wanted if c not in _EXPRESSIONS]
        if unknown:
            raise ValueError(f"unknown sales columns: {unknown}")
        lines = self.table("lineitem")
        needs_place = any(c in _GEOGRAPHY for c in wanted)
        if needs_place or start or end or any(c in _ORDER for c in wanted):
            lines = lines.join(self._orders(needs_place, "region" in wanted, start, end),
                               F.col("l_orderkey") == F.col("o_orderkey"))
        if any(c in _UNIT for c in wanted):
            unit = self.products().select("product_id", F.col("cost").alias("unit_cost"))
            lines = lines.join(unit, F.col("l_partkey") == F.col("product_id"))
        return lines.select(*[F.expr(_EXPRESSIONS[c]).alias(c) for c in wanted])

    def _orders(self, place: bool, named: bool, start: date | None, end: date | None) -> DataFrame:
        orders = self.table("orders")
        if start:
            orders = orders.where(F.col("o_orderdate") >= F.lit(start.isoformat()).cast("timestamp_ntz"))
        if end:
            orders = orders.where(F.col("o_orderdate") < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
        if place:
            # One table at a time: Spark knows the size of each and broadcasts those that are small.
            orders = orders.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
                self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            if named:
                orders = orders.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return orders
