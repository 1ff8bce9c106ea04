from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from martlet.plans.session import local_session  # noqa: E402
from martlet.sources.schemas import CUSTOMERS, ORDERS, PRODUCTS, as_raw  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    yield session
    session.stop()


def day(text: str) -> date:
    return date.fromisoformat(text)


class Shop:
    """Builds small star tables from short rows; what a test does not name gets a harmless value."""

    def __init__(self, spark):
        self.spark = spark

    def sales(self, *rows: dict):
        full = []
        for i, given in enumerate(rows):
            row = {
                "order_id": str(i), "customer_id": 1, "product_id": 1, "order_date": day("2024-01-01"), "quantity": 1,
                "revenue": 100, "cost": 60, "discount": "0", "profit": None, "region": "North", "payment_method": "Card",
                "delivery_days": 3, "return_status": "Not Returned", **given,
            }
            if isinstance(row["order_date"], str):
                row["order_date"] = day(row["order_date"])
            if row["profit"] is None:
                row["profit"] = Decimal(str(row["revenue"])) - Decimal(str(row["cost"]))
            for c in ("revenue", "cost", "discount", "profit"):
                row[c] = Decimal(str(row[c]))
            full.append(tuple(row[c] for c in ORDERS.names))
        return self.spark.createDataFrame(full, ORDERS)

    def products(self, *rows: tuple):
        """(id, name, category) or (id, name, category, cost, price)."""
        full = [(r[0], r[1], r[2], "any", Decimal(str(r[3] if len(r) > 3 else 1)), Decimal(str(r[4] if len(r) > 4 else 2)))
                for r in rows]
        return self.spark.createDataFrame(full, PRODUCTS)

    def customers(self, *rows: tuple):
        """(id, signup date, region)."""
        full = [(r[0], f"name {r[0]}", 30, "City", r[2] if len(r) > 2 else "North",
                 day(r[1] if len(r) > 1 else "2023-01-01"), None) for r in rows]
        return self.spark.createDataFrame(full, CUSTOMERS)

    def raw(self, schema: T.StructType, rows: list[tuple]):
        """Raw rows in file order: `seq` numbers them."""
        typed = T.StructType([*as_raw(schema).fields, T.StructField("seq", T.IntegerType())])
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], typed)


@pytest.fixture(scope="session")
def shop(spark):
    return Shop(spark)


def rows_of(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def value_of(df):
    (row,) = df.collect()
    return row[0]
