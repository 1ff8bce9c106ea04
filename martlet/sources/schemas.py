"""Column types of the star schema, and of the same tables as raw text files."""

from pyspark.sql import types as T

MONEY_FACT = T.DecimalType(12, 2)
MONEY_UNIT = T.DecimalType(10, 2)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("age", T.IntegerType()),
    T.StructField("city", T.StringType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("signup_date", T.DateType(), False),
    T.StructField("customer_segment", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("sub_category", T.StringType(), False),
    T.StructField("cost", MONEY_UNIT, False),
    T.StructField("price", MONEY_UNIT, False),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("order_date", T.DateType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("revenue", MONEY_FACT, False),
    T.StructField("cost", MONEY_FACT, False),
    T.StructField("discount", T.DecimalType(5, 2), False),
    T.StructField("profit", MONEY_FACT, False),
    T.StructField("region", T.StringType(), False),
    T.StructField("payment_method", T.StringType(), False),
    T.StructField("delivery_days", T.IntegerType(), False),
    T.StructField("return_status", T.StringType(), False),
])


def as_raw(schema: T.StructType) -> T.StructType:
    """Same columns, nothing promised: nullable, dates still text."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType)
        for f in schema.fields
    ])


STAR = {"customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS}
RAW = {name: as_raw(schema) for name, schema in STAR.items()}
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id"}
