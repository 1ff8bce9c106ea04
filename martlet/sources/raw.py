"""Raw, dirty versions of the star tables and the question log.

The given tables are clean, so the quality operators read these bindings, which
plant known defects (by key) into every table.  `seq` is the ingest sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .star import Star


def _with_copies(df: DataFrame, copied: Column) -> DataFrame:
    """Every row once (seq 1); the marked rows a second time (seq 2)."""
    copies = F.when(copied, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.withColumn("seq", F.explode(copies))


def raw_customers(star: Star) -> DataFrame:
    return _with_copies(star.customers(), F.col("customer_id") % 40 == 1).selectExpr(
        "customer_id",
        "CASE WHEN customer_id % 7 = 0 THEN concat(' ', name, ' ') ELSE name END AS name",
        "CASE WHEN customer_id % 31 = 5 THEN 200 ELSE age END AS age",
        "CASE WHEN customer_id % 17 = 3 THEN NULL ELSE city END AS city",
        "CASE WHEN customer_id % 29 = 4 THEN 'Atlantis' ELSE region END AS region",
        "CASE WHEN customer_id % 23 = 6 THEN '2099-01-01' WHEN customer_id % 23 = 7 THEN 'not-a-date'"
        " ELSE CAST(signup_date AS STRING) END AS signup_date",
        "customer_segment", "seq",
    )


def raw_products(star: Star) -> DataFrame:
    return _with_copies(star.products(), F.col("product_id") % 50 == 9).selectExpr(
        "product_id", "product_name",
        "CASE WHEN product_id % 9 = 2 THEN concat(category, '  ') ELSE category END AS category",
        "sub_category", "cost",
        "CASE WHEN product_id % 37 = 5 THEN CAST(cost - 1 AS DECIMAL(10,2))"
        " WHEN product_id % 41 = 6 THEN CAST(price * 50 AS DECIMAL(10,2)) ELSE price END AS price",
        "seq",
    )


def raw_orders(star: Star) -> DataFrame:
    return _with_copies(star.sales(), F.col("product_id") % 61 == 2).selectExpr(
        "concat_ws('-', order_id, seq) AS order_id",
        "CASE WHEN product_id % 83 = 6 THEN -1 - customer_id ELSE customer_id END AS customer_id",
        "product_id",
        "CASE WHEN product_id % 89 = 3 THEN 'not-a-date' WHEN product_id % 89 = 5 THEN '2099-01-01'"
        " ELSE CAST(order_date AS STRING) END AS order_date",
        "CASE WHEN product_id % 53 = 1 THEN 0 ELSE quantity END AS quantity", "revenue", "cost",
        "CASE WHEN product_id % 79 = 8 THEN CAST(1.5 AS DECIMAL(5,2)) ELSE discount END AS discount", "profit",
        "CASE WHEN customer_id % 13 = 0 THEN concat('  ', region, ' ') ELSE region END AS region",
        "CASE WHEN product_id % 71 = 9 THEN NULL ELSE payment_method END AS payment_method",
        "CASE WHEN product_id % 59 = 7 THEN -1 ELSE delivery_days END AS delivery_days",
        "CASE WHEN product_id % 97 = 4 THEN 'Lost' ELSE return_status END AS return_status",
        "seq",
    )


def questions(star: Star) -> DataFrame:
    """Every user turn of the conversations, most of them ending in a business question."""
    return star.table("conversations").where("role = 'user'").selectExpr(
        "conv_id", "turn",
        "concat(text, CASE conv_id % 9"
        " WHEN 0 THEN ' What were our best-selling products?' WHEN 1 THEN ' Which region performed worst?'"
        " WHEN 2 THEN ' Which products are losing money?' WHEN 3 THEN ' Which customers are likely to churn?'"
        " WHEN 4 THEN ' Compare this month with last month.' WHEN 5 THEN ' Why did revenue decline?'"
        " WHEN 6 THEN ' What should management do next?'"
        " WHEN 7 THEN ' Worst region and top product?' ELSE '' END) AS question",
    )


def statements(star: Star) -> DataFrame:
    """Every conversation turn as the body of a statement, with reading and destructive beginnings."""
    return star.table("conversations").selectExpr(
        "conv_id", "turn",
        "concat(CASE conv_id % 7 WHEN 0 THEN 'SELECT ' WHEN 1 THEN '  with t as ' WHEN 2 THEN 'SELECT 1; DROP TABLE x;-- '"
        " WHEN 3 THEN 'explain select ' WHEN 4 THEN 'select created_at ' WHEN 5 THEN 'UPDATE t SET ' ELSE '' END, text)"
        " AS statement",
    )
