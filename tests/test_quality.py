from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of, value_of
from martlet.operators import quality as q
from martlet.sources.schemas import CUSTOMERS, ORDERS, PRODUCTS

AS_OF = date(2026, 1, 1)


def flags(spark, kind, values, check):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.hit for r in df.select("i", check(F.col("x")).alias("hit")).orderBy("i").collect()]


def test_range_on_both_sides(spark):
    assert flags(spark, "int", [10, 25, 150, 40], lambda c: q.out_of_range(c, 12, 100)) == [True, False, True, False]


def test_range_on_one_side_and_null(spark):
    assert flags(spark, "int", [1, 2, 3, None, 0], lambda c: q.out_of_range(c, lo=1)) == [False] * 4 + [True]


def test_dates(spark):
    got = flags(spark, "string", ["2024-01-01", "2099-01-01", "not-a-date", "2023-06-15", None, "2000-01-01", "1999-12-31", "2024", "2024-05", "2024-05-06 junk"],
                lambda c: q.invalid_date(c, date(2000, 1, 1), AS_OF))
    assert got == [False, True, True, False, True, False, True, True, True, True]


def test_category(spark):
    got = flags(spark, "string", ["North", "South", "Atlantis", "East", None], lambda c: q.invalid_category(c, q.VALID_REGIONS))
    assert got == [False, False, True, False, True]


def test_price_rule_lets_unknown_pass(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (-1, -2), (None, 1)], "price int, cost int")
    assert [r[0] for r in df.select(q.price_rule(F.col("price"), F.col("cost"))).collect()] == [False, True, True, False]


def test_outlier_is_only_the_far_value(spark):
    df = spark.createDataFrame([(Decimal(v),) for v in (10, 11, 12, 9, 10, 11, 10000)], "price decimal(10,2)")
    assert rows_of(q.outliers_iqr(df, "price", "far").where("far"), "price") == [(Decimal(10000),)]


@pytest.mark.parametrize("total,invalid,expected", [(100, 0, 100.0), (100, 50, 50.0), (0, 0, 0.0), (3, 1, 66.67)])
def test_score(spark, total, invalid, expected):
    df = spark.createDataFrame([(total, invalid)], "t bigint, i bigint")
    assert value_of(df.select(q.score(F.col("t"), F.col("i")))) == expected


def test_trim_takes_any_white_space_and_keeps_null(spark):
    df = spark.createDataFrame([("\t a b \n",), ("x",), (None,), (" ",)], "name string")
    trimmed = q.trim_text(df, ["name", "absent"])
    assert rows_of(trimmed, "name", "dq_trim_name") == [("a b", True), ("x", False), (None, False), ("", True)]


def dirty_customers(shop):
    return shop.raw(CUSTOMERS, [
        (1, " Alice ", 30, "Chennai", "South", "2024-01-01", ""),
        (2, "Bob", 200, "Delhi", "North", "2024-02-01", ""),
        (3, "Carol", 25, "Pune", "Atlantis", "2099-01-01", ""),
        (3, "Carol", 25, "Pune", "Atlantis", "2099-01-01", ""),
    ])


def test_dirty_customers_end_to_end(shop):
    audit = q.audit_customers(dirty_customers(shop), AS_OF)
    (report,) = audit.report().collect()
    assert (report.total_rows, report.valid_rows, report.invalid_rows, report.quality_score_pct) == (4, 1, 3, 25.0)
    assert report.duplicate_records == 1 and report.missing_values == {}
    (kept,) = audit.cleaned().collect()
    assert kept.name == "Alice" and kept.signup_date == date(2024, 1, 1)
    reasons = {(r.customer_id, r.seq): r.reasons for r in audit.rejected().collect()}
    assert reasons == {(2, 1): ["age"], (3, 2): ["date", "region"], (3, 3): ["duplicate_key", "date", "region"]}
    assert {(r.column_name, r.action, r.rows_affected) for r in audit.log().collect()} == {
        ("name", q.TRIM, 1), ("customer_id", q.DUPLICATE_KEY, 1), ("age", q.AGE, 1), ("signup_date", q.DATE, 2),
        ("region", q.CATEGORY, 2)}


def line(order_id, customer=1, product=1, day="2024-05-01", quantity=1, discount="0", status="Returned", revenue="10",
         region="North"):
    return (order_id, customer, product, day, quantity, Decimal(revenue), Decimal(5), Decimal(discount), Decimal(5), region,
            "Card", 2, status)


def test_order_of_a_rejected_customer_is_rejected(shop):
    products = shop.raw(PRODUCTS, [(1, "p", "c", "s", Decimal(1), Decimal(2)), (2, "p", "c", "s", Decimal(3), Decimal(2))])
    orders = shop.raw(ORDERS, [
        line("a"), line("b"),                       # b repeats a in all but its id
        line("c", customer=2), line("d", product=2), line("e", customer=2, product=2),
        line("f", day="never"), line("g", quantity=0), line("h", discount="1.01"), line("i", status="Lost"),
        line("j", region="Nowhere"),                # the region of an order is not judged
        line("k", customer=None), line("l", status=None),
    ])
    star = q.audit_star(dirty_customers(shop), products, orders, AS_OF)
    assert sorted(r.order_id for r in star.orders.cleaned().collect()) == ["a", "j"]
    reasons = {r.order_id: r.reasons for r in star.orders.rejected().collect()}
    assert reasons["b"] == ["full_duplicate"] and reasons["e"] == ["orphan_customer", "orphan_product"]
    assert reasons["k"] == ["orphan_customer"] and reasons["l"] == ["status"]
    logged = {r.action: r.rows_affected for r in star.orders.log().collect()}
    assert logged[q.REFERENCE] == 5  # c, d, k once; e for both keys
    assert logged[q.MISSING] == 2


def test_quality_report_means_the_three_scores(shop):
    products = shop.raw(PRODUCTS, [(1, "p", "c", "s", Decimal(1), Decimal(2)), (2, "p", "c", "s", Decimal(3), Decimal(2))])
    star = q.audit_star(dirty_customers(shop), products, shop.raw(ORDERS, [line("a")]), AS_OF)
    report = {r.table_name: r for r in q.quality_report(star).collect()}
    assert [report[t].quality_score_pct for t in ("customers", "products", "orders")] == [25.0, 50.0, 100.0]
    assert {r.overall_quality_score_pct for r in report.values()} == {58.33}


def test_empty_tables(shop):
    star = q.audit_star(shop.raw(CUSTOMERS, []), shop.raw(PRODUCTS, []), shop.raw(ORDERS, []), AS_OF)
    assert {(r.total_rows, r.quality_score_pct) for r in q.quality_report(star).collect()} == {(0, 0.0)}
    assert q.transformation_log(star).count() == 0
    assert star.orders.rejected().count() == 0


def test_load_checks(shop):
    sales = shop.sales({"customer_id": 1}, {"customer_id": 9}, {"customer_id": 9, "product_id": 8})
    customers, products = shop.customers((1,)), shop.products((1, "p", "c"))
    assert dict(rows_of(q.orphan_orders(sales, customers, products))) == {"customer_id": 2, "product_id": 1}
    check = q.load_reconcile({"orders": sales, "customers": customers}, {"orders": sales.limit(2), "customers": customers})
    assert {r.table_name: (r.expected, r.actual, r.status) for r in check.collect()} == {
        "orders": (3, 2, "MISMATCH"), "customers": (1, 1, "OK")}
    broken = {(r.table_name, r.constraint_name): r.violations for r in q.constraint_violations(
        shop.raw(CUSTOMERS, [(1, "a", 5, None, "North", "2024-01-01", None)] * 2), products, sales).collect()}
    assert broken["customers", "primary_key"] == 1 and broken["customers", "age_range"] == 2
    assert broken["customers", "city_not_null"] == 2 and broken["orders", "customer_id_reference"] == 2


def test_stripping_is_that_of_the_pattern(spark):
    """Texts that begin and end with a visible ASCII character do not go through the pattern."""
    texts = ["", " ", "a", " a", "a ", "a b", "\ta\n", "a\n", "a\u2028", "\u00a0a\u00a0", "é", " é ", "a\u3000", "\x85a", "a\x7f", "\x7fa ", "a\n\n", "~", "!x", "a\r\n", "\x00 a"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    wanted = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~q.stripped(F.col("t")).eqNullSafe(wanted)).collect() == []
    assert "ascii" in df.select(q.stripped(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
