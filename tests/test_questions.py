import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from martlet.operators import questions as qu

SAFE = ["SELECT * FROM orders", "select region from orders", "  SELECT 1", "WITH t AS (SELECT 1) SELECT * FROM t", "\n\tselect 1"]
UNSAFE = ["DROP TABLE orders", "DELETE FROM orders", "UPDATE orders SET revenue = 0", "INSERT INTO orders VALUES (1)",
          "ALTER TABLE orders ADD x INT", "TRUNCATE orders", "CREATE TABLE x (y INT)", "GRANT ALL ON orders TO me",
          "SELECT * FROM orders; DROP TABLE orders;--", "EXPLAIN SELECT 1", "SELECT created_at FROM orders", "", "SELECT 1 -- x"]


@pytest.mark.parametrize("statement,safe", [(s, True) for s in SAFE] + [(s, False) for s in UNSAFE])
def test_gate(spark, statement, safe):
    assert spark.createDataFrame([(statement,)], "s string").select(qu.sql_is_safe(F.col("s"))).first()[0] is safe


def test_null_statement_is_refused(spark):
    assert spark.createDataFrame([(None,)], "s string").select(qu.sql_is_safe(F.col("s"))).first()[0] is False


def test_guarded_query(spark, shop):
    sales = shop.sales({"revenue": 5}, {"revenue": 6})
    assert qu.guarded_query(spark, "SELECT SUM(revenue) AS r FROM {sales}", sales=sales).first().r == 11
    for statement in UNSAFE:
        with pytest.raises(ValueError):
            qu.guarded_query(spark, statement, sales=sales)


@pytest.mark.parametrize("statement", [
    "SELECT reflect('java.lang.Math', 'abs', -3)", "SELECT java_method('java.lang.Math', 'abs', -3) FROM {sales}",
    "SELECT TRANSFORM (revenue) USING 'cat' AS (r STRING) FROM {sales}", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM orders",
    "SELECT * FROM {sales} WHERE revenue IN (SELECT revenue FROM other)", "WITH t AS (SELECT * FROM hidden) SELECT * FROM t, {sales}",
    "SELECT * FROM range(10)"])
def test_guarded_query_reads_the_named_tables_only(spark, shop, statement):
    with pytest.raises(ValueError):
        qu.guarded_query(spark, statement, sales=shop.sales({"revenue": 5}))


def test_guarded_query_takes_subqueries_and_named_parts(spark, shop):
    sales = shop.sales({"revenue": 5, "region": "North"}, {"revenue": 7, "region": "South"})
    statement = ("WITH best AS (SELECT region, SUM(revenue) AS r FROM {sales} GROUP BY region) "
                 "SELECT region FROM best WHERE r = (SELECT MAX(r) FROM best) AND r > (SELECT MIN(revenue) FROM {sales})")
    assert [r.region for r in qu.guarded_query(spark, statement, sales=sales).collect()] == ["South"]


@pytest.mark.parametrize("statement", [
    "SELECT SUM(revenue) FROM {sales}; SELECT 1", "SELECT no_such(revenue) FROM {sales}", "SELECT uuid() FROM {sales}", "SELECT system.builtin.sum(revenue) FROM {sales}",
    "SELECT * FROM {sales} LATERAL VIEW explode(sequence(1, 9)) t AS n", "SELECT * FROM VALUES (1), (2)", "SELECT /*+ BROADCAST(s) */ * FROM {sales} AS s",
    "SELECT * FROM parquet.`/tmp`", "SELECT * FROM {sales} WHERE EXISTS (SELECT input_file_name() FROM {sales})", "SELECT (revenue FROM {sales}", "SELECT tame(revenue) FROM {sales}",
    "WITH a AS (SELECT version() AS v FROM {sales}) SELECT * FROM a", "SELECT CASE WHEN revenue > 1 THEN spark_partition_id() END FROM {sales}",
    "SELECT SUM(revenue) OVER (ORDER BY rand()) FROM {sales}", "SELECT transform(array(1), x -> x) FROM {sales}"])
def test_guarded_query_refuses_what_is_not_listed(spark, shop, statement):
    spark.udf.register("tame", lambda v: 1, "int")
    with pytest.raises(ValueError):
        qu.guarded_query(spark, statement, sales=shop.sales({"revenue": 5}))


@pytest.mark.parametrize("statement", [
    "SELECT region, SUM(revenue) AS r, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS c FROM {sales} WHERE order_date BETWEEN DATE '2024-01-01' AND current_date() "
    "AND region LIKE 'N%' GROUP BY region HAVING SUM(revenue) > 1 ORDER BY r DESC, region LIMIT 5",
    "WITH a AS (SELECT region, year(order_date) AS y, -revenue / 2 AS half FROM {sales}), b AS (SELECT * FROM a) SELECT a.region, CASE WHEN a.half < 0 THEN 'x' ELSE NULL END AS k, "
    "CAST(a.half AS int) AS i, rank() OVER (PARTITION BY a.region ORDER BY a.half DESC) AS p FROM a LEFT JOIN b ON a.region = b.region AND b.y <> 3 WHERE a.region IN ('North', 'x') OR a.half IS NULL",
    "SELECT DISTINCT region FROM {sales} UNION ALL SELECT region FROM {sales} s WHERE EXISTS (SELECT 1 FROM {sales} o WHERE o.region = s.region) AND NOT region IN (SELECT region FROM {sales} WHERE revenue < 0)",
    "SELECT SUM(revenue) OVER (ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, extract(MONTH FROM order_date) AS m, round(revenue * 1.5, 1) AS x, "
    "concat(region, '-', upper(payment_method)) || 'z' AS t FROM (SELECT * FROM {sales}) AS q",
    "SELECT coalesce(nullif(region, ''), 'none') AS r, revenue % 2 AS odd, substring(region, 1, 2) AS s, trim(region) AS u FROM {sales} ORDER BY 1"])
def test_guarded_query_runs_plain_questions(spark, shop, statement):
    assert qu.guarded_query(spark, statement, sales=shop.sales({"revenue": 5, "region": "North"})).count() > 0


def test_losing_products_are_counted_before_the_list_is_cut(shop):
    sales = shop.sales(*[{"product_id": i, "revenue": 10, "cost": 20 + i} for i in range(12)])
    goods = shop.products(*[(i, f"p{i}", "c") for i in range(12)])
    members = shop.customers((1,)).withColumn("customer_segment", F.lit("Loyal"))
    answer = qu.answers(sales, goods, members).where("intent = 'losing_products'").first()
    assert answer.answer.startswith("12 products") and len(answer.evidence) == qu.LOSING_PRODUCTS


ASKED = {
    "What were our best-selling products?": "best_sellers", "Which region performed worst?": "worst_region",
    "Which products are losing money?": "losing_products", "Which customers are likely to churn?": "churn_risk",
    "Compare this month with last month.": "month_over_month", "Why did revenue decline?": "root_cause",
    "What should management do next?": "recommendations", "WORST REGION and TOP PRODUCT?": "best_sellers",
    "What do you recommend?": "recommendations", "Why?": "unknown", "": "unknown",
}


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "id int, question string")


def test_routing(asked):
    assert dict(rows_of(qu.classify_questions(asked), "question", "intent")) == ASKED


def test_answers(asked, shop):
    sales = shop.sales({"order_date": "2024-01-05", "revenue": 100, "cost": 101, "product_id": 1},
                       {"order_date": "2024-02-05", "revenue": 125, "cost": 100, "product_id": 2, "region": "South"})
    goods = shop.products((1, "pen", "Office"), (2, "cup", "Home"))
    people = shop.customers((1,), (2,)).withColumn("customer_segment", F.lit("At Risk"))
    got = {r.question: r for r in qu.answer_questions(asked, sales, goods, people).collect()}
    assert len(got) == len(ASKED) and all(r.answer for r in got.values())
    best = got["What were our best-selling products?"]
    assert "cup" in best.answer and best.evidence == ["cup (Home): Rs.125 in 1 orders", "pen (Office): Rs.100 in 1 orders"]
    assert "North" in got["Which region performed worst?"].answer
    assert "pen" in got["Which products are losing money?"].answer
    assert got["Which customers are likely to churn?"].evidence == ["At Risk: 2 customers"]
    assert "grew by 25.0%" in got["Compare this month with last month."].answer
    assert got["Why?"].evidence == []


def test_answers_without_data(asked, shop):
    got = qu.answer_questions(asked, shop.sales(), shop.products(), shop.customers())
    assert {r.intent: r.answer for r in got.collect()}["month_over_month"] == "A comparison needs orders in two months."


@pytest.mark.parametrize("revenue,cost,listed", [(100, 95, False), (100, "95.01", True), (0, 0, False), (0, 1, True)])
def test_thin_margin(shop, revenue, cost, listed):
    goods = shop.products((1, "pen", "Office"))
    assert (qu.answer_losing_products(shop.sales({"revenue": revenue, "cost": cost}), goods).count() == 1) == listed
