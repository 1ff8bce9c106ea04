"""Views over the given tables, and SQL fragments for exact arithmetic."""

STAR = """
customers AS (
  SELECT c_custkey AS customer_id, c_name AS name, CAST(18 + c_custkey % 47 AS INT) AS age,
         n_name AS city, r_name AS region,
         DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INT) AS signup_date,
         CAST(NULL AS VARCHAR) AS customer_segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category,
         CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(1.6 AS DECIMAL(2,1)), 2) AS DECIMAL(10,2)) AS cost,
         CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(2.2 AS DECIMAL(2,1)), 2) AS DECIMAL(10,2)) AS price
  FROM part),
sales AS (
  SELECT order_id, customer_id, product_id, order_date, quantity, revenue, cost, discount,
         CAST(revenue - cost AS DECIMAL(12,2)) AS profit, region, payment_method, delivery_days, return_status
  FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS order_id,
           o_custkey AS customer_id, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS order_date,
           CAST(l_quantity AS INT) AS quantity,
           CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - 3 * CAST(l_discount AS DECIMAL(5,2))), 2)
                AS DECIMAL(12,2)) AS revenue,
           CAST(CAST(l_quantity AS INT) * p.cost AS DECIMAL(12,2)) AS cost,
           CAST(3 * CAST(l_discount AS DECIMAL(5,2)) AS DECIMAL(5,2)) AS discount,
           r_name AS region, o_orderpriority AS payment_method,
           CAST(CASE WHEN r_regionkey IN (1, 3) THEN 1 + (l_orderkey + l_linenumber + l_suppkey) % 3
                     ELSE 2 + (l_orderkey + l_linenumber + l_suppkey) % 6 END AS INT) AS delivery_days,
           CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Cancelled' ELSE 'Not Returned' END AS return_status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
         JOIN products p ON l_partkey = p.product_id) t)
"""

RAW = """
raw_customers AS (
  SELECT customer_id, CASE WHEN customer_id % 7 = 0 THEN concat(' ', name, ' ') ELSE name END AS name,
         CASE WHEN customer_id % 31 = 5 THEN 200 ELSE age END AS age,
         CASE WHEN customer_id % 17 = 3 THEN NULL ELSE city END AS city,
         CASE WHEN customer_id % 29 = 4 THEN 'Atlantis' ELSE region END AS region,
         CASE WHEN customer_id % 23 = 6 THEN '2099-01-01' WHEN customer_id % 23 = 7 THEN 'not-a-date'
              ELSE CAST(signup_date AS VARCHAR) END AS signup_date,
         customer_segment, k AS seq
  FROM customers CROSS JOIN (VALUES (1), (2)) AS d(k) WHERE k = 1 OR customer_id % 40 = 1),
raw_products AS (
  SELECT product_id, product_name, CASE WHEN product_id % 9 = 2 THEN concat(category, '  ') ELSE category END AS category,
         sub_category, cost,
         CASE WHEN product_id % 37 = 5 THEN CAST(cost - 1 AS DECIMAL(10,2))
              WHEN product_id % 41 = 6 THEN CAST(price * 50 AS DECIMAL(10,2)) ELSE price END AS price, k AS seq
  FROM products CROSS JOIN (VALUES (1), (2)) AS d(k) WHERE k = 1 OR product_id % 50 = 9),
raw_orders AS (
  SELECT concat_ws('-', order_id, k) AS order_id,
         CASE WHEN product_id % 83 = 6 THEN -1 - customer_id ELSE customer_id END AS customer_id,
         product_id, CASE WHEN product_id % 89 = 3 THEN 'not-a-date' WHEN product_id % 89 = 5 THEN '2099-01-01'
              ELSE CAST(order_date AS VARCHAR) END AS order_date,
         CASE WHEN product_id % 53 = 1 THEN 0 ELSE quantity END AS quantity, revenue, cost,
         CASE WHEN product_id % 79 = 8 THEN CAST(1.5 AS DECIMAL(5,2)) ELSE discount END AS discount, profit,
         CASE WHEN customer_id % 13 = 0 THEN concat('  ', region, ' ') ELSE region END AS region,
         CASE WHEN product_id % 71 = 9 THEN NULL ELSE payment_method END AS payment_method,
         CASE WHEN product_id % 59 = 7 THEN -1 ELSE delivery_days END AS delivery_days,
         CASE WHEN product_id % 97 = 4 THEN 'Lost' ELSE return_status END AS return_status, k AS seq
  FROM sales CROSS JOIN (VALUES (1), (2)) AS d(k) WHERE k = 1 OR product_id % 61 = 2)
"""

QUESTIONS = """
questions AS (
  SELECT conv_id, turn, concat(text, CASE conv_id % 9
           WHEN 0 THEN ' What were our best-selling products?' WHEN 1 THEN ' Which region performed worst?'
           WHEN 2 THEN ' Which products are losing money?' WHEN 3 THEN ' Which customers are likely to churn?'
           WHEN 4 THEN ' Compare this month with last month.' WHEN 5 THEN ' Why did revenue decline?'
           WHEN 6 THEN ' What should management do next?'
           WHEN 7 THEN ' Worst region and top product?' ELSE '' END) AS question
  FROM conversations WHERE role = 'user')
"""


def star(body: str, *more: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in (STAR, *more)) + "\n" + body.strip()


def cs(column: str, where: str = "") -> str:
    """Sum of an amount in whole cents."""
    return f"SUM(CAST({column} * 100 AS BIGINT))" + (f" FILTER (WHERE {where})" if where else "")


def money(units: str) -> str:
    return f"(CAST({units} AS DOUBLE) / 100)"


def half_up(num: str, den: str, times: int = 1) -> str:
    return (f"((CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END) * "
            f"((2 * {times} * CAST(abs({num}) AS HUGEINT) + abs({den})) // NULLIF(2 * CAST(abs({den}) AS HUGEINT), 0)))")


def pct(num: str, den: str) -> str:
    return f"(CAST({half_up(num, den, 10000)} AS DOUBLE) / 100)"


def mean2(units: str, n: str, times: int = 1) -> str:
    """Mean with two decimals: units are cents (times 1) or whole numbers (times 100)."""
    return f"(CAST({half_up(units, n, times)} AS DOUBLE) / 100)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"

STATEMENTS = """
statements AS (
  SELECT conv_id, turn, concat(CASE conv_id % 7 WHEN 0 THEN 'SELECT ' WHEN 1 THEN '  with t as '
           WHEN 2 THEN 'SELECT 1; DROP TABLE x;-- ' WHEN 3 THEN 'explain select ' WHEN 4 THEN 'select created_at '
           WHEN 5 THEN 'UPDATE t SET ' ELSE '' END, text) AS statement
  FROM conversations)
"""

# Segments: quintiles by position in the sorted column, edges times 5.
_EDGES = ",\n".join(
    f"""{name}_sorted AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS i, COUNT(*) OVER () AS n FROM rfm),
{name}_edges AS (SELECT k, 5 * (SELECT v FROM {name}_sorted WHERE i = (k*(n1-1)) // 5)
     + ((k*(n1-1)) % 5) * ((SELECT v FROM {name}_sorted WHERE i = LEAST((k*(n1-1)) // 5 + 1, n1-1))
                           - (SELECT v FROM {name}_sorted WHERE i = (k*(n1-1)) // 5)) AS edge
   FROM (VALUES (1), (2), (3), (4)) AS q(k), (SELECT COUNT(*) AS n1 FROM rfm) c)"""
    for name, value in (("r", "recency_days"), ("m", "monetary_c")))

RFM = f"""
rfm AS (
  SELECT s.customer_id, (SELECT MAX(order_date) FROM sales) - MAX(s.order_date) AS recency_days, COUNT(*) AS frequency,
         SUM(CAST(s.revenue * 100 AS BIGINT)) AS monetary_c
  FROM sales s JOIN customers c ON c.customer_id = s.customer_id GROUP BY s.customer_id),
{_EDGES},
scores AS (
  SELECT b.*, 5 - (SELECT COUNT(*) FROM r_edges WHERE edge < 5 * b.recency_days) AS r_score,
         GREATEST(1, COALESCE((5 * (rk - 1) + n - 2) // NULLIF(n - 1, 0), 1)) AS f_score,
         1 + (SELECT COUNT(*) FROM m_edges WHERE edge < 5 * b.monetary_c) AS m_score
  FROM (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS rk, COUNT(*) OVER () AS n FROM rfm) b),
segments AS (
  SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'High Value'
                 WHEN f_score >= 4 AND r_score >= 3 THEN 'Loyal'
                 WHEN r_score >= 4 AND f_score <= 2 THEN 'New'
                 WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' ELSE 'Dormant' END AS segment
  FROM scores)
"""
