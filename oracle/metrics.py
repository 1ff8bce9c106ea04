"""Sales, customer, product, operations metrics and summary bundles."""

from .common import big, cs, mean2, money, pct, star

REV, PRO = cs("revenue"), cs("profit")
RETURNED = "COUNT(*) FILTER (WHERE return_status = 'Returned')"
CANCELLED = "COUNT(*) FILTER (WHERE return_status = 'Cancelled')"
NAMED = "sales s JOIN products p ON s.product_id = p.product_id"
RANGE = "order_date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'"
S_REV, S_PRO = cs("s.revenue"), cs("s.profit")
S_RETURNED = "COUNT(*) FILTER (WHERE s.return_status = 'Returned')"

BRACKET = """CASE WHEN discount = 0 THEN 'No discount' WHEN discount <= 0.10 THEN '1-10%'
                  WHEN discount <= 0.20 THEN '11-20%' ELSE '21%+' END"""

PRODUCT_TOTALS = f"""
  SELECT p.product_name, p.category, {S_REV} AS revenue_c, {S_PRO} AS profit_c, COUNT(*) AS orders,
         {S_RETURNED} AS returned
  FROM {NAMED} GROUP BY p.product_name, p.category
"""


def _top(order: str, n: int = 10) -> str:
    return star(f"""
SELECT product_name, category, {money('revenue_c')} AS revenue, {money('profit_c')} AS profit, {big('orders')} AS orders
FROM ({PRODUCT_TOTALS}) t ORDER BY {order}, product_name, category LIMIT {n}""")


def _trend(unit: str) -> str:
    return star(f"""
SELECT CAST(date_trunc('{unit}', order_date) AS DATE) AS {unit}, {money(REV)} AS revenue, {money(PRO)} AS profit,
       {big('COUNT(*)')} AS orders
FROM sales GROUP BY 1""")


GROWTH = f"""
  SELECT month, revenue_c, lag(revenue_c) OVER (ORDER BY month) AS before_c
  FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, {REV} AS revenue_c FROM sales GROUP BY 1) m
"""

LAST = "SELECT customer_id, MAX(order_date) AS last_order, COUNT(*) AS orders FROM sales GROUP BY customer_id"
CLV = f"""
  SELECT c.customer_id, c.name, c.region, COALESCE({cs('s.revenue')}, 0) AS revenue_c,
         COALESCE({cs('s.profit')}, 0) AS profit_c, COUNT(s.order_id) AS orders
  FROM customers c LEFT JOIN sales s ON c.customer_id = s.customer_id GROUP BY c.customer_id, c.name, c.region
"""
CLV_OUT = f"""customer_id, name, region, {money('revenue_c')} AS lifetime_revenue, {money('profit_c')} AS lifetime_profit,
       {big('orders')} AS total_orders"""
N_CUSTOMERS = "(SELECT COUNT(*) FROM customers)"
BACK = "(SELECT COUNT(*) FROM last_orders WHERE orders > 1)"
ORDERING = "(SELECT COUNT(*) FROM last_orders)"
GONE = "(SELECT COUNT(*) FROM last_orders WHERE last_order < (SELECT MAX(order_date) FROM sales) - 90)"
LAST_CTE = f"last_orders AS ({LAST})"

SQL = {
    "date_range_filter": star(f"""
SELECT order_id, order_date, CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit
FROM sales WHERE {RANGE}"""),
    "total_revenue": star(f"SELECT COALESCE({money(REV)}, 0) AS total_revenue FROM sales"),
    "total_profit": star(f"SELECT COALESCE({money(PRO)}, 0) AS total_profit FROM sales"),
    "total_revenue_in_range": star(f"SELECT COALESCE({money(REV)}, 0) AS total_revenue FROM sales WHERE {RANGE}"),
    "total_profit_in_range": star(f"SELECT COALESCE({money(PRO)}, 0) AS total_profit FROM sales WHERE {RANGE}"),
    "profit_margin": star(f"SELECT COALESCE({pct(PRO, REV)}, 0) AS profit_margin FROM sales"),
    "profit_margin_in_range": star(f"SELECT COALESCE({pct(PRO, REV)}, 0) AS profit_margin FROM sales WHERE {RANGE}"),
    "average_order_value": star(f"SELECT COALESCE({mean2(REV, 'COUNT(*)')}, 0) AS average_order_value FROM sales"),
    "average_order_value_in_range": star(
        f"SELECT COALESCE({mean2(REV, 'COUNT(*)')}, 0) AS average_order_value FROM sales WHERE {RANGE}"),
    "monthly_revenue": _trend("month"),
    "quarterly_revenue": _trend("quarter"),
    "revenue_growth_mom": star(f"""
SELECT month, {money('revenue_c')} AS revenue, {pct('revenue_c - before_c', 'before_c')} AS revenue_growth_pct
FROM ({GROWTH}) g"""),
    "recent_growth": star(f"""
SELECT month, {money('revenue_c')} AS revenue, {pct('revenue_c - before_c', 'before_c')} AS revenue_growth_pct
FROM ({GROWTH}) g ORDER BY month DESC LIMIT 12"""),
    "revenue_by_region": star(f"""
SELECT region, {money(REV)} AS revenue, {money(PRO)} AS profit, {big('COUNT(*)')} AS orders FROM sales GROUP BY region"""),
    "revenue_by_product": _top("revenue_c DESC"),
    "discount_analysis": star(f"""
SELECT {BRACKET} AS discount_bracket, {big('COUNT(*)')} AS orders, {money(REV)} AS revenue,
       {mean2(PRO, 'COUNT(*)')} AS avg_profit_per_order
FROM sales GROUP BY 1"""),
    "discount_bracket": star(f"""
SELECT order_id, CAST(discount AS DOUBLE) AS discount, {BRACKET} AS discount_bracket FROM sales"""),
    "order_count": star(f"SELECT {big('COUNT(*)')} AS order_count FROM sales"),
    "sales_summary": star(f"""
SELECT {money(REV)} AS total_revenue, {money(PRO)} AS total_profit, {pct(PRO, REV)} AS profit_margin_pct,
       {mean2(REV, 'COUNT(*)')} AS average_order_value FROM sales"""),

    "total_customers": star(f"SELECT {big('COUNT(*)')} AS total_customers FROM customers"),
    "new_customers_by_month": star(f"""
SELECT CAST(date_trunc('month', signup_date) AS DATE) AS month, {big('COUNT(*)')} AS new_customers
FROM customers GROUP BY 1"""),
    "returning_customers": star(f"SELECT {big(BACK)} AS returning_customers", LAST_CTE),
    "retention_rate": star(f"SELECT {pct(BACK, ORDERING)} AS retention_rate", LAST_CTE),
    "churn_rate": star(f"SELECT {pct(GONE, ORDERING)} AS churn_rate", LAST_CTE),
    "customer_lifetime_value": star(f"SELECT {CLV_OUT} FROM ({CLV}) t"),
    "top_customers": star(f"SELECT {CLV_OUT} FROM ({CLV}) t ORDER BY revenue_c DESC, customer_id LIMIT 15"),
    "average_purchase_frequency": star(
        f"SELECT {mean2('(SELECT COUNT(*) FROM sales)', ORDERING, 100)} AS average_purchase_frequency", LAST_CTE),
    "customers_summary": star(f"""
SELECT {big(N_CUSTOMERS)} AS total_customers, {pct(BACK, ORDERING)} AS retention_rate_pct,
       {pct(GONE, ORDERING)} AS churn_rate_90d_pct,
       {mean2('(SELECT COUNT(*) FROM sales)', ORDERING, 100)} AS avg_purchase_frequency""", LAST_CTE),

    "top_products": _top("revenue_c DESC"),
    "top_products_by_profit": _top("profit_c DESC"),
    "top_products_by_orders": _top("orders DESC"),
    "bottom_products": _top("revenue_c"),
    "most_profitable_products": star(f"""
SELECT product_name, category, {money('profit_c')} AS total_profit, {pct('profit_c', 'revenue_c')} AS margin_pct
FROM ({PRODUCT_TOTALS}) t ORDER BY profit_c DESC, product_name, category LIMIT 10"""),
    "low_margin_products": star(f"""
SELECT product_name, category, {money('revenue_c')} AS revenue, {pct('profit_c', 'revenue_c')} AS margin_pct,
       {big('orders')} AS orders
FROM ({PRODUCT_TOTALS}) t WHERE orders >= 5 ORDER BY margin_pct NULLS LAST, product_name, category LIMIT 10"""),
    "return_rate_by_product": star(f"""
SELECT product_name, category, {big('orders')} AS total_orders, {big('returned')} AS returned_orders,
       {pct('returned', 'orders')} AS return_rate_pct
FROM ({PRODUCT_TOTALS}) t WHERE orders >= 5 ORDER BY return_rate_pct DESC, product_name, category LIMIT 10"""),
    "category_performance": star(f"""
SELECT p.category, {money(S_REV)} AS revenue, {money(S_PRO)} AS profit, {big('COUNT(*)')} AS orders,
       {pct(S_RETURNED, 'COUNT(*)')} AS return_rate_pct
FROM {NAMED} GROUP BY p.category"""),

    "average_delivery_time": star(
        f"SELECT {mean2('SUM(delivery_days)', 'COUNT(*)', 100)} AS average_delivery_time FROM sales"),
    "cancellation_rate": star(f"SELECT {pct(CANCELLED, 'COUNT(*)')} AS cancellation_rate FROM sales"),
    "return_rate": star(f"SELECT {pct(RETURNED, 'COUNT(*)')} AS return_rate FROM sales"),
    "regional_operational_performance": star(f"""
SELECT region, {mean2('SUM(delivery_days)', 'COUNT(*)', 100)} AS avg_delivery_days,
       {pct(RETURNED, 'COUNT(*)')} AS return_rate_pct, {pct(CANCELLED, 'COUNT(*)')} AS cancellation_rate_pct,
       {big('COUNT(*)')} AS total_orders
FROM sales GROUP BY region"""),
    "delivery_time_by_category": star(f"""
SELECT p.category, {mean2('SUM(s.delivery_days)', 'COUNT(*)', 100)} AS avg_delivery_days, {big('COUNT(*)')} AS orders
FROM {NAMED} GROUP BY p.category"""),
    "operations_summary": star(f"""
SELECT {mean2('SUM(delivery_days)', 'COUNT(*)', 100)} AS avg_delivery_days, {pct(RETURNED, 'COUNT(*)')} AS return_rate_pct,
       {pct(CANCELLED, 'COUNT(*)')} AS cancellation_rate_pct FROM sales"""),

    "home_summary": star(f"""
SELECT {money(REV)} AS total_revenue, {big(N_CUSTOMERS)} AS total_customers, {mean2(REV, 'COUNT(*)')} AS average_order_value,
       {pct(PRO, REV)} AS profit_margin_pct FROM sales"""),
    "executive_summary": star(f"""
SELECT {money(REV)} AS total_revenue, {money(PRO)} AS total_profit, {big('COUNT(*)')} AS total_orders,
       {big(N_CUSTOMERS)} AS total_customers, {pct(BACK, ORDERING)} AS retention_rate_pct,
       {pct(GONE, ORDERING)} AS churn_rate_90d_pct, {mean2(REV, 'COUNT(*)')} AS average_order_value
FROM sales""", LAST_CTE),
}
