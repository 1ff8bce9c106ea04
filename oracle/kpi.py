"""KPI measures by group: ratios are fractions, 0 on a zero divisor."""

from .common import big, cs, money, star

DIMS = "s.region, CAST(date_trunc('month', s.order_date) AS DATE) AS month"
REV, PRO = cs("s.revenue"), cs("s.profit")


def by_group(name: str, expression: str) -> str:
    return star(f"SELECT {DIMS}, {expression} AS {name} FROM sales s GROUP BY 1, 2")


def ratio(num: str, den: str) -> str:
    return f"COALESCE(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 0)"


N = "COUNT(*)"
BUYERS = "COUNT(DISTINCT s.customer_id)"
CELLS = """cells AS (SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, customer_id, COUNT(*) AS n,
                            MAX(order_date) AS last_order
                     FROM sales GROUP BY 1, 2, 3)"""
BACK = "COUNT(*) FILTER (WHERE n > 1)"

def prior(measure: str) -> str:
    return star(f"""
SELECT month, {money(measure)} AS total_{measure}, {money(f'{measure}_prior')} AS {measure}_prior_month,
       {ratio(money(f'(COALESCE({measure}, 0) - {measure}_prior)'), money(f'{measure}_prior'))} AS {measure}_mom_growth
FROM shifted""", DAYS, SHIFTED)


# Every calendar day takes the amounts of the same date one month earlier; a calendar month that is there in full takes the whole month.
SHIFTED = """
per_day AS (SELECT order_date, SUM(CAST(revenue * 100 AS BIGINT)) AS revenue, SUM(CAST(profit * 100 AS BIGINT)) AS profit FROM sales GROUP BY 1),
months AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, MAX(date) = last_day(MAX(date)) AS complete, MAX(day(date)) AS last_dom FROM days GROUP BY 1),
totals AS (SELECT m.month, SUM(p.revenue) AS revenue, SUM(p.profit) AS profit
           FROM months m LEFT JOIN per_day p ON date_trunc('month', p.order_date) = m.month GROUP BY 1),
priors AS (SELECT m.month, SUM(p.revenue) AS revenue_prior, SUM(p.profit) AS profit_prior
           FROM months m LEFT JOIN per_day p ON date_trunc('month', p.order_date) = m.month - INTERVAL 1 MONTH AND (complete OR day(p.order_date) <= last_dom)
           GROUP BY 1),
shifted AS (SELECT * FROM totals JOIN priors USING (month))"""
DAYS = "days AS (SELECT CAST(unnest(generate_series(MIN(order_date), MAX(order_date), INTERVAL 1 DAY)) AS DATE) AS date FROM sales)"
RANKED = """
  SELECT product_name, revenue_c, rank() OVER (ORDER BY revenue_c DESC) AS r
  FROM (SELECT p.product_name, COALESCE(SUM(CAST(s.revenue * 100 AS BIGINT)), 0) AS revenue_c
        FROM products p LEFT JOIN sales s ON s.product_id = p.product_id GROUP BY p.product_name) t
"""

SQL = {
    "kpi_total_revenue": by_group("total_revenue", money(REV)),
    "kpi_total_profit": by_group("total_profit", money(PRO)),
    "kpi_total_orders": by_group("total_orders", big(N)),
    "kpi_total_customers": by_group("total_customers", big(BUYERS)),
    "kpi_avg_order_value": by_group("avg_order_value", ratio(money(REV), N)),
    "kpi_profit_margin": by_group("profit_margin", ratio(money(PRO), money(REV))),
    "kpi_return_rate": by_group("return_rate", ratio("COUNT(*) FILTER (WHERE s.return_status = 'Returned')", N)),
    "kpi_cancellation_rate": by_group("cancellation_rate", ratio("COUNT(*) FILTER (WHERE s.return_status = 'Cancelled')", N)),
    "kpi_clv": by_group("clv", ratio(money(REV), BUYERS)),
    "kpi_avg_delivery_days": by_group("avg_delivery_days", ratio("SUM(s.delivery_days)", N)),
    "kpi_returning_customers": star(f"SELECT region, month, {big(BACK)} AS returning_customers FROM cells GROUP BY 1, 2", CELLS),
    "kpi_retention_rate": star(f"SELECT region, month, {ratio(BACK, N)} AS retention_rate FROM cells GROUP BY 1, 2", CELLS),
    "kpi_churn_rate_90": star(f"""
SELECT region, {ratio("COUNT(*) FILTER (WHERE last_order < latest - 90)", N)} AS churn_rate_90 FROM (
  SELECT region, customer_id, MAX(order_date) AS last_order, MAX(MAX(order_date)) OVER (PARTITION BY region) AS latest
  FROM sales GROUP BY region, customer_id) t GROUP BY region"""),
    "kpi_all_by_category": star(f"""
SELECT p.category, {money(REV)} AS total_revenue, {money(PRO)} AS total_profit, {big(N)} AS total_orders,
       {big(BUYERS)} AS total_customers, {ratio(money(REV), N)} AS avg_order_value, {ratio(money(PRO), money(REV))} AS profit_margin,
       {ratio("COUNT(*) FILTER (WHERE s.return_status = 'Returned')", N)} AS return_rate,
       {ratio("COUNT(*) FILTER (WHERE s.return_status = 'Cancelled')", N)} AS cancellation_rate,
       {ratio(money(REV), BUYERS)} AS clv, {ratio("SUM(s.delivery_days)", N)} AS avg_delivery_days
FROM sales s JOIN products p ON s.product_id = p.product_id GROUP BY p.category"""),
    "date_table": star("""
SELECT date, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month_num,
       strftime(date, '%b %Y') AS month_name, concat('Q', quarter(date), ' ', year(date)) AS quarter FROM days""", DAYS),
    "kpi_revenue_mom_growth": prior("revenue"),
    "kpi_profit_mom_growth": prior("profit"),
    "kpi_revenue_prior_month": star(f"SELECT month, {money('revenue')} AS total_revenue, {money('revenue_prior')} AS revenue_prior_month FROM shifted", DAYS, SHIFTED),
    "kpi_profit_prior_month": star(f"SELECT month, {money('profit')} AS total_profit, {money('profit_prior')} AS profit_prior_month FROM shifted", DAYS, SHIFTED),
    "kpi_revenue_mom_growth_by_region": star(f"""
SELECT region, month, {money('c')} AS total_revenue, {money('p')} AS revenue_prior_month,
       {ratio(money('(COALESCE(c, 0) - p)'), money('p'))} AS revenue_mom_growth
FROM (SELECT region, month, SUM(revenue) AS c FROM (SELECT region, CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(revenue * 100 AS BIGINT) AS revenue FROM sales) x GROUP BY 1, 2) t
FULL JOIN (SELECT s.region, m.month, SUM(CAST(s.revenue * 100 AS BIGINT)) AS p
           FROM months m JOIN sales s ON date_trunc('month', s.order_date) = m.month - INTERVAL 1 MONTH AND (complete OR day(s.order_date) <= last_dom) GROUP BY 1, 2) u
USING (region, month)""", DAYS, SHIFTED),
    "kpi_new_customers_by_region": star(f"""
SELECT c.region, CAST(date_trunc('month', d.date) AS DATE) AS month, {big('COUNT(DISTINCT c.customer_id)')} AS new_customers
FROM days d JOIN customers c ON c.signup_date = d.date GROUP BY 1, 2""", DAYS),
    "kpi_new_customers": star(f"""
SELECT CAST(date_trunc('month', d.date) AS DATE) AS month, {big('COUNT(DISTINCT c.customer_id)')} AS new_customers
FROM days d LEFT JOIN customers c ON c.signup_date = d.date GROUP BY 1""", DAYS),
    "revenue_rank": star(f"SELECT product_name, {money('revenue_c')} AS total_revenue, {big('r')} AS revenue_rank FROM ({RANKED}) t"),
    "top10_flag": star(f"SELECT product_name, CASE WHEN r <= 10 THEN 'Top 10' ELSE 'Other' END AS top10_flag FROM ({RANKED}) t"),
}
