"""Anomalies, root cause, recommendation rules, questions."""

from .common import QUESTIONS, RFM, STATEMENTS, big, cs, half_up, mean2, money, pct, star

METRICS = ["revenue", "profit", "orders", "returns", "new_customers"]
DAILY = """
span AS (SELECT MIN(order_date) AS lo, MAX(order_date) AS hi FROM sales),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
per_day AS (SELECT order_date, SUM(CAST(revenue * 100 AS BIGINT)) AS revenue, SUM(CAST(profit * 100 AS BIGINT)) AS profit,
                   COUNT(*) AS orders, COUNT(*) FILTER (WHERE return_status = 'Returned') AS returns
            FROM sales GROUP BY order_date),
signups AS (SELECT signup_date, COUNT(*) AS new_customers FROM customers GROUP BY signup_date),
daily AS (SELECT d.date, COALESCE(p.revenue, 0) AS revenue, COALESCE(p.profit, 0) AS profit, COALESCE(p.orders, 0) AS orders,
                 COALESCE(p.returns, 0) AS returns, COALESCE(s.new_customers, 0) AS new_customers
          FROM days d LEFT JOIN per_day p ON p.order_date = d.date LEFT JOIN signups s ON s.signup_date = d.date)
"""
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, date, CAST({m}{'' if m in ('revenue', 'profit') else ' * 100'} AS BIGINT) AS u FROM daily"
    for m in METRICS) + ")"


def _quartile(k: int) -> str:
    lo = f"MAX(CASE WHEN i = ({k}*(n-1)) // 4 THEN u END)"
    hi = f"MAX(CASE WHEN i = LEAST(({k}*(n-1)) // 4 + 1, n-1) THEN u END)"
    return f"({lo} * 4 + MAX(({k}*(n-1)) % 4) * ({hi} - {lo}))"


SCORED = f"""
framed AS (
  SELECT metric, date, u, CAST(COUNT(*) OVER w AS HUGEINT) AS n, CAST(SUM(u) OVER w AS HUGEINT) AS s,
         CAST(SUM(CAST(u AS DECIMAL(38,0)) * u) OVER w AS HUGEINT) AS q
  FROM long WINDOW w AS (PARTITION BY metric ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
measured AS (
  SELECT metric, date, u, CASE WHEN n >= 7 THEN CAST({half_up('s', 'n')} AS DOUBLE) / 100 END AS expected_value,
         CASE WHEN n >= 7 AND n * q - s * s > 0
              THEN CAST(n * u - s AS DOUBLE) / sqrt(CAST(n * (n * q - s * s) AS DOUBLE) / CAST(n - 1 AS DOUBLE)) END AS z
  FROM framed),
fences AS (
  SELECT metric, 2*q1 - 3*(q3 - q1) AS low8, 2*q3 + 3*(q3 - q1) AS high8 FROM (
    SELECT metric, {_quartile(1)} AS q1, {_quartile(3)} AS q3
    FROM (SELECT metric, u, row_number() OVER (PARTITION BY metric ORDER BY u) - 1 AS i, COUNT(*) OVER (PARTITION BY metric) AS n
          FROM long) r GROUP BY metric) e),
slices AS (
  SELECT order_date, region, category, revenue_c, row_number() OVER (PARTITION BY order_date ORDER BY revenue_c DESC, region, category) AS i
  FROM (SELECT s.order_date, s.region, p.category, SUM(CAST(s.revenue * 100 AS BIGINT)) AS revenue_c
        FROM sales s JOIN products p ON s.product_id = p.product_id GROUP BY ALL) t),
texts AS (
  SELECT order_date, string_agg(concat(region, '/', category, ': ', format('{{:,}}', CAST({half_up('revenue_c', '100')} AS BIGINT))),
                                '; ' ORDER BY i) AS listed
  FROM slices WHERE i <= 3 GROUP BY order_date),
anomalies AS (
  SELECT m.metric, m.date, {money('m.u')} AS actual_value, m.expected_value,
         CASE WHEN ROUND(z, 2) = 0 THEN 0.0 ELSE ROUND(z, 2) END AS z_score,
         CASE WHEN abs(z) >= 2.5 THEN 'z-score' ELSE 'IQR' END AS flagged_by,
         CASE WHEN m.metric IN ('revenue', 'profit') THEN COALESCE(t.listed, 'no orders that day') ELSE '' END AS possible_contributors
  FROM measured m JOIN fences f ON m.metric = f.metric LEFT JOIN texts t ON t.order_date = m.date
  WHERE abs(z) >= 2.5 OR 8 * m.u < f.low8 OR 8 * m.u > f.high8)
"""


def series(body: str) -> str:
    return star(body, DAILY, LONG, SCORED)


# --- root cause: two fixed months
A, B = "1997-03", "1997-04"
IN_A = "order_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'"
IN_B = "order_date BETWEEN DATE '1997-04-01' AND DATE '1997-04-30'"


def changes(metric: str) -> str:
    unit = f"CAST({metric} * 100 AS BIGINT)"
    parts = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension_type, {d} AS dimension_value, {unit} AS v, order_date FROM both_months"
        for d in ("region", "category", "payment_method", "return_status"))
    return f"""
both_months AS (SELECT s.*, p.category FROM sales s LEFT JOIN products p ON s.product_id = p.product_id WHERE s.{IN_A} OR s.{IN_B}),
total AS (SELECT COALESCE(SUM({unit}) FILTER (WHERE {IN_A}), 0) AS a, COALESCE(SUM({unit}) FILTER (WHERE {IN_B}), 0) AS b FROM sales),
slices AS (SELECT dimension_type, dimension_value, COALESCE(SUM(v) FILTER (WHERE {IN_A}), 0) AS x, COALESCE(SUM(v) FILTER (WHERE {IN_B}), 0) AS y
           FROM ({parts}) u WHERE dimension_type <> 'category' OR dimension_value IS NOT NULL GROUP BY 1, 2),
contributors AS (SELECT dimension_type, dimension_value, {money('x')} AS before, {money('y')} AS after, {money('(y - x)')} AS change,
                        COALESCE(CAST({half_up('y - x', 'x', 1000)} AS DOUBLE) / 10, 0) AS pct_change,
                        COALESCE({pct('y - x', '(SELECT b - a FROM total)')}, 0) AS pct_of_total_change
                 FROM slices WHERE 100 * abs(y - x) >= (SELECT abs(a) FROM total))"""


def breakdown(dimension: str) -> str:
    source = "sales s JOIN products p ON s.product_id = p.product_id" if dimension == "category" else "sales s"
    return star(f"""
SELECT '{dimension}' AS dimension_type, {dimension} AS dimension_value, {money(cs('s.revenue'))} AS value
FROM {source} WHERE {IN_A} GROUP BY {dimension}""")


# --- recommendation rules
PAIRS = """
pairs AS (SELECT p.product_name, p.category, SUM(CAST(s.revenue * 100 AS BIGINT)) AS r, SUM(CAST(s.profit * 100 AS BIGINT)) AS g,
                 COUNT(*) AS orders
          FROM sales s JOIN products p ON s.product_id = p.product_id GROUP BY 1, 2)"""


def rs(cents_: str) -> str:
    return f"format('{{:,}}', CAST({half_up(cents_, '100')} AS BIGINT))"


def number(n: str) -> str:
    return f"format('{{:,}}', CAST({n} AS BIGINT))"


def tenths(n: str) -> str:
    return f"format('{{:,.1f}}', CAST({n} AS DOUBLE) / 10)"


RULES = f"""
at_risk AS (
  SELECT n, t, {mean2('t', 'n')} AS average FROM (
    SELECT COUNT(*) AS n, SUM(monetary_c) AS t FROM segments WHERE segment = 'At Risk') x WHERE n > 0),
c_at_risk AS (
  SELECT n, t, average, concat(n, ' formerly active customers are in the At Risk segment and have stopped ordering.') AS finding,
         concat('They spent Rs.', {number(half_up('t', '(n * 100)'))}, ' each on average.') AS evidence,
         concat('About Rs.', {rs('t')}, ' of revenue is exposed if all of them leave (an estimate: customers times average past spend).') AS impact,
         'Contact At Risk customers with a personal offer before they become Dormant.' AS action, 'High' AS priority
  FROM at_risk),
losing AS (SELECT * FROM pairs WHERE g < 0),
worst_product AS (SELECT * FROM losing ORDER BY g, product_name, category LIMIT 1),
c_unprofitable AS (
  SELECT n, w.product_name, w.category, w.r, -w.g AS l, -loss AS total,
         concat(n, ' product(s) lose money over all their orders; the worst is ', w.product_name, ' (', w.category, ').') AS finding,
         concat(w.product_name, ' earned Rs.', {rs('w.r')}, ' and lost Rs.', {rs('abs(w.g)')}, '.') AS evidence,
         concat('Together these products lost Rs.', {rs('abs(loss)')}, '.') AS impact,
         'Revisit price and supplier cost of these products, or stop selling them.' AS action,
         CASE WHEN n > 3 THEN 'Critical' ELSE 'High' END AS priority
  FROM worst_product w, (SELECT COUNT(*) AS n, SUM(g) AS loss FROM losing) x),
monthly AS (
  SELECT s.region, p.category, date_trunc('month', s.order_date) AS month, SUM(CAST(s.revenue * 100 AS BIGINT)) AS r
  FROM sales s JOIN products p ON s.product_id = p.product_id GROUP BY ALL),
decline AS (
  SELECT region, category, SUM(r) FILTER (WHERE month < newest) AS past, COUNT(*) FILTER (WHERE month < newest) AS months,
         SUM(r) FILTER (WHERE month = newest) AS latest
  FROM monthly, (SELECT MAX(month) AS newest FROM monthly) m GROUP BY region, category),
worst_pair AS (
  SELECT *, CAST(latest * months - past AS DOUBLE) / CAST(past AS DOUBLE) AS share FROM decline
  WHERE past IS NOT NULL AND latest IS NOT NULL ORDER BY share, region, category LIMIT 1),
c_decline AS (
  SELECT region, category, latest, past, months, {pct('latest * months - past', 'past')} AS pct,
         concat('Revenue of ', region, ' / ', category, ' is ', CAST(abs({half_up('latest * months - past', 'past', 100)}) AS BIGINT),
                '% below its own monthly average in the latest month.') AS finding,
         concat('The latest month brought Rs.', {rs('latest')}, ' against an average of Rs.', {number(half_up('past', '(months * 100)'))}, '.') AS evidence,
         'The decline is local to one region and category; finding its cause early keeps it there.' AS impact,
         concat('Look into supply, marketing and competitors for ', region, ' / ', category, ' before changing anything elsewhere.') AS action,
         'High' AS priority
  FROM worst_pair WHERE share * 100 <= -20),
returns AS (
  SELECT p.category, COUNT(*) AS n, COUNT(*) FILTER (WHERE s.return_status = 'Returned') AS k
  FROM sales s JOIN products p ON s.product_id = p.product_id GROUP BY p.category),
c_returns AS (
  SELECT category, n, k, concat('Category ', category, ' has the highest return rate, ', {tenths(half_up('k', 'n', 1000))}, '%.') AS finding,
         concat('It had ', {number('n')}, ' orders.') AS evidence,
         'Returns add handling cost to every sale and may point to quality or description problems.' AS impact,
         concat('Check the product descriptions, sizes and quality in ', category, '.') AS action, 'Medium' AS priority
  FROM (SELECT * FROM returns ORDER BY CAST(k AS DOUBLE) / n DESC, category LIMIT 1) t WHERE 10 * k >= n),
slow AS (SELECT region, SUM(delivery_days) AS d, COUNT(*) AS n FROM sales GROUP BY region),
c_slow AS (
  SELECT region, d, n, concat(region, ' waits longest for deliveries, ', {tenths(half_up('d', 'n', 10))}, ' days on average.') AS finding,
         concat('All ', {number('n')}, ' deliveries to the region were counted.') AS evidence,
         'Slow delivery can cost repeat orders and cause returns, though these data do not prove it.' AS impact,
         concat('Review the carriers and warehouses that serve ', region, '.') AS action, 'Medium' AS priority
  FROM (SELECT * FROM slow ORDER BY CAST(d AS DOUBLE) / n DESC, region LIMIT 1) t WHERE d >= 4 * n)
"""
CARD = "finding, evidence, impact, action, priority"


def rules(body: str) -> str:
    return star(body, PAIRS, RFM, RULES)


# --- questions
def mentions(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(lower(question), '{p}')" for p in phrases) + ")"


INTENT = f"""CASE
  WHEN {mentions('best-selling', 'best selling', 'top product', 'top-selling')} THEN 'best_sellers'
  WHEN {mentions('worst region', 'worst performing region', 'which region performed worst')} THEN 'worst_region'
  WHEN {mentions('losing money', 'losing-money', 'unprofitable', 'low margin products')} THEN 'losing_products'
  WHEN {mentions('likely to churn', 'churn risk', 'at risk customers', 'who is going to churn')} THEN 'churn_risk'
  WHEN {mentions('compare this month', 'month over month', 'vs last month', 'compared to last month')} THEN 'month_over_month'
  WHEN {mentions('why')} AND {mentions('revenue')} THEN 'root_cause'
  WHEN {mentions('what should')} OR {mentions('recommend')} THEN 'recommendations'
  ELSE 'unknown' END"""
FORBIDDEN = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXEC", "--", ";--"]
SAFE = ("(starts_with(regexp_replace(upper(statement), '^\\s+', ''), 'SELECT') OR starts_with(regexp_replace(upper(statement), '^\\s+', ''), 'WITH')) "
        "AND NOT (" + " OR ".join(f"contains(upper(statement), '{w}')" for w in FORBIDDEN) + ")")

BY_REGION = """
by_region AS (SELECT region, SUM(CAST(revenue * 100 AS BIGINT)) AS r, SUM(CAST(profit * 100 AS BIGINT)) AS g, COUNT(*) AS orders
              FROM sales GROUP BY region),
by_month AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, SUM(CAST(revenue * 100 AS BIGINT)) AS r, COUNT(*) AS orders,
                    row_number() OVER (ORDER BY date_trunc('month', order_date) DESC) AS i
             FROM sales GROUP BY 1, date_trunc('month', order_date)),
mom AS (SELECT t.month AS this_month, t.r AS tr, t.orders AS t_orders, l.month AS last_month, l.r AS lr, l.orders AS l_orders
        FROM by_month t JOIN by_month l ON t.i = 1 AND l.i = 2)"""
LOSING_ALL = "SELECT * FROM pairs WHERE g < 0 OR (r > 0 AND 20 * g < r)"
LOSING = LOSING_ALL + " ORDER BY g, product_name, category LIMIT 8"
CHANGE = half_up("tr - lr", "lr", 1000)


def row(intent: str, answer: str, evidence: str, source: str) -> str:
    return f"SELECT '{intent}' AS intent, {answer} AS answer, {evidence} AS evidence FROM {source}"


ANSWERS = "best AS (SELECT * FROM pairs ORDER BY r DESC, product_name, category LIMIT 5), losing_8 AS (" + LOSING + "),\nanswers AS (" + \
    "\nUNION ALL ".join([
        row("best_sellers", "concat('The best-selling product by revenue is ', first(product_name ORDER BY r DESC, product_name, category), '.')",
            f"string_agg(concat(product_name, ' (', category, '): Rs.', {rs('r')}, ' in ', orders, ' orders'), ' | ' ORDER BY r DESC, product_name, category)",
            "best"),
        row("worst_region", f"concat(first(region ORDER BY r, region), ' is the weakest region by revenue, with Rs.', first({rs('r')} ORDER BY r, region), '.')",
            f"string_agg(concat(region, ': Rs.', {rs('r')}, ' revenue, Rs.', {rs('g')}, ' profit, ', orders, ' orders'), ' | ' ORDER BY r, region)",
            "by_region"),
        row("losing_products", "CASE WHEN COUNT(*) = 0 THEN 'No product loses money or earns less than 5%.' ELSE "
            "concat((SELECT COUNT(*) FROM (" + LOSING_ALL + ") every), ' products lose money or earn less than 5%; the worst is ', first(product_name ORDER BY g, product_name, category), '.') END",
            f"COALESCE(string_agg(concat(product_name, ' (', category, '): Rs.', {rs('g')}, ' profit on Rs.', {rs('r')}, ' revenue, ', orders, ' orders'), ' | ' ORDER BY g, product_name, category), '')",
            "losing_8"),
        row("churn_risk", "concat(SUM(n), ' customers are in a segment at risk of leaving.')",
            "string_agg(concat(segment, ': ', n, ' customers'), ' | ' ORDER BY segment)",
            "(SELECT segment, COUNT(*) AS n FROM segments WHERE segment IN ('At Risk', 'Dormant') GROUP BY segment) g"),
        row("month_over_month",
            f"concat('Revenue ', CASE WHEN {CHANGE} >= 0 THEN 'grew' ELSE 'declined' END, ' by ', {tenths(f'abs({CHANGE})')}, '% from ', last_month, ' to ', this_month, '.')",
            f"concat(this_month, ': Rs.', {rs('tr')}, ' revenue, ', t_orders, ' orders | ', last_month, ': Rs.', {rs('lr')}, ' revenue, ', l_orders, ' orders')",
            "mom"),
        row("root_cause", "'This question asks for a cause, not a figure.'", "''", "(SELECT 1) o"),
        row("recommendations", "'This question asks for advice, not a figure.'", "''", "(SELECT 1) o"),
        row("unknown", "'There is no template for this question yet.'", "''", "(SELECT 1) o"),
    ]) + ")"

# What an answer says about itself does not depend on the data.
WORDS = [
    ("best_sellers", "Products ranked by revenue over all orders.", "Keep these products in stock and feature them.", "High: every order was counted.", ""),
    ("worst_region", "Regions ranked by revenue over the whole period.",
     "Compare its product mix and marketing with other regions before moving budget.", "High: plain sums.", ""),
    ("losing_products", "Listed are products with a negative profit or a margin below 5% of revenue.",
     "Review their price and cost; consider dropping those that keep losing.", "High: plain sums.", ""),
    ("churn_risk", "Based on the segments At Risk and Dormant.", "Start with At Risk customers: they spent well and are easier to win back.",
     "Medium to high: segments follow fixed rules; model scores are probabilities.", ""),
    ("month_over_month", "Total revenue of the two latest months.", "After a decline, compare the periods by slice to find its source.", "High: plain sums.", ""),
    ("root_cause", "", "", "N/A", "Compare two periods by slice to see what moved."),
    ("recommendations", "", "", "N/A", "See the recommendation cards."),
    ("unknown", "", "", "N/A", "Answered are best sellers, worst region, losing products, churn risk and month over month."),
]
WORDING = " UNION ALL ".join("SELECT " + ", ".join(f"'{v}' AS {n}" for v, n in zip(w, ("intent", "explanation", "recommendation", "confidence", "note"))) for w in WORDS)

ANOMALY = "metric, date, actual_value, expected_value, z_score, flagged_by, possible_contributors"

SQL = {
    "write_ml_outputs": star(f"""
SELECT 'churn_features' AS dataset, {big('(SELECT COUNT(*) FROM rfm)')} AS stored_rows
UNION ALL SELECT 'customer_segments', {big('(SELECT COUNT(*) FROM segments)')}
UNION ALL SELECT 'segment_profile', {big('(SELECT COUNT(DISTINCT segment) FROM segments)')}
UNION ALL SELECT 'daily_metrics', {big('(SELECT COUNT(*) FROM daily)')}
UNION ALL SELECT 'anomalies', {big('(SELECT COUNT(*) FROM anomalies)')}""", RFM, DAILY, LONG, SCORED),
    "daily_cells": star(f"""
SELECT order_date, region, category, {money(cs('revenue'))} AS revenue, {money(cs('profit'))} AS profit, {big('COUNT(*)')} AS orders,
       {big("COUNT(*) FILTER (WHERE return_status = 'Returned')")} AS returned
FROM sales LEFT JOIN products USING (product_id) GROUP BY ALL"""),
    "daily_metrics": star(f"""
SELECT date, {money('revenue')} AS revenue, {money('profit')} AS profit, {big('orders')} AS orders, {big('returns')} AS returns,
       {big('new_customers')} AS new_customers FROM daily""", DAILY),
    "rolling_zscore": series(f"""
SELECT metric, date, {money('u')} AS value, CASE WHEN ROUND(z, 2) = 0 THEN 0.0 ELSE ROUND(z, 2) END AS z_score FROM measured"""),
    "rolling_mean": series(f"SELECT metric, date, {money('u')} AS value, expected_value FROM measured"),
    "iqr_flags": series(f"""
SELECT l.metric, l.date, {money('l.u')} AS value, 8 * l.u < f.low8 OR 8 * l.u > f.high8 AS outlier
FROM long l JOIN fences f ON l.metric = f.metric"""),
    "detect_anomalies": series(f"SELECT {ANOMALY} FROM anomalies"),
    "anomaly_contributors": series("SELECT order_date AS date, listed FROM texts"),
    "anomaly_counts": series(f"SELECT metric, {big('COUNT(*)')} AS anomalies FROM anomalies GROUP BY metric"),
    "recent_anomalies": series(f"SELECT {ANOMALY} FROM anomalies ORDER BY date DESC, metric LIMIT 10"),
    "anomaly_filter": series(f"SELECT {ANOMALY} FROM anomalies WHERE metric = 'profit'"),

    "month_bounds": star("""
SELECT DISTINCT strftime(order_date, '%Y-%m') AS month, CAST(date_trunc('month', order_date) AS DATE) AS first_day,
       last_day(order_date) AS last_day FROM sales"""),
    "period_total": star(f"SELECT COALESCE({money(cs('revenue'))}, 0) AS period_total FROM sales WHERE {IN_A}"),
    "period_breakdown": breakdown("region"),
    "period_breakdown_category": breakdown("category"),
    "compare_periods": star("SELECT * FROM contributors", changes("revenue")),
    "compare_periods_profit": star("SELECT * FROM contributors", changes("profit")),
    "compare_totals": star(f"""
SELECT 'revenue' AS metric, '{A}' AS period_a, '{B}' AS period_b, {money('a')} AS total_a, {money('b')} AS total_b,
       COALESCE({pct('b - a', 'a')}, 0) AS pct_change FROM total""", changes("revenue")),
    "top_negative_contributors": star(
        "SELECT * FROM contributors ORDER BY change, dimension_type, dimension_value LIMIT 5", changes("revenue")),
    "top_positive_contributors": star(
        "SELECT * FROM contributors ORDER BY change DESC, dimension_type DESC, dimension_value DESC LIMIT 5", changes("revenue")),
    "auto_periods": star("""
SELECT strftime(date_trunc('month', MAX(order_date)) - INTERVAL 2 MONTH, '%Y-%m') AS period_a,
       strftime(date_trunc('month', MAX(order_date)) - INTERVAL 1 MONTH, '%Y-%m') AS period_b FROM sales"""),

    "rec_at_risk_customers": rules(f"""
SELECT {big('n')} AS customers, average AS average_spend, {money('t')} AS at_stake, {CARD} FROM c_at_risk"""),
    "rec_unprofitable_products": rules(f"""
SELECT {big('n')} AS products, product_name AS worst_product, category AS worst_category, {money('r')} AS worst_revenue,
       {money('l')} AS worst_loss, {money('total')} AS total_loss, {CARD} FROM c_unprofitable"""),
    "rec_regional_decline": rules(f"""
SELECT region, category, pct AS pct_vs_baseline, {money('latest')} AS latest, {mean2('past', 'months')} AS baseline, {CARD}
FROM c_decline"""),
    "rec_high_return_category": rules(f"""
SELECT category, {big('n')} AS orders, {big('k')} AS returned, {pct('k', 'n')} AS return_rate_pct, {CARD} FROM c_returns"""),
    "rec_slow_delivery_region": rules(f"""
SELECT region, {mean2('d', 'n', 100)} AS avg_delivery_days, {CARD} FROM c_slow"""),
    "recommendation_cards": rules(f"""
SELECT {big('rule')} AS rule, {CARD}, {big("list_position(['Critical', 'High', 'Medium', 'Low'], priority)")} AS priority_rank FROM (
  SELECT 1 AS rule, {CARD} FROM c_unprofitable UNION ALL SELECT 2, {CARD} FROM c_decline UNION ALL SELECT 3, {CARD} FROM c_at_risk
  UNION ALL SELECT 4, {CARD} FROM c_returns UNION ALL SELECT 5, {CARD} FROM c_slow) t"""),

    "sql_is_safe": star(f"SELECT conv_id, turn, {SAFE} AS safe FROM statements", STATEMENTS),
    "guarded_query": star(f"""
SELECT region, payment_method, {big('COUNT(*)')} AS orders, {money(cs('revenue'))} AS revenue FROM sales GROUP BY 1, 2"""),
    "classify_questions": star(f"SELECT conv_id, turn, question, {INTENT} AS intent FROM questions", QUESTIONS),
    "answer_best_sellers": star(f"""
SELECT product_name, category, {money('r')} AS revenue, {big('orders')} AS orders FROM pairs
ORDER BY r DESC, product_name, category LIMIT 5""", PAIRS),
    "answer_worst_region": star(f"""
SELECT region, {money('r')} AS revenue, {money('g')} AS profit, {big('orders')} AS orders FROM by_region""", BY_REGION),
    "answer_losing_products": star(f"""
SELECT product_name, category, {money('r')} AS revenue, {money('g')} AS profit, {big('orders')} AS orders FROM ({LOSING}) t""", PAIRS),
    "answer_churn_risk": star(f"""
SELECT segment AS customer_segment, {big('COUNT(*)')} AS customers FROM segments WHERE segment IN ('At Risk', 'Dormant') GROUP BY 1""", RFM),
    "answer_mom": star(f"""
SELECT this_month, {money('tr')} AS this_revenue, {big('t_orders')} AS this_orders, last_month, {money('lr')} AS last_revenue,
       {big('l_orders')} AS last_orders, COALESCE(CAST({CHANGE} AS DOUBLE) / 10, 0) AS change_pct FROM mom""", BY_REGION),
    "answer_questions": star(f"""
SELECT q.conv_id, q.turn, q.intent, a.answer, a.evidence, w.explanation, w.recommendation, w.confidence, w.note
FROM (SELECT conv_id, turn, {INTENT} AS intent FROM questions) q LEFT JOIN answers a ON a.intent = q.intent LEFT JOIN ({WORDING}) w ON w.intent = q.intent""",
                             QUESTIONS, PAIRS, RFM, BY_REGION, ANSWERS),
}
