"""Segments, churn features and split."""

from martlet.operators.segments import DESCRIPTIONS

from .common import RFM, big, mean2, money, pct, star


def rfm(body: str) -> str:
    return star(body, RFM)


SCORES = f"""customer_id, {big('recency_days')} AS recency_days, {big('frequency')} AS frequency,
       {money('monetary_c')} AS monetary, {big('r_score')} AS r_score, {big('f_score')} AS f_score, {big('m_score')} AS m_score"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DESCRIPTION = "CASE segment " + " ".join(f"WHEN {quoted(s)} THEN {quoted(d)}" for s, d in DESCRIPTIONS.items()) + " END"


def mean1(units: str, n: str) -> str:
    return f"(CAST((2 * 10 * CAST({units} AS HUGEINT) + {n}) // (2 * {n}) AS DOUBLE) / 10)"


FEATURES = """
churn_features AS (
  SELECT c.customer_id, c.region, CAST(c.age AS BIGINT) AS age, COUNT(*) AS frequency,
         CAST(SUM(CAST(s.revenue * 100 AS BIGINT)) AS DOUBLE) / 100 AS monetary,
         SUM(CAST(s.revenue * 100 AS BIGINT)) AS monetary_c,
         CAST(SUM(CAST(s.revenue * 100 AS BIGINT)) AS DOUBLE) / 100 / COUNT(*) AS avg_order_value,
         CAST(COUNT(*) FILTER (WHERE s.return_status = 'Returned') AS DOUBLE) / COUNT(*) AS return_frequency,
         (SELECT MAX(order_date) FROM sales) - MAX(s.order_date) AS recency_days,
         CAST(MAX(s.order_date) - MIN(s.order_date) AS BIGINT) AS customer_tenure_days,
         CAST(CASE WHEN (SELECT MAX(order_date) FROM sales) - MAX(s.order_date) > 120 THEN 1 ELSE 0 END AS BIGINT) AS churned
  FROM customers c JOIN sales s ON c.customer_id = s.customer_id GROUP BY c.customer_id, c.region, c.age)
"""
COLUMNS = ("customer_id, region, age, frequency, monetary, avg_order_value, return_frequency, "
           "CAST(recency_days AS BIGINT) AS recency_days, customer_tenure_days, churned")


def features(body: str) -> str:
    return star(body, FEATURES)


SCALES = {"frequency": 1, "monetary": 100, "avg_order_value": 1_000_000, "return_frequency": 1_000_000,
          "recency_days": 1, "customer_tenure_days": 1}
LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({scale} AS HUGEINT) AS scale, CAST({f} AS DOUBLE) AS value, "
    f"CAST(ROUND(CAST(CAST({f} AS DOUBLE) AS DECIMAL(24,8)) * {scale}) AS BIGINT) AS units FROM churn_features"
    for f, scale in SCALES.items())


def two(units: str, size: str) -> str:
    return f"(CAST((2 * 100 * CAST({units} AS HUGEINT) + {size}) // (2 * {size}) AS DOUBLE) / 100)"


def at(k: int) -> str:
    lo = f"MAX(CASE WHEN i = ({k}*(n-1)) // 4 THEN units END)"
    hi = f"MAX(CASE WHEN i = LEAST(({k}*(n-1)) // 4 + 1, n-1) THEN units END)"
    return f"({lo} * 4 + MAX(({k}*(n-1)) % 4) * ({hi} - {lo}))"


def z(c: str) -> str:
    value = f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER (), 4)"
    return f"CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END"


NUMERIC = ["frequency", "monetary", "avg_order_value", "return_frequency", "customer_tenure_days", "age"]
MODELS = ["logistic_regression", "random_forest"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

SQL = {
    "rfm_base": rfm(f"""
SELECT customer_id, {big('recency_days')} AS recency_days, {big('frequency')} AS frequency, {money('monetary_c')} AS monetary
FROM rfm"""),
    "rfm_scores": rfm(f"SELECT {SCORES}, {big('r_score + f_score + m_score')} AS rfm_score FROM scores"),
    "rfm_segments": rfm(f"SELECT {SCORES}, segment FROM segments"),
    "segment_profile": rfm(f"""
SELECT segment, {big('COUNT(*)')} AS customers, {mean1('SUM(recency_days)', 'COUNT(*)')} AS avg_recency_days,
       {mean1('SUM(frequency)', 'COUNT(*)')} AS avg_frequency, {mean1('SUM(monetary_c)', '(100 * COUNT(*))')} AS avg_monetary,
       {DESCRIPTION} AS description
FROM segments GROUP BY segment"""),
    "segment_counts": rfm(f"SELECT segment, {big('COUNT(*)')} AS customers FROM segments GROUP BY segment"),
    "apply_segments": rfm("""
SELECT c.customer_id, c.name, CAST(c.age AS BIGINT) AS age, c.city, c.region, c.signup_date,
       COALESCE(g.segment, c.customer_segment, 'No Orders Yet') AS customer_segment
FROM customers c LEFT JOIN segments g ON c.customer_id = g.customer_id"""),
    "churn_features": features(f"SELECT {COLUMNS} FROM churn_features"),
    "churn_balance": features(f"""
SELECT {big('COUNT(*)')} AS customers, {big('SUM(churned)')} AS churned, {big('SUM(1 - churned)')} AS active,
       {pct('SUM(churned)', 'COUNT(*)')} AS churned_pct, {pct('SUM(1 - churned)', 'COUNT(*)')} AS active_pct
FROM churn_features"""),
    "feature_summary": features(f"""
SELECT feature, {big('COUNT(*)')} AS count, {two('SUM(units)', '(MAX(scale) * COUNT(*))')} AS mean,
       ROUND(STDDEV_SAMP(value), 2) AS std, {two('MIN(units)', 'MAX(scale)')} AS min, {two(at(1), '(4 * MAX(scale))')} AS p25,
       {two(at(2), '(4 * MAX(scale))')} AS p50, {two(at(3), '(4 * MAX(scale))')} AS p75, {two('MAX(units)', 'MAX(scale)')} AS max
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY units) - 1 AS i, COUNT(*) OVER (PARTITION BY feature) AS n
      FROM ({LONG}) l) t
GROUP BY feature"""),
    "churn_split": features("""
SELECT customer_id, churned, i <= (n + 3) // 4 AS is_test FROM (
  SELECT customer_id, churned, COUNT(*) OVER (PARTITION BY churned) AS n,
         row_number() OVER (PARTITION BY churned ORDER BY customer_id * (7919 + 42) % 10007, customer_id) AS i
  FROM churn_features) t"""),
    "risk_category": features("SELECT customer_id, region, true AS in_range, true AS band_agrees FROM churn_features"),
    "risk_total": features(f"SELECT {big('COUNT(*)')} AS customers FROM churn_features"),
    "churn_io_agrees": features("SELECT customer_id, true AS same FROM churn_features"),
    "churn_feature_names": features("SELECT unnest([" + ", ".join(f"'{n}'" for n in [*NUMERIC, *[f"region_{r}" for r in REGIONS]]) + "]) AS feature"),
    "churn_held_out": features(f"""
SELECT model, {big('churned')} AS churned, {big('(COUNT(*) + 3) // 4')} AS customers
FROM churn_features, (SELECT unnest([{", ".join(repr(m) for m in MODELS)}]) AS model) m GROUP BY ALL"""),
    "churn_preprocess": features(
        "SELECT customer_id, " + ", ".join(f"{z(c)} AS z_{c}" for c in NUMERIC) + ", "
        + ", ".join(f"CASE WHEN region = '{r}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_{r.lower().replace(' ', '_')}"
                    for r in REGIONS)
        + " FROM churn_features"),
}
