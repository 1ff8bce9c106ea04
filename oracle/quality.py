"""Data quality over the raw tables, loading and round trips."""

from .common import RAW, big, cs, money, pct, star

STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
REGIONS = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')"
STATUS = "('Not Returned', 'Returned', 'Cancelled')"
EARLIEST, AS_OF = "DATE '2000-01-01'", "DATE '2002-01-01'"
JUDGED = ("customer_id, product_id, order_date, quantity, revenue, cost, discount, profit, region, payment_method, "
          "delivery_days, return_status")


def bad_date(c: str) -> str:
    return (f"COALESCE(TRY_CAST({c} AS DATE) < {EARLIEST} OR TRY_CAST({c} AS DATE) > {AS_OF}, TRUE)")


AGE_BAD = "COALESCE(age < 12 OR age > 100, FALSE)"
PRICE_BAD = "COALESCE(price < 0 OR cost < 0 OR price < cost, FALSE)"
NUMERIC_BAD = ("(COALESCE(quantity < 1, FALSE) OR COALESCE(revenue < 0, FALSE) OR COALESCE(cost < 0, FALSE) "
               "OR COALESCE(discount < 0 OR discount > 1, FALSE) OR COALESCE(delivery_days < 0, FALSE))")


def s(c: str) -> str:
    return STRIP.format(c=c)


def fence(table: str, c: str) -> str:
    """Tukey's fence times 8 in cents, by position in the sorted column."""
    return f"""
  SELECT 2*q1 - 3*(q3 - q1) AS low8, 2*q3 + 3*(q3 - q1) AS high8 FROM (
    SELECT MAX(CASE WHEN i = (n-1) // 4 THEN v END) * 4
             + ((n-1) % 4) * (MAX(CASE WHEN i = LEAST((n-1) // 4 + 1, n-1) THEN v END) - MAX(CASE WHEN i = (n-1) // 4 THEN v END)) AS q1,
           MAX(CASE WHEN i = (3*(n-1)) // 4 THEN v END) * 4
             + ((3*(n-1)) % 4) * (MAX(CASE WHEN i = LEAST((3*(n-1)) // 4 + 1, n-1) THEN v END) - MAX(CASE WHEN i = (3*(n-1)) // 4 THEN v END)) AS q3
    FROM (SELECT CAST({c} * 100 AS BIGINT) AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, COUNT(*) OVER () AS n
          FROM {table}) r GROUP BY n) e"""


def far(c: str, f: str) -> str:
    return f"(8 * CAST({c} * 100 AS BIGINT) < (SELECT low8 FROM {f}) OR 8 * CAST({c} * 100 AS BIGINT) > (SELECT high8 FROM {f}))"


CHECKED = f"""
price_fence AS ({fence('raw_products', 'price')}),
revenue_fence AS ({fence('raw_orders', 'revenue')}),
c1 AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY seq) > 1 AS f_duplicate_key, {AGE_BAD} AS f_age,
              {bad_date('signup_date')} AS f_date, NOT COALESCE({s('region')} IN {REGIONS}, FALSE) AS f_region,
              {s('name')} AS t_name, {s('city')} AS t_city, {s('region')} AS t_region
       FROM raw_customers),
c2 AS (SELECT *, f_duplicate_key OR f_age OR f_date OR f_region AS bad FROM c1),
p1 AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) > 1 AS f_duplicate_key, {PRICE_BAD} AS f_price,
              {far('price', 'price_fence')} AS f_outlier, {s('product_name')} AS t_product_name, {s('category')} AS t_category,
              {s('sub_category')} AS t_sub_category
       FROM raw_products),
p2 AS (SELECT *, f_duplicate_key OR f_price AS bad FROM p1),
o0 AS (SELECT *, {s('region')} AS t_region, {s('payment_method')} AS t_payment_method, {s('return_status')} AS t_return_status
       FROM raw_orders),
o1 AS (SELECT *, row_number() OVER (PARTITION BY customer_id, product_id, order_date, quantity, revenue, cost, discount, profit,
                    t_region, t_payment_method, delivery_days, t_return_status ORDER BY seq, order_id) > 1 AS f_full_duplicate,
              NOT COALESCE(customer_id IN (SELECT customer_id FROM c2 WHERE NOT bad), FALSE) AS f_orphan_customer,
              NOT COALESCE(product_id IN (SELECT product_id FROM p2 WHERE NOT bad), FALSE) AS f_orphan_product,
              {bad_date('order_date')} AS f_date, {NUMERIC_BAD} AS f_numeric,
              NOT COALESCE(t_return_status IN {STATUS}, FALSE) AS f_status, {far('revenue', 'revenue_fence')} AS f_outlier
       FROM o0),
o2 AS (SELECT *, f_full_duplicate OR f_orphan_customer OR f_orphan_product OR f_date OR f_numeric OR f_status AS bad FROM o1)
"""
REJECTING = {"c2": ["duplicate_key", "age", "date", "region"], "p2": ["duplicate_key", "price"],
             "o2": ["full_duplicate", "orphan_customer", "orphan_product", "date", "numeric", "status"]}
NAMES = {"c2": "customers", "p2": "products", "o2": "orders"}
KEYS = {"c2": "customer_id", "p2": "product_id", "o2": "order_id"}
COLUMNS = {
    "c2": ["customer_id", "name", "age", "city", "region", "signup_date"],
    "p2": ["product_id", "product_name", "category", "sub_category", "cost", "price"],
    "o2": ["order_id"] + JUDGED.split(", "),
}


def raw(body: str) -> str:
    return star(body, RAW)


def checked(body: str) -> str:
    return star(body, RAW, CHECKED)


def missing(view: str, table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, {big('COUNT(*)')} AS missing FROM {view} WHERE {c} IS NULL "
        "HAVING COUNT(*) > 0" for c in columns)


def hit(view: str, table: str, key: str, value: str, where: str) -> str:
    return (f"SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key, {big('seq')} AS seq, "
            f"CAST({value} AS VARCHAR) AS found_value FROM {view} WHERE {where}")


def changed(view: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, {big(f'COUNT(*) FILTER (WHERE {c} <> {s(c)})')} AS rows_changed "
        f"FROM {view}" for c in columns)


def reasons(view: str) -> str:
    parts = ", ".join(f"CASE WHEN f_{f} THEN '{f}' END" for f in REJECTING[view])
    return (f"SELECT '{NAMES[view]}' AS table_name, CAST({KEYS[view]} AS VARCHAR) AS row_key, {big('seq')} AS seq, "
            f"concat_ws(',', {parts}) AS reasons FROM {view} WHERE bad")


def log_line(view: str, column: str, action: str, count: str, detail: str = "") -> str:
    return (f"SELECT '{NAMES[view]}' AS table_name, '{column}' AS column_name, '{action}' AS action, "
            f"{big(count)} AS rows_affected, '{detail}' AS detail FROM {view} HAVING {count} > 0")


def n(condition: str) -> str:
    return f"COUNT(*) FILTER (WHERE {condition})"


def trimmed(view: str, columns: list[str]) -> list[str]:
    return [log_line(view, c, "trim_whitespace", n(f"{c} <> t_{c}")) for c in columns]


def null_line(view: str) -> str:
    names = ", ".join(f"CASE WHEN {n(f'{c} IS NULL')} > 0 THEN '{c}' END" for c in COLUMNS[view])
    total = " + ".join(n(f"{c} IS NULL") for c in COLUMNS[view])
    return (f"SELECT '{NAMES[view]}' AS table_name, concat_ws(',', {names}) AS column_name, 'missing_values_detected' AS action, "
            f"{big(total)} AS rows_affected, '' AS detail FROM {view} HAVING {total} > 0")


LOG = [
    *trimmed("c2", ["name", "city", "region"]),
    log_line("c2", "customer_id", "flag_duplicate_key", n("f_duplicate_key")),
    log_line("c2", "age", "flag_out_of_range(12-100)", n("f_age")),
    log_line("c2", "signup_date", "flag_invalid_or_future_date", n("f_date")),
    log_line("c2", "region", "flag_unknown_category", n("f_region")),
    null_line("c2"),
    *trimmed("p2", ["product_name", "category", "sub_category"]),
    log_line("p2", "product_id", "flag_duplicate_key", n("f_duplicate_key")),
    log_line("p2", "price/cost", "flag_impossible_value(price<cost or negative)", n("f_price")),
    log_line("p2", "price", "flag_outlier_iqr", n("f_outlier"),
             "outliers are flagged for review, NOT auto-removed (legitimate premium products expected)"),
    null_line("p2"),
    *trimmed("o2", ["region", "payment_method", "return_status"]),
    log_line("o2", "*", "flag_full_duplicate_row", n("f_full_duplicate")),
    log_line("o2", "customer_id/product_id", "flag_referential_integrity_violation",
             f"{n('f_orphan_customer')} + {n('f_orphan_product')}"),
    log_line("o2", "order_date", "flag_invalid_or_future_date", n("f_date")),
    log_line("o2", "quantity/revenue/cost/discount/delivery_days", "flag_impossible_numeric_value", n("f_numeric")),
    log_line("o2", "return_status", "flag_unknown_category", n("f_status")),
    log_line("o2", "revenue", "flag_outlier_iqr", n("f_outlier"),
             "outliers flagged for review, NOT auto-removed (bulk/high-value orders expected)"),
    null_line("o2"),
]


def score(view: str) -> str:
    return pct(n("NOT bad"), "COUNT(*)")


def report(view: str, duplicate: str, outlier: str) -> str:
    nulls = ", ".join(
        f"CASE WHEN {n(f'{c} IS NULL')} > 0 THEN concat('{c}', ':', {n(f'{c} IS NULL')}) END" for c in COLUMNS[view])
    return f"""SELECT '{NAMES[view]}' AS table_name, {big('COUNT(*)')} AS total_rows, {big(n('NOT bad'))} AS valid_rows,
       {big(n('bad'))} AS invalid_rows, concat_ws(',', {nulls}) AS missing_values, {big(n('f_' + duplicate))} AS duplicate_records,
       {outlier} AS outliers_flagged, {score(view)} AS quality_score_pct FROM {view}"""


REPORT = " UNION ALL ".join([
    report("c2", "duplicate_key", "CAST(NULL AS BIGINT)"),
    report("p2", "duplicate_key", big(n("f_outlier"))),
    report("o2", "full_duplicate", big(n("f_outlier"))),
])

CLEAN = {
    "customers": """SELECT customer_id, t_name AS name, CAST(age AS BIGINT) AS age, t_city AS city, t_region AS region,
       CAST(signup_date AS DATE) AS signup_date, customer_segment FROM c2 WHERE NOT bad""",
    "products": """SELECT product_id, t_product_name AS product_name, t_category AS category, t_sub_category AS sub_category,
       CAST(cost AS DOUBLE) AS cost, CAST(price AS DOUBLE) AS price FROM p2 WHERE NOT bad""",
    "orders": """SELECT order_id, customer_id, product_id, CAST(order_date AS DATE) AS order_date, CAST(quantity AS BIGINT) AS quantity,
       CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost, CAST(discount AS DOUBLE) AS discount,
       CAST(profit AS DOUBLE) AS profit, t_region AS region, t_payment_method AS payment_method,
       CAST(delivery_days AS BIGINT) AS delivery_days, t_return_status AS return_status FROM o2 WHERE NOT bad""",
}


def orphans(customers: str, products: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{key}' AS foreign_key, {big('COUNT(*)')} AS orphans FROM raw_orders "
        f"WHERE {key} NOT IN (SELECT {key} FROM {table})"
        for key, table in (("customer_id", customers), ("product_id", products)))


def broken(view: str, table: str, name: str, condition: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, {big(n(condition))} AS violations FROM {view}")


def unique(view: str, table: str, key: str) -> str:
    return (f"SELECT '{table}' AS table_name, 'primary_key' AS constraint_name, "
            f"{big(f'COUNT({key}) - COUNT(DISTINCT {key})')} AS violations FROM {view}")


CONSTRAINTS = [
    unique("raw_customers", "customers", "customer_id"), unique("raw_products", "products", "product_id"),
    unique("raw_orders", "orders", "order_id"),
    *[broken("raw_customers", "customers", f"{c}_not_null", f"{c} IS NULL")
      for c in ("customer_id", "name", "city", "region", "signup_date")],
    broken("raw_customers", "customers", "age_range", "age NOT BETWEEN 12 AND 100"),
    *[broken("raw_products", "products", f"{c}_not_null", f"{c} IS NULL") for c in COLUMNS["p2"]],
    broken("raw_products", "products", "cost_not_negative", "cost < 0"),
    broken("raw_products", "products", "price_not_negative", "price < 0"),
    broken("raw_products", "products", "price_covers_cost", "price < cost"),
    *[broken("raw_orders", "orders", f"{c}_not_null", f"{c} IS NULL") for c in COLUMNS["o2"]],
    broken("raw_orders", "orders", "quantity_positive", "quantity <= 0"),
    broken("raw_orders", "orders", "revenue_not_negative", "revenue < 0"),
    broken("raw_orders", "orders", "cost_not_negative", "cost < 0"),
    broken("raw_orders", "orders", "discount_fraction", "discount NOT BETWEEN 0 AND 1"),
    broken("raw_orders", "orders", "delivery_days_not_negative", "delivery_days < 0"),
    broken("raw_orders", "orders", "return_status_known", f"return_status NOT IN {STATUS}"),
    *[f"SELECT 'orders' AS table_name, '{key}_reference' AS constraint_name, {big('COUNT(*)')} AS violations "
      f"FROM raw_orders WHERE {key} NOT IN (SELECT {key} FROM {view})"
      for key, view in (("customer_id", "raw_customers"), ("product_id", "raw_products"))],
]

CLEAN_COUNTS = [(NAMES[v], f"(SELECT COUNT(*) FROM {v} WHERE NOT bad)") for v in ("c2", "p2", "o2")]
REJECT_COUNTS = [(NAMES[v], f"(SELECT COUNT(*) FROM {v} WHERE bad)") for v in ("c2", "p2", "o2")]

# Types inferred from the text of the uploaded orders.
UPLOADED = {
    "order_id": "string", "customer_id": "int", "product_id": "int", "order_date": "string", "quantity": "int",
    "revenue": "double", "cost": "double", "discount": "double", "profit": "double", "region": "string",
    "payment_method": "string", "delivery_days": "int", "return_status": "string",
}

RAW_COLUMNS = {
    "customers": "customer_id name age city region signup_date customer_segment",
    "products": "product_id product_name category sub_category cost price",
    "orders": "order_id customer_id product_id order_date quantity revenue cost discount profit region payment_method delivery_days return_status",
}


def digest(column: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8) AS BIGINT)"


SQL = {
    "dq_missing": raw(" UNION ALL ".join([
        missing("raw_customers", "customers", COLUMNS["c2"]), missing("raw_products", "products", COLUMNS["p2"]),
        missing("raw_orders", "orders", COLUMNS["o2"])])),
    "dq_full_duplicates": raw(f"""
SELECT order_id, {big('seq')} AS seq FROM (
  SELECT order_id, seq, row_number() OVER (PARTITION BY {JUDGED} ORDER BY seq, order_id) AS i FROM raw_orders) t WHERE i > 1"""),
    "dq_duplicate_key": raw(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {k} AS row_key, {big('seq')} AS seq FROM (SELECT {k}, seq, row_number() OVER "
        f"(PARTITION BY {k} ORDER BY seq) AS i FROM raw_{t}) t WHERE i > 1"
        for t, k in (("customers", "customer_id"), ("products", "product_id")))),
    "dq_trim_text": raw(" UNION ALL ".join([
        changed("raw_customers", "customers", ["name", "city", "region"]),
        changed("raw_products", "products", ["product_name", "category", "sub_category"]),
        changed("raw_orders", "orders", ["region", "payment_method", "return_status"])])),
    "dq_out_of_range": raw(hit("raw_customers", "customers", "customer_id", "age", AGE_BAD)),
    "dq_invalid_date": raw(
        hit("raw_customers", "customers", "customer_id", "signup_date", bad_date("signup_date")) + " UNION ALL "
        + hit("raw_orders", "orders", "order_id", "order_date", bad_date("order_date"))),
    "dq_invalid_category": raw(
        hit("raw_customers", "customers", "customer_id", s("region"), f"NOT COALESCE({s('region')} IN {REGIONS}, FALSE)")
        + " UNION ALL " + hit("raw_orders", "orders", "order_id", s("return_status"),
                              f"NOT COALESCE({s('return_status')} IN {STATUS}, FALSE)")),
    "dq_outliers_iqr": checked(hit("p2", "products", "product_id", "price", "f_outlier") + " UNION ALL "
                               + hit("o2", "orders", "order_id", "revenue", "f_outlier")),
    "dq_price_rule": raw(hit("raw_products", "products", "product_id", "price", PRICE_BAD)),
    "dq_numeric_rules": raw(hit("raw_orders", "orders", "order_id", "quantity", NUMERIC_BAD)),
    "dq_fk_violations": checked(orphans("c2 WHERE NOT bad", "p2 WHERE NOT bad")),
    "dq_score": checked(" UNION ALL ".join(
        f"SELECT '{NAMES[v]}' AS table_name, {big('COUNT(*)')} AS total_rows, {big(n('bad'))} AS invalid_rows, "
        f"{score(v)} AS quality_score_pct FROM {v}" for v in ("c2", "p2", "o2"))),
    "clean_customers": checked(CLEAN["customers"]),
    "clean_products": checked(CLEAN["products"]),
    "clean_orders": checked(CLEAN["orders"]),
    "reject_reasons": checked(" UNION ALL ".join(reasons(v) for v in ("c2", "p2", "o2"))),
    "transformation_log": checked("\nUNION ALL ".join(LOG)),
    "quality_report": checked(f"""
SELECT *, CAST((2 * CAST(SUM(CAST(ROUND(quality_score_pct * 100) AS BIGINT)) OVER () AS BIGINT) + 3) // 6 AS DOUBLE) / 100
       AS overall_quality_score_pct FROM ({REPORT}) r"""),
    "orphan_orders": raw(orphans("raw_customers", "raw_products")),
    "load_total_revenue": checked(f"SELECT {money(cs('revenue'))} AS load_total_revenue FROM o2 WHERE NOT bad"),
    "constraint_violations": raw("\nUNION ALL ".join(CONSTRAINTS)),
    "read_star": raw(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM raw_{t}) AS places, '{c}' AS column_name, {big(f'COUNT({c})')} AS present, "
        f"{big(f'COALESCE(SUM({digest(c)}), 0)')} AS checksum FROM raw_{t}"
        for t, columns in RAW_COLUMNS.items() for c in columns.split()) + " UNION ALL " + " UNION ALL ".join(
        f"SELECT '{t}', COUNT(*), 'unreadable', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM raw_{t}" for t in RAW_COLUMNS)),
    "preview_upload": raw("SELECT CAST(LEAST(20, COUNT(*)) AS BIGINT) AS shown_rows, CAST(13 AS BIGINT) AS shown_columns, CAST(LEAST(20, COUNT(*)) AS BIGINT) AS known_rows FROM raw_orders"),
    "read_cleaned": checked(CLEAN["customers"]),
    "append_cleaned": checked(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {big(c)} AS stored_rows, CAST(0 AS BIGINT) AS conflicts" for t, c in CLEAN_COUNTS)),
    "load_reconcile": checked(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {big(c)} AS expected, {big(c)} AS actual, 'OK' AS status" for t, c in CLEAN_COUNTS)),
    "write_quality_outputs": checked(" UNION ALL ".join([
        *[f"SELECT 'cleaned/{t}' AS dataset, {big(c)} AS stored_rows" for t, c in CLEAN_COUNTS],
        *[f"SELECT 'rejected/{t}' AS dataset, {big(c)} AS stored_rows" for t, c in REJECT_COUNTS],
        "SELECT 'transformation_log' AS dataset, " + big(f"(SELECT COUNT(*) FROM ({' UNION ALL '.join(LOG)}) l)") + " AS stored_rows",
        "SELECT 'quality_report' AS dataset, CAST(3 AS BIGINT) AS stored_rows"])),
    "profile_upload": raw(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, {big(n(f'{c} IS NULL'))} AS missing, {big('COUNT(*)')} AS rows FROM raw_orders"
        for c, kind in UPLOADED.items())),
}
