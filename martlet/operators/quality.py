"""Bulk data quality: checks, cleaning with an audit trail, load checks.

Every check is a boolean column of the row it judges.  All checks of a table
are laid down in one projection, counted in one aggregate, and a row is
rejected when any rejecting check hits.  Nothing is dropped silently: rejected
rows, reasons and counts stay available.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from ..functions.bits import MOST_CELLS, cell_of, cells_of, mark_members
from ..functions.copies import mark_later_copies, mark_later_copies_stored
from ..functions.order_stats import iqr_fence, mark_outside
from ..sources.schemas import CUSTOMERS, KEYS, ORDERS, PRODUCTS

# Accepted categories, bounds, and the wording of the change log.
VALID_REGIONS = ["North", "South", "East", "West", "Central"]
VALID_RETURN_STATUS = ["Not Returned", "Returned", "Cancelled"]
EARLIEST_DATE = date(2000, 1, 1)
AGE_RANGE = (12, 100)
TRIM = "trim_whitespace"
DUPLICATE_KEY = "flag_duplicate_key"
FULL_DUPLICATE = "flag_full_duplicate_row"
AGE = "flag_out_of_range(12-100)"
DATE = "flag_invalid_or_future_date"
CATEGORY = "flag_unknown_category"
PRICE = "flag_impossible_value(price<cost or negative)"
NUMERIC = "flag_impossible_numeric_value"
REFERENCE = "flag_referential_integrity_violation"
OUTLIER = "flag_outlier_iqr"
MISSING = "missing_values_detected"
PRICE_OUTLIER_DETAIL = "outliers are flagged for review, NOT auto-removed (legitimate premium products expected)"
REVENUE_OUTLIER_DETAIL = "outliers flagged for review, NOT auto-removed (bulk/high-value orders expected)"

FLAG = "dq_"
Keep = Callable[[DataFrame, str], DataFrame]   # stores a table under a name and reads it back


# --- single checks -----------------------------------------------------------

def stripped(text: Column) -> Column:
    """Text without white space of any kind at both ends; null stays null.

    Between two visible ASCII characters, the usual case, there is nothing to look for.
    """
    ends = [F.ascii(F.substring(text.cast("string"), place, 1)).between(33, 126) for place in (1, -1)]
    return F.when(ends[0] & ends[1], text.cast("string")).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def out_of_range(c: Column, lo=None, hi=None) -> Column:
    hit = F.lit(False)
    if lo is not None:
        hit = hit | (c < lo)
    if hi is not None:
        hit = hit | (c > hi)
    return exact.flag(hit)


def invalid_date(text: Column, earliest: date, latest: date) -> Column:
    """A date is written YYYY-MM-DD in full; anything that merely begins with one is not."""
    written = F.when(text.cast("string").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
    day = written.try_cast("date")
    return F.coalesce((day < F.lit(earliest)) | (day > F.lit(latest)), F.lit(True))


def invalid_category(c: Column, allowed: list[str]) -> Column:
    return ~exact.flag(c.isin(*allowed))


def price_rule(price: Column, cost: Column) -> Column:
    return exact.flag((price < 0) | (cost < 0) | (price < cost))


def numeric_rules() -> Column:
    return (
        out_of_range(F.col("quantity"), lo=1) | out_of_range(F.col("revenue"), lo=0)
        | out_of_range(F.col("cost"), lo=0) | out_of_range(F.col("discount"), lo=0, hi=1)
        | out_of_range(F.col("delivery_days"), lo=0)
    )


def score(total: Column, invalid: Column) -> Column:
    return F.coalesce(exact.count_percent(total - invalid, total), F.lit(0.0))


def trim_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strips the columns that exist and flags the rows each of them changed."""
    present = [c for c in columns if c in df.columns]
    flagged = df.withColumns({f"{FLAG}trim_{c}": exact.flag(F.col(c) != stripped(F.col(c))) for c in present})
    return flagged.withColumns({c: stripped(F.col(c)) for c in present})


def outliers_iqr(df: DataFrame, column: str, name: str, whisker: str = "1.5") -> DataFrame:
    """Flags amounts outside Tukey's fence, quartiles taken over all rows."""
    return _mark_outliers(df, df, column, name, whisker)


def _mark_outliers(df: DataFrame, raw: DataFrame, column: str, name: str, whisker: str = "1.5") -> DataFrame:
    """The fence comes from the raw rows, so that the other checks are not run for it."""
    units = exact.cents(F.col(column)).cast("bigint")
    return mark_outside(df, units, iqr_fence(raw.select(units.alias("v")), "v", whisker), name)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per column, for columns that have any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])).alias("entry"))
    return long.select("entry.*").where(F.col("missing") > 0)


# --- audits ------------------------------------------------------------------

@dataclass(frozen=True)
class LogLine:
    column: str
    action: str
    flags: tuple[str, ...]
    detail: str = ""


@dataclass(frozen=True)
class Audit:
    """A table with one boolean column per check, and what the checks mean."""

    table: str
    rows: DataFrame
    columns: list[str]
    rejecting: list[str]
    lines: list[LogLine]
    duplicate: str
    outlier: str | None = None
    expected_blank: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    counted: DataFrame | None = None   # the counters, where they were taken while the rows were written

    def rejected_flag(self) -> Column:
        return reduce(lambda a, b: a | b, [F.col(FLAG + c) for c in self.rejecting])

    def cleaned(self) -> DataFrame:
        good = self.rows.where(~self.rejected_flag())
        return good.select(*[F.col(c).cast("date").alias(c) if c in self.dates else F.col(c) for c in self.columns])

    def rejected(self) -> DataFrame:
        reasons = F.array_compact(F.array(*[F.when(F.col(FLAG + c), F.lit(c)) for c in self.rejecting]))
        return self.rows.where(self.rejected_flag()).select(*self.columns, "seq", reasons.alias("reasons"))

    def _audited_columns(self) -> list[str]:
        return [c for c in self.columns if c not in self.expected_blank]

    def counters(self) -> list[Column]:
        flags = sorted({f for line in self.lines for f in line.flags})
        return [F.count(F.lit(1)).alias("total"), F.count_if(self.rejected_flag()).alias("invalid"),
                *[F.count_if(F.col(FLAG + f)).alias(f"hit_{f}") for f in flags],
                *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in self._audited_columns()]]

    def counts(self) -> DataFrame:
        """One row: all counters of the table from a single pass, or from the write of its rows."""
        return self.rows.agg(*self.counters()) if self.counted is None else self.counted

    def report(self, counts: DataFrame | None = None) -> DataFrame:
        columns = self._audited_columns()
        missing = F.map_filter(
            F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"null_{c}"))]), lambda _, n: n > 0)
        return (counts or self.counts()).select(
            F.lit(self.table).alias("table_name"),
            F.col("total").alias("total_rows"), (F.col("total") - F.col("invalid")).alias("valid_rows"),
            F.col("invalid").alias("invalid_rows"),
            missing.alias("missing_values"),
            F.col(f"hit_{self.duplicate}").alias("duplicate_records"),
            (F.col(f"hit_{self.outlier}") if self.outlier else F.lit(None).cast("bigint")).alias("outliers_flagged"),
            score(F.col("total"), F.col("invalid")).alias("quality_score_pct"),
        )

    def log(self, counts: DataFrame | None = None) -> DataFrame:
        columns = self._audited_columns()
        entries = [
            F.struct(F.lit(line.column).alias("column_name"), F.lit(line.action).alias("action"),
                     reduce(lambda a, b: a + b, [F.col(f"hit_{f}") for f in line.flags]).alias("rows_affected"),
                     F.lit(line.detail).alias("detail"))
            for line in self.lines
        ]
        nulls = F.concat_ws(",", *[F.when(F.col(f"null_{c}") > 0, F.lit(c)) for c in columns])
        entries.append(F.struct(
            nulls.alias("column_name"), F.lit(MISSING).alias("action"),
            reduce(lambda a, b: a + b, [F.col(f"null_{c}") for c in columns]).alias("rows_affected"),
            F.lit("").alias("detail")))
        lines = (counts or self.counts()).select(F.explode(F.array(*entries)).alias("entry"))
        return lines.select(F.lit(self.table).alias("table_name"), "entry.*").where(F.col("rows_affected") > 0)


def _trim_lines(columns: list[str]) -> list[LogLine]:
    return [LogLine(c, TRIM, (f"trim_{c}",)) for c in columns]


UNREADABLE = "unreadable_value"


def _with_unreadable(audit: Audit, raw: DataFrame) -> Audit:
    """Rows with text that the reader could not take for a value of its column are rejected for it."""
    if "unreadable" not in raw.columns:
        return audit
    return replace(audit, rows=audit.rows.withColumn(FLAG + UNREADABLE, F.size("unreadable") > 0).drop("unreadable"), rejecting=[*audit.rejecting, UNREADABLE],
                   lines=[*audit.lines, LogLine("*", "flag_unreadable_value", (UNREADABLE,))])


def audit_customers(raw: DataFrame, as_of: date, regions: list[str] = VALID_REGIONS) -> Audit:
    texts = ["name", "city", "region"]
    rows = mark_later_copies(trim_text(raw, texts), ["customer_id"], _first_seen(raw, "customer_id"),
                             FLAG + "duplicate_key")
    rows = rows.withColumns({
        FLAG + "age": out_of_range(F.col("age"), *AGE_RANGE),
        FLAG + "date": invalid_date(F.col("signup_date"), EARLIEST_DATE, as_of),
        FLAG + "region": invalid_category(F.col("region"), regions),
    })
    return _with_unreadable(Audit(
        "customers", rows, CUSTOMERS.names, ["duplicate_key", "age", "date", "region"],
        [*_trim_lines(texts), LogLine("customer_id", DUPLICATE_KEY, ("duplicate_key",)), LogLine("age", AGE, ("age",)),
         LogLine("signup_date", DATE, ("date",)), LogLine("region", CATEGORY, ("region",))],
        "duplicate_key", expected_blank=["customer_segment"], dates=["signup_date"]), raw)


def audit_products(raw: DataFrame) -> Audit:
    texts = ["product_name", "category", "sub_category"]
    rows = mark_later_copies(trim_text(raw, texts), ["product_id"], _first_seen(raw, "product_id"),
                             FLAG + "duplicate_key")
    rows = rows.withColumn(FLAG + "price", price_rule(F.col("price"), F.col("cost")))
    rows = _mark_outliers(rows, raw, "price", FLAG + "outlier")
    return _with_unreadable(Audit(
        "products", rows, PRODUCTS.names, ["duplicate_key", "price"],
        [*_trim_lines(texts), LogLine("product_id", DUPLICATE_KEY, ("duplicate_key",)),
         LogLine("price/cost", PRICE, ("price",)), LogLine("price", OUTLIER, ("outlier",), PRICE_OUTLIER_DETAIL)],
        "duplicate_key", outlier="outlier"), raw)


def mark_foreign_keys(orders: DataFrame, customers: DataFrame, products: DataFrame, keep: Keep | None = None) -> DataFrame:
    """Flags order lines whose customer or product is not among the given (clean) tables.

    Both joins are by unique key.  Spark broadcasts a side only if its measured
    size allows it; otherwise a hot customer's partition is split by AQE.  With `keep`,
    whole-number keys that fill few cells of a bitmap go to the tasks as such, whatever
    their table's size, and no line is shuffled for them.
    """
    for table, key, name in ((customers, "customer_id", "customer"), (products, "product_id", "product")):
        known = table.select(key).where(F.col(key).isNotNull())
        if keep and _whole_numbers(orders, table, key) and known.select(cell_of(F.col(key))).distinct().count() <= MOST_CELLS:
            cells = keep(cells_of(known, F.col(key)), f"known_{name}")
            orders = mark_members(orders, F.col(key), cells, f"known_{name}")
            orders = orders.withColumn(f"{FLAG}orphan_{name}", ~F.col(f"known_{name}")).drop(f"known_{name}")
            orders = orders.select(key, *[c for c in orders.columns if c != key])   # the order of columns that a join gives
            continue
        known = table.select(key).withColumn(f"known_{name}", F.lit(True))
        orders = orders.join(known, key, "left")
        orders = orders.withColumn(f"{FLAG}orphan_{name}", F.col(f"known_{name}").isNull()).drop(f"known_{name}")
    return orders


def _whole_numbers(orders: DataFrame, table: DataFrame, key: str) -> bool:
    return all(dict(df.dtypes)[key] in ("int", "bigint") for df in (orders, table))


def audit_orders(raw: DataFrame, customers: DataFrame, products: DataFrame, as_of: date, keep: Keep | None = None) -> Audit:
    """`customers` and `products` are the cleaned tables: a line of a rejected customer is rejected too.

    With `keep` the trimmed lines are stored once, so that copies, keys and the fence of
    the revenue are looked up from there and few whole lines are shuffled.
    """
    texts = ["region", "payment_method", "return_status"]
    judged = [c for c in ORDERS.names if c != "order_id"]
    rows, first = trim_text(raw, texts), _first_seen(raw, "order_id")
    if keep:
        rows = raw = keep(rows, "trimmed")
        rows = mark_later_copies_stored(rows, judged, first, FLAG + "full_duplicate", keep)
    else:
        rows = mark_later_copies(rows, judged, first, FLAG + "full_duplicate")
    rows = mark_foreign_keys(rows, customers, products, keep)
    rows = rows.withColumns({
        FLAG + "date": invalid_date(F.col("order_date"), EARLIEST_DATE, as_of),
        FLAG + "numeric": numeric_rules(),
        FLAG + "status": invalid_category(F.col("return_status"), VALID_RETURN_STATUS),
    })
    rows = _mark_outliers(rows, raw, "revenue", FLAG + "outlier")
    return _with_unreadable(Audit(
        "orders", rows, ORDERS.names,
        ["full_duplicate", "orphan_customer", "orphan_product", "date", "numeric", "status"],
        [*_trim_lines(texts), LogLine("*", FULL_DUPLICATE, ("full_duplicate",)),
         LogLine("customer_id/product_id", REFERENCE, ("orphan_customer", "orphan_product")),
         LogLine("order_date", DATE, ("date",)),
         LogLine("quantity/revenue/cost/discount/delivery_days", NUMERIC, ("numeric",)),
         LogLine("return_status", CATEGORY, ("status",)),
         LogLine("revenue", OUTLIER, ("outlier",), REVENUE_OUTLIER_DETAIL)],
        "full_duplicate", outlier="outlier", dates=["order_date"]), raw)


def _first_seen(raw: DataFrame, key: str) -> list[str]:
    return ["seq", key] if "seq" in raw.columns else [key]


@dataclass(frozen=True)
class StarAudit:
    customers: Audit
    products: Audit
    orders: Audit
    judge_orders: Callable[..., Audit]   # the orders against other cleaned customers and products; with `keep` as in audit_orders

    def __iter__(self):
        return iter((self.customers, self.products, self.orders))


def audit_star(raw_customers: DataFrame, raw_products: DataFrame, raw_orders: DataFrame, as_of: date,
               regions: list[str] = VALID_REGIONS) -> StarAudit:
    c, p = audit_customers(raw_customers, as_of, regions), audit_products(raw_products)

    def judge_orders(customers: DataFrame, products: DataFrame, keep: Keep | None = None) -> Audit:
        return audit_orders(raw_orders, customers, products, as_of, keep)

    return StarAudit(c, p, judge_orders(c.cleaned(), p.cleaned()), judge_orders)


def transformation_log(audit: StarAudit) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.log() for a in audit])


def quality_report(audit: StarAudit) -> DataFrame:
    """One row per table, each with the unweighted mean score of the three tables."""
    return with_overall_score(reduce(DataFrame.unionByName, [a.report() for a in audit]))


def with_overall_score(reports: DataFrame) -> DataFrame:
    """Adds the mean score to the reports (one row per table), without running their audits again for it."""
    hundredths = F.sum(F.round(F.col("quality_score_pct") * 100).cast("bigint"))
    overall = exact.half_up(exact.whole(hundredths), exact.whole(F.count("*"))).cast("double") / 100
    together = reports.agg(F.collect_list(F.struct("*")).alias("reports"), overall.alias("overall_quality_score_pct"))
    return together.select(F.inline("reports"), "overall_quality_score_pct")


# --- checks after loading ----------------------------------------------------

def orphan_orders(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Number of order lines without their customer, and without their product.

    Lines are counted per key before the join, so a hot key is one row in it.
    """
    def orphans(table: DataFrame, key: str) -> DataFrame:
        per_key = orders.groupBy(key).agg(F.count("*").alias("n"))
        lost = per_key.join(table.select(key), key, "left_anti")
        return lost.agg(F.lit(key).alias("foreign_key"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))

    return orphans(customers, "customer_id").unionByName(orphans(products, "product_id"))


def row_counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
    counts = [df.agg(F.lit(table).alias("table_name"), F.count("*").alias(name)) for table, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def load_reconcile(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    both = row_counts(expected, "expected").join(row_counts(actual, "actual"), "table_name", "full")
    same = F.col("expected").eqNullSafe(F.col("actual"))
    return both.select("table_name", "expected", "actual", F.when(same, "OK").otherwise("MISMATCH").alias("status"))


def load_total_revenue(orders: DataFrame) -> DataFrame:
    return orders.agg(F.sum("revenue").alias("load_total_revenue"))


def _constraints(table: str) -> dict[str, Column]:
    """Violation per declared constraint; like a CHECK, an unknown comparison passes."""
    c = F.col
    if table == "customers":
        rules = {"age_range": (c("age") < AGE_RANGE[0]) | (c("age") > AGE_RANGE[1])}
        required = ["customer_id", "name", "city", "region", "signup_date"]
    elif table == "products":
        rules = {"cost_not_negative": c("cost") < 0, "price_not_negative": c("price") < 0,
                 "price_covers_cost": c("price") < c("cost")}
        required = ["product_id", "product_name", "category", "sub_category", "cost", "price"]
    else:
        rules = {"quantity_positive": c("quantity") <= 0, "revenue_not_negative": c("revenue") < 0,
                 "cost_not_negative": c("cost") < 0,
                 "discount_fraction": (c("discount") < 0) | (c("discount") > 1),
                 "delivery_days_not_negative": c("delivery_days") < 0,
                 "return_status_known": ~c("return_status").isin(*VALID_RETURN_STATUS)}
        required = ORDERS.names
    return {**{f"{name}_not_null": c(name).isNull() for name in required}, **rules}


def constraint_violations(customers: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Violating rows per NOT NULL, CHECK, primary and foreign key of the star schema."""
    parts = []
    for table, df in (("customers", customers), ("products", products), ("orders", orders)):
        rules = _constraints(table)
        key = KEYS[table]
        # Repeated keys are counted apart, so that only the key itself is shuffled.
        repeats = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") - 1).alias("more"))
        counts = df.agg(*[exact.count_if(rule).alias(name) for name, rule in rules.items()]).withColumn(
            "primary_key", repeats.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n")).scalar())
        entries = F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.col(n).alias("violations"))
                            for n in ["primary_key", *rules]])
        parts.append(counts.select(F.explode(entries).alias("e"))
                     .select(F.lit(table).alias("table_name"), "e.*"))
    orphans = orphan_orders(orders, customers, products).select(
        F.lit("orders").alias("table_name"), F.concat(F.col("foreign_key"), F.lit("_reference")).alias("constraint_name"),
        F.col("orphans").alias("violations"))
    return reduce(DataFrame.unionByName, [*parts, orphans])
