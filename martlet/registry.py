"""Every operator as a query over a folder of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.copies import mark_later_copies
from .functions.exact import portable
from .operators import (advice, anomalies, churn, customers, dashboards, measures, operations, products, quality,
                        questions, rootcause, sales, segments)
from .plans import cube
from .plans.session import shared_folder
from .sources import raw, readers, writers
from .sources.schemas import KEYS, RAW
from .sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = date(1996, 3, 1), date(1998, 2, 28)
PRODUCT_FACT = ("product_id", "revenue", "quantity")
EXECUTIVE_FACT = ("customer_id", "revenue", "profit", "order_date")


def add(name: str, build: Callable[[Star], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: portable(build(Star(spark, folder)))


def _cells(t: Star, *keys: str) -> DataFrame:
    """Revenue, profit and orders per product and keys (`order_date` by month): what profit metrics read instead of lines."""
    fact = t.sales(*PRODUCT_FACT, *keys)
    if "order_date" in keys:
        fact = fact.withColumn("order_date", F.trunc("order_date", "month"))
    return products.profit_cells(fact, t.products(), list(keys))


def _cells_in_range(t: Star) -> DataFrame:
    fact = sales.in_range(t.sales(*PRODUCT_FACT, "order_date", start=START, end=END), START, END)
    return products.profit_cells(fact, t.products())


# Sales
add("date_range_filter", lambda t: sales.in_range(
    t.sales("order_id", "order_date", "revenue", "profit", start=START, end=END), START, END))
add("total_revenue", lambda t: sales.total_revenue(t.sales("revenue")))
add("total_profit", lambda t: sales.total_profit(_cells(t)))
add("total_revenue_in_range", lambda t: sales.total_revenue(
    t.sales("revenue", "order_date", start=START, end=END), START, END))
add("total_profit_in_range", lambda t: sales.total_profit(_cells_in_range(t)))
add("profit_margin", lambda t: sales.profit_margin(_cells(t)))
add("profit_margin_in_range", lambda t: sales.profit_margin(_cells_in_range(t)))
add("average_order_value", lambda t: sales.average_order_value(t.sales("revenue")))
add("average_order_value_in_range", lambda t: sales.average_order_value(
    t.sales("revenue", "order_date", start=START, end=END), START, END))
add("monthly_revenue", lambda t: sales.monthly_revenue(_cells(t, "order_date")))
add("quarterly_revenue", lambda t: sales.quarterly_revenue(_cells(t, "order_date")))
add("revenue_growth_mom", lambda t: sales.revenue_growth_mom(t.sales("order_date", "revenue")))
add("recent_growth", lambda t: sales.recent_growth(t.sales("order_date", "revenue")))
add("revenue_by_region", lambda t: sales.revenue_by_region(_cells(t, "region")))
add("revenue_by_product", lambda t: sales_by_product(t))
add("discount_analysis", lambda t: sales.discount_analysis(_cells(t, "discount")))
add("discount_bracket", lambda t: sales.with_discount_bracket(t.sales("order_id", "discount")))
add("order_count", lambda t: sales.order_count(t.sales("order_id")))
add("sales_summary", lambda t: sales.sales_summary(_cells(t)))


def sales_by_product(t: Star) -> DataFrame:
    return products.revenue_by_product(t.sales(*PRODUCT_FACT), t.products())


# Customers
add("total_customers", lambda t: customers.total_customers(t.customers()))
add("new_customers_by_month", lambda t: customers.new_customers_by_month(t.customers()))
add("returning_customers", lambda t: customers.returning_customers(t.sales("customer_id")))
add("retention_rate", lambda t: customers.retention_rate(t.sales("customer_id")))
add("churn_rate", lambda t: customers.churn_rate(t.sales("customer_id", "order_date")))
add("customer_lifetime_value", lambda t: customers.customer_lifetime_value(
    t.sales("customer_id", "revenue", "profit"), t.customers()))
add("top_customers", lambda t: customers.top_customers(t.sales("customer_id", "revenue", "profit"), t.customers()))
add("average_purchase_frequency", lambda t: customers.average_purchase_frequency(t.sales("customer_id")))
add("customers_summary", lambda t: customers.customers_summary(t.sales("customer_id", "order_date"), t.customers()))

# Products
add("top_products", lambda t: products.top_products(t.sales(*PRODUCT_FACT), t.products()))
add("top_products_by_profit", lambda t: products.top_products(t.sales(*PRODUCT_FACT), t.products(), by="profit"))
add("top_products_by_orders", lambda t: products.top_products(t.sales(*PRODUCT_FACT), t.products(), by="orders"))
add("bottom_products", lambda t: products.bottom_products(t.sales(*PRODUCT_FACT), t.products()))
add("most_profitable_products", lambda t: products.most_profitable_products(t.sales(*PRODUCT_FACT), t.products()))
add("low_margin_products", lambda t: products.low_margin_products(t.sales(*PRODUCT_FACT), t.products()))
add("return_rate_by_product", lambda t: products.return_rate_by_product(
    t.sales("product_id", "return_status"), t.products()))
add("category_performance", lambda t: products.category_performance(
    t.sales(*PRODUCT_FACT, "return_status"), t.products()))

# Operations
add("average_delivery_time", lambda t: operations.average_delivery_time(t.sales("delivery_days")))
add("cancellation_rate", lambda t: operations.cancellation_rate(t.sales("return_status")))
add("return_rate", lambda t: operations.return_rate(t.sales("return_status")))
add("regional_operational_performance", lambda t: operations.regional_operational_performance(
    t.sales("region", "delivery_days", "return_status")))
add("delivery_time_by_category", lambda t: operations.delivery_time_by_category(
    t.sales("product_id", "delivery_days"), t.products()))
add("operations_summary", lambda t: operations.operations_summary(t.sales("delivery_days", "return_status")))

# Summary pages
add("home_summary", lambda t: dashboards.home_summary(_cells(t), t.customers()))
add("executive_summary", lambda t: dashboards.executive_summary(t.sales(*EXECUTIVE_FACT), t.customers()))


# Data quality, over the raw tables
AS_OF = date(2002, 1, 1)
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def star_audit(t: Star) -> quality.StarAudit:
    return quality.audit_star(raw.raw_customers(t), raw.raw_products(t), raw.raw_orders(t), AS_OF, REGIONS)


def customers_audit(t: Star) -> quality.Audit:
    return quality.audit_customers(raw.raw_customers(t), AS_OF, REGIONS)


def products_audit(t: Star) -> quality.Audit:
    return quality.audit_products(raw.raw_products(t))


def orders_audit(t: Star) -> quality.Audit:
    return star_audit(t).orders


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _raw_tables(t: Star) -> dict[str, DataFrame]:
    return {"customers": raw.raw_customers(t), "products": raw.raw_products(t), "orders": raw.raw_orders(t)}


def _found(df: DataFrame, table: str, key: str, value: str, hit) -> DataFrame:
    """The rows a check hits, in one shape for every table."""
    return df.where(hit).select(
        F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col("seq"),
        F.col(value).cast("string").alias("found_value"))


def dq_missing(t: Star) -> DataFrame:
    parts = []
    for name, df in _raw_tables(t).items():
        columns = [c for c in df.columns if c not in ("seq", "customer_segment")]
        parts.append(quality.missing_counts(df, columns).withColumn("table_name", F.lit(name)))
    return _union(parts)


def dq_full_duplicates(t: Star) -> DataFrame:
    orders = raw.raw_orders(t)
    judged = [c for c in orders.columns if c not in ("order_id", "seq")]
    return mark_later_copies(orders, judged, ["seq", "order_id"], "copy").where("copy").select("order_id", "seq")


def dq_duplicate_key(t: Star) -> DataFrame:
    parts = []
    for name, df in (("customers", raw.raw_customers(t)), ("products", raw.raw_products(t))):
        key = KEYS[name]
        marked = mark_later_copies(df.select(key, "seq"), [key], ["seq"], "copy")
        parts.append(marked.where("copy").select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "seq"))
    return _union(parts)


def dq_trim_text(t: Star) -> DataFrame:
    texts = {"customers": ["name", "city", "region"], "products": ["product_name", "category", "sub_category"],
             "orders": ["region", "payment_method", "return_status"]}
    parts = []
    for name, df in _raw_tables(t).items():
        trimmed = quality.trim_text(df, texts[name])
        counts = trimmed.agg(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"dq_trim_{c}")).alias("rows_changed"))
            for c in texts[name]]).alias("entries"))
        parts.append(counts.select(F.explode("entries").alias("e")).select(F.lit(name).alias("table_name"), "e.*"))
    return _union(parts)


def dq_invalid_date(t: Star) -> DataFrame:
    def hit(c):
        return quality.invalid_date(F.col(c), quality.EARLIEST_DATE, AS_OF)
    return _found(raw.raw_customers(t), "customers", "customer_id", "signup_date", hit("signup_date")).unionByName(
        _found(raw.raw_orders(t), "orders", "order_id", "order_date", hit("order_date")))


def dq_invalid_category(t: Star) -> DataFrame:
    c = quality.trim_text(raw.raw_customers(t), ["region"])
    o = quality.trim_text(raw.raw_orders(t), ["return_status"])
    return _found(c, "customers", "customer_id", "region", quality.invalid_category(F.col("region"), REGIONS)).unionByName(
        _found(o, "orders", "order_id", "return_status",
               quality.invalid_category(F.col("return_status"), quality.VALID_RETURN_STATUS)))


def dq_outliers_iqr(t: Star) -> DataFrame:
    p = quality.outliers_iqr(raw.raw_products(t), "price", "far")
    o = quality.outliers_iqr(raw.raw_orders(t), "revenue", "far")
    return _found(p, "products", "product_id", "price", F.col("far")).unionByName(
        _found(o, "orders", "order_id", "revenue", F.col("far")))


def dq_fk_violations(t: Star) -> DataFrame:
    c, p = customers_audit(t).cleaned(), products_audit(t).cleaned()
    return quality.orphan_orders(raw.raw_orders(t), c, p)


def dq_score(t: Star) -> DataFrame:
    return _union([a.report().select("table_name", "total_rows", "invalid_rows", "quality_score_pct")
                   for a in star_audit(t)])


def reject_reasons(t: Star) -> DataFrame:
    return _union([
        a.rejected().select(F.lit(a.table).alias("table_name"), F.col(KEYS[a.table]).cast("string").alias("row_key"),
                            "seq", F.array_join("reasons", ",").alias("reasons"))
        for a in star_audit(t)])


def quality_report(t: Star) -> DataFrame:
    report = quality.quality_report(star_audit(t))
    missing = F.array_join(F.transform(F.map_entries("missing_values"), lambda e: F.concat_ws(":", e.key, e.value)), ",")
    return report.withColumn("missing_values", missing)


def orphan_orders(t: Star) -> DataFrame:
    return quality.orphan_orders(raw.raw_orders(t), raw.raw_customers(t), raw.raw_products(t))


def constraint_violations(t: Star) -> DataFrame:
    return quality.constraint_violations(raw.raw_customers(t), raw.raw_products(t), raw.raw_orders(t))


add("dq_missing", dq_missing)
add("dq_full_duplicates", dq_full_duplicates)
add("dq_duplicate_key", dq_duplicate_key)
add("dq_trim_text", dq_trim_text)
add("dq_out_of_range", lambda t: _found(raw.raw_customers(t), "customers", "customer_id", "age",
                                        quality.out_of_range(F.col("age"), *quality.AGE_RANGE)))
add("dq_invalid_date", dq_invalid_date)
add("dq_invalid_category", dq_invalid_category)
add("dq_outliers_iqr", dq_outliers_iqr)
add("dq_price_rule", lambda t: _found(raw.raw_products(t), "products", "product_id", "price",
                                      quality.price_rule(F.col("price"), F.col("cost"))))
add("dq_numeric_rules", lambda t: _found(raw.raw_orders(t), "orders", "order_id", "quantity", quality.numeric_rules()))
add("dq_fk_violations", dq_fk_violations)
add("dq_score", dq_score)
add("clean_customers", lambda t: customers_audit(t).cleaned())
add("clean_products", lambda t: products_audit(t).cleaned())
add("clean_orders", lambda t: orders_audit(t).cleaned())
add("reject_reasons", reject_reasons)
add("transformation_log", lambda t: quality.transformation_log(star_audit(t)))
add("quality_report", quality_report)
add("orphan_orders", orphan_orders)
add("load_total_revenue", lambda t: quality.load_total_revenue(orders_audit(t).cleaned()))
add("constraint_violations", constraint_violations)


# Sources and sinks: each writes into a folder of its own below the shared one
def _fresh(t: Star, what: str) -> str:
    return f"{shared_folder(t.spark)}/{what}-{uuid.uuid4().hex}"


def _loaded(t: Star) -> tuple[quality.StarAudit, str, DataFrame]:
    folder = _fresh(t, "cleaned")
    audit = writers.judge(star_audit(t), f"{folder}/judged")
    tables = {a.table: a.cleaned() for a in audit}
    return audit, folder, writers.append_cleaned(t.spark, tables, folder)


def read_star(t: Star) -> DataFrame:
    """Raw tables written as CSV and read back: values present and a checksum of their texts, per column."""
    folder = _fresh(t, "raw")
    writers.write_csv_star({n: df.select(*RAW[n].names) for n, df in _raw_tables(t).items()}, folder)
    tables = readers.read_star(t.spark, folder)
    parts = []
    for n, df in tables.items():
        texts = {c: F.col(c).cast("string") for c in RAW[n].names} | {"unreadable": F.when(F.size("unreadable") > 0, F.lit("yes"))}
        cells = df.agg(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.count(x).alias("present"), F.coalesce(F.sum(_digest(x)), F.lit(0)).alias("checksum"))
            for c, x in texts.items()]).alias("cells"))
        # Counted apart, so that only the places are shuffled, without the sums of every column beside each.
        cells = cells.withColumn("places", df.agg(F.countDistinct("seq")).scalar())
        parts.append(cells.select("places", F.explode("cells").alias("c")).select(F.lit(n).alias("table_name"), "places", "c.*"))
    return _union(parts)


def _digest(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def read_cleaned(t: Star) -> DataFrame:
    folder = _fresh(t, "cleaned")
    audit = customers_audit(t)
    writers.publish({"customers": audit.cleaned()}, folder)
    return readers.read_cleaned(t.spark, folder, "customers")


def append_cleaned(t: Star) -> DataFrame:
    """Loads twice; the second load finds every key stored and adds nothing."""
    audit, folder, _ = _loaded(t)
    stored = {a.table: readers.read_cleaned(t.spark, folder, a.table) for a in audit}
    return writers.append_cleaned(t.spark, stored, folder)


def load_reconcile(t: Star) -> DataFrame:
    audit, folder, _ = _loaded(t)
    return quality.load_reconcile({a.table: a.cleaned() for a in audit},
                                  {a.table: readers.read_cleaned(t.spark, folder, a.table) for a in audit})


def write_quality_outputs(t: Star) -> DataFrame:
    out = writers.write_quality_outputs(t.spark, star_audit(t), _fresh(t, "quality"))
    return _union([df.agg(F.lit(n).alias("dataset"), F.count("*").alias("stored_rows")) for n, df in out.items()])


def _upload(t: Star) -> str:
    folder = _fresh(t, "upload")
    writers.write_csv_star({"orders": raw.raw_orders(t).select(*RAW["orders"].names)}, folder)
    return f"{folder}/orders.csv"


def profile_upload(t: Star) -> DataFrame:
    return readers.profile_upload(t.spark, _upload(t))


def preview_upload(t: Star) -> DataFrame:
    """How many rows and columns the preview shows, and whether each shown row is one of the upload."""
    path = _upload(t)
    shown = readers.preview_upload(t.spark, path)
    known = shown.join(raw.raw_orders(t).select("order_id"), "order_id", "left_semi")
    return shown.agg(F.count("*").alias("shown_rows"), F.lit(len(shown.columns)).cast("bigint").alias("shown_columns"),
                     known.agg(F.count("*").alias("n")).scalar().alias("known_rows"))


add("read_star", read_star)
add("read_cleaned", read_cleaned)
add("append_cleaned", append_cleaned)
add("load_reconcile", load_reconcile)
add("write_quality_outputs", write_quality_outputs)
add("profile_upload", profile_upload)
add("preview_upload", preview_upload)


# KPI measures, by region and month unless named otherwise
KPI_COLUMNS = {
    "total_revenue": ["revenue"], "total_profit": ["profit"], "total_orders": [], "total_customers": ["customer_id"],
    "avg_order_value": ["revenue"], "profit_margin": ["revenue", "profit"], "return_rate": ["return_status"],
    "cancellation_rate": ["return_status"], "clv": ["revenue", "customer_id"], "avg_delivery_days": ["delivery_days"],
    "returning_customers": ["customer_id"], "retention_rate": ["customer_id"],
}
CATEGORY_KPIS = ["total_revenue", "total_profit", "total_orders", "total_customers", "avg_order_value", "profit_margin",
                 "return_rate", "cancellation_rate", "clv", "avg_delivery_days"]


def _kpi(measure: str) -> Callable[[Star], DataFrame]:
    def build(t: Star) -> DataFrame:
        if "profit" in KPI_COLUMNS[measure]:
            cells = _cells(t, "region", "order_date").withColumnRenamed("order_date", "month")
            return measures.kpis(cells, ["region", "month"], [measure])
        fact = t.sales("region", "order_date", *KPI_COLUMNS[measure])
        return measures.kpis(fact.withColumn("month", F.trunc("order_date", "month")), ["region", "month"], [measure])
    return build


def kpi_all_by_category(t: Star) -> DataFrame:
    fact = t.sales("product_id", "customer_id", "revenue", "profit", "return_status", "delivery_days")
    fact = fact.join(t.products().select("product_id", "category"), "product_id")
    return measures.kpis(fact, ["category"], CATEGORY_KPIS)


def _profit_by_month(t: Star) -> DataFrame:
    daily = products.profit_cells(t.sales(*PRODUCT_FACT, "order_date"), t.products(), ["order_date"])
    return measures.prior_month(daily, "profit")


for _name in KPI_COLUMNS:
    add(f"kpi_{_name}", _kpi(_name))
add("kpi_all_by_category", kpi_all_by_category)
add("kpi_churn_rate_90", lambda t: measures.churn_rate_90(t.sales("region", "customer_id", "order_date"), ["region"]))
add("date_table", lambda t: measures.date_table(t.sales("order_date")))
add("kpi_revenue_mom_growth", lambda t: measures.prior_month(t.sales("order_date", "revenue"), "revenue"))
add("kpi_profit_mom_growth", lambda t: _profit_by_month(t))
add("kpi_revenue_mom_growth_by_region", lambda t: measures.prior_month(t.sales("region", "order_date", "revenue"), "revenue", ["region"]))
add("kpi_revenue_prior_month", lambda t: measures.prior_month(t.sales("order_date", "revenue"), "revenue").drop(
    "revenue_mom_growth"))
add("kpi_profit_prior_month", lambda t: _profit_by_month(t).drop("profit_mom_growth"))
add("kpi_new_customers", lambda t: measures.new_customers(t.sales("order_date"), t.customers()))
add("kpi_new_customers_by_region", lambda t: measures.new_customers(t.sales("order_date"), t.customers(), ["region"]))
add("revenue_rank", lambda t: measures.revenue_rank(t.sales("product_id", "revenue"), t.products()).drop("top10_flag"))
add("top10_flag", lambda t: measures.revenue_rank(t.sales("product_id", "revenue"), t.products()).select(
    "product_name", "top10_flag"))


# Segments
RFM_FACT = ("customer_id", "order_date", "revenue")


def _segments(t: Star) -> DataFrame:
    return segments.rfm_segments(segments.rfm_scores(segments.rfm_base(t.sales(*RFM_FACT), t.customers())))


def _segmented_customers(t: Star) -> DataFrame:
    return segments.apply_segments(t.customers(), _segments(t))


add("rfm_base", lambda t: segments.rfm_base(t.sales(*RFM_FACT), t.customers()))
add("rfm_scores", lambda t: segments.rfm_scores(segments.rfm_base(t.sales(*RFM_FACT), t.customers())))
add("rfm_segments", _segments)
add("segment_profile", lambda t: segments.segment_profile(_segments(t)))
add("segment_counts", lambda t: segments.segment_counts(_segments(t)))
add("apply_segments", _segmented_customers)


# Churn
def _features(t: Star) -> DataFrame:
    return churn.churn_features(t.sales("customer_id", "order_date", "revenue", "return_status"), t.customers())


def churn_preprocess(t: Star) -> DataFrame:
    matrix = churn.churn_preprocess(_stored_features(t))
    columns = [f"z_{c}" for c in churn.NUMERIC] + [f"region_{r.lower().replace(' ', '_')}" for r in REGIONS]
    return matrix.select("customer_id", *[F.round(F.col("features")[i], 4).alias(c) for i, c in enumerate(columns)])


_TRAINED: dict[tuple, tuple[str, churn.ChurnModels]] = {}


def _trained(t: Star) -> tuple[str, churn.ChurnModels]:
    """Stored features and the models fitted on them; they are fitted again whenever the features are others."""
    folder = _fresh(t, "churn")
    features = writers.stage(_features(t), f"{folder}/churn_features")
    content = F.xxhash64(*features.columns)
    key = (t.spark.sparkContext.applicationId, *features.agg(F.count("*"), F.bit_xor(content), F.sum(content % 1_000_003)).first())
    if key not in _TRAINED:
        _TRAINED[key] = folder, churn.train(features, f"{folder}/churn_split")
    return _TRAINED[key]


def _stored_features(t: Star) -> DataFrame:
    return writers.stage(_features(t), f"{_fresh(t, 'churn')}/churn_features")


def _predictions(t: Star) -> DataFrame:
    folder, trained = _trained(t)
    return churn.churn_score(trained.model, t.spark.read.parquet(f"{folder}/churn_features"))


def _held_out(t: Star, name: str) -> DataFrame:
    """Predictions of one fitted model for the customers it was not fitted on."""
    folder, trained = _trained(t)
    held_out = churn.churn_split(t.spark.read.parquet(f"{folder}/churn_features")).where("is_test")
    return churn.churn_score(trained.models[name], held_out)


def risk_category(t: Star) -> DataFrame:
    """Every scored customer: whether the probability is one, and whether the band is the one it falls in."""
    p = F.col("churn_probability")
    low, medium = p < churn.LOW_RISK_BELOW, p < churn.MEDIUM_RISK_BELOW
    band = F.concat(F.when(low, "Low").when(medium, "Medium").otherwise("High"), F.lit(" Risk"))
    return _predictions(t).select("customer_id", "region", p.between(0, 1).alias("in_range"), (F.col("risk_category") == band).alias("band_agrees"))


def churn_held_out(t: Star) -> DataFrame:
    """Customers of each label that the models were judged on: the row sums of their confusion matrices."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("churned"), F.aggregate(
        F.col("confusion_matrix")[i], F.lit(0).cast("bigint"), lambda a, n: a + n).alias("customers")) for i in (0, 1)]))
    return _trained(t)[1].metrics.select("model", rows.alias("r")).select("model", "r.*")


def churn_io_agrees(t: Star) -> DataFrame:
    """Customers whose saved and loaded model gives the score it gave before."""
    before = _predictions(t).select("customer_id", F.col("churn_probability").alias("before"))
    after = churn_model_io(t).select("customer_id", "churn_probability")
    return before.join(after, "customer_id").select("customer_id", (F.col("before") == F.col("churn_probability")).alias("same"))


def churn_evaluate(t: Star) -> DataFrame:
    metrics = _trained(t)[1].metrics
    cells = F.flatten("confusion_matrix")
    return metrics.select("model", "accuracy", "precision", "recall", "f1_score", "roc_auc",
                          *[cells[i].alias(n) for i, n in enumerate(("tn", "fp", "fn", "tp"))])


def churn_select(t: Star) -> DataFrame:
    trained = _trained(t)[1]
    return trained.metrics.where(F.col("model") == trained.selected).select(F.col("model").alias("selected_model"), "roc_auc")


def churn_feature_impact(t: Star) -> DataFrame:
    folder, trained = _trained(t)
    return churn.churn_feature_impact(trained.model, t.spark.read.parquet(f"{folder}/churn_features"))


def churn_model_io(t: Star) -> DataFrame:
    """Saved and loaded again, the model scores every customer as before."""
    folder, trained = _trained(t)
    path = f"{_fresh(t, 'model')}/churn_model"
    churn.save_model(trained.model, path)
    return churn.churn_score(churn.load_model(path), t.spark.read.parquet(f"{folder}/churn_features"))


def write_ml_outputs(t: Star) -> DataFrame:
    folder = _fresh(t, "results")
    cells = _stored_cells(t)
    writers.publish({"churn_features": _features(t), "customer_segments": _segments(t),
                     "daily_metrics": anomalies.daily_metrics(cells, t.customers())}, folder)
    writers.publish({"segment_profile": segments.segment_profile(t.spark.read.parquet(f"{folder}/customer_segments")),
                     "anomalies": _anomalies(t, cells)}, folder)
    return writers.stored_rows(t.spark, folder, [
        "churn_features", "customer_segments", "segment_profile", "daily_metrics", "anomalies"])


add("churn_features", _features)
add("churn_balance", lambda t: churn.churn_balance(_features(t)))
add("feature_summary", lambda t: churn.feature_summary(_features(t)))
add("churn_split", lambda t: churn.churn_split(_stored_features(t)).select("customer_id", "churned", "is_test"))
add("churn_preprocess", churn_preprocess)
add("churn_logistic", lambda t: _held_out(t, churn.LOGISTIC))
add("churn_forest", lambda t: _held_out(t, churn.FOREST))
add("churn_evaluate", churn_evaluate)
add("churn_select", churn_select)
add("churn_feature_impact", churn_feature_impact)
add("churn_score", _predictions)
add("risk_category", risk_category)
add("risk_counts", lambda t: churn.risk_counts(_predictions(t)))
add("risk_filter", lambda t: churn.risk_filter(_predictions(t), ["High Risk", "Medium Risk"]))
add("churn_model_io", churn_model_io)
add("churn_held_out", churn_held_out)
add("churn_io_agrees", churn_io_agrees)
add("churn_feature_names", lambda t: churn_feature_impact(t).select("feature"))
add("risk_total", lambda t: churn.risk_counts(_predictions(t)).agg(F.sum("customers").alias("customers")))


# Anomalies
def _daily(t: Star) -> DataFrame:
    fact = t.sales(*PRODUCT_FACT, "order_date", "return_status")
    cells = products.named_cells(fact, t.products(), [], ["revenue", "profit", "orders", "returned"], ["order_date"], "left")
    return anomalies.daily_metrics(cells, t.customers())


def _daily_cells(t: Star) -> DataFrame:
    return anomalies.daily_cells(t.sales(*PRODUCT_FACT, "order_date", "region", "return_status"), t.products())


def _stored_cells(t: Star) -> DataFrame:
    """One scan of the fact for daily metrics and contributors."""
    return writers.stage(_daily_cells(t), f"{_fresh(t, 'cells')}/daily_cells")


def daily_cells(t: Star) -> DataFrame:
    """The cube as the batch stores it, by months."""
    folder = _fresh(t, "cube")
    cube.write(_daily_cells(t), folder)
    return cube.read(t.spark, folder)


def _anomalies(t: Star, cells: DataFrame | None = None) -> DataFrame:
    cells = cells if cells is not None else _stored_cells(t)
    return anomalies.detect_anomalies(anomalies.daily_metrics(cells, t.customers()), cells, t.products())


def anomaly_contributors(t: Star) -> DataFrame:
    lines = t.sales("order_date", "region", "product_id", "revenue")
    return anomalies.anomaly_contributors(measures.date_table(t.sales("order_date")), lines, t.products())


add("daily_cells", daily_cells)
add("daily_metrics", _daily)
add("rolling_zscore", lambda t: anomalies.rolling_zscore(_daily(t)))
add("rolling_mean", lambda t: anomalies.rolling_mean(_daily(t)))
add("iqr_flags", lambda t: anomalies.iqr_flags(_daily(t)))
add("detect_anomalies", _anomalies)
add("anomaly_contributors", anomaly_contributors)
add("anomaly_counts", lambda t: anomalies.anomaly_counts(_anomalies(t)))
add("recent_anomalies", lambda t: anomalies.recent_anomalies(_anomalies(t)))
add("anomaly_filter", lambda t: anomalies.anomaly_filter(_anomalies(t), "profit"))
add("write_ml_outputs", write_ml_outputs)


# Root cause between two months
PERIOD_A, PERIOD_B = "1997-03", "1997-04"
FIRST, LAST = rootcause.month_bounds(PERIOD_A)[0], rootcause.month_bounds(PERIOD_B)[1]


def _period_fact(t: Star, metric: str) -> DataFrame:
    amounts = ("revenue", "quantity") if metric == "profit" else (metric,)
    return t.sales("order_date", "product_id", "region", "payment_method", "return_status", *amounts, start=FIRST, end=LAST)


def _contributors(t: Star, metric: str = "revenue") -> DataFrame:
    return rootcause.compare_periods(_period_fact(t, metric), t.products(), PERIOD_A, PERIOD_B, metric)


def _breakdown(t: Star, dimension: str) -> DataFrame:
    start, end = rootcause.month_bounds(PERIOD_A)
    key = "product_id" if dimension == "category" else dimension
    return rootcause.period_breakdown(t.sales("order_date", key, "revenue", start=start, end=end), t.products(),
                                      start, end, dimension)


def period_total(t: Star) -> DataFrame:
    start, end = rootcause.month_bounds(PERIOD_A)
    return rootcause.period_total(t.sales("order_date", "revenue", start=start, end=end), start, end)


add("month_bounds", lambda t: rootcause.month_table(t.sales("order_date")))
add("period_total", period_total)
add("period_breakdown", lambda t: _breakdown(t, "region"))
add("period_breakdown_category", lambda t: _breakdown(t, "category"))
add("compare_periods", _contributors)
add("compare_periods_profit", lambda t: _contributors(t, "profit"))
add("compare_totals", lambda t: rootcause.compare_totals(
    t.sales("order_date", "revenue", start=FIRST, end=LAST), PERIOD_A, PERIOD_B))
add("top_negative_contributors", lambda t: rootcause.top_negative_contributors(_contributors(t)))
add("top_positive_contributors", lambda t: rootcause.top_positive_contributors(_contributors(t)))
add("auto_periods", lambda t: rootcause.auto_periods(t.sales("order_date")))


# Recommendation rules
def recommendation_cards(t: Star) -> DataFrame:
    """The fact is read for two stored intermediates, a monthly summary and the segments, and not again per rule."""
    folder = _fresh(t, "cards")
    fact = t.sales(*PRODUCT_FACT, "order_date", "region", "delivery_days", "return_status")
    summary = writers.stage(products.monthly_summary(fact, t.products()), f"{folder}/summary")
    members = writers.stage(_segments(t), f"{folder}/segments")
    spending = members.select("customer_id", F.col("monetary").alias("revenue"))
    return advice.recommendation_cards(summary, t.products(), members, spending)


add("rec_at_risk_customers", lambda t: advice.rec_at_risk_customers(t.sales("customer_id", "revenue"), _segments(t)))
add("rec_unprofitable_products", lambda t: advice.rec_unprofitable_products(t.sales(*PRODUCT_FACT), t.products()))
add("rec_regional_decline", lambda t: advice.rec_regional_decline(
    t.sales("product_id", "region", "order_date", "revenue"), t.products()))
add("rec_high_return_category", lambda t: advice.rec_high_return_category(
    t.sales("product_id", "return_status"), t.products()))
add("rec_slow_delivery_region", lambda t: advice.rec_slow_delivery_region(t.sales("region", "delivery_days")))
add("recommendation_cards", recommendation_cards)


# Questions
GUARDED = "SELECT region, payment_method, COUNT(*) AS orders, SUM(revenue) AS revenue FROM {sales} GROUP BY 1, 2"


def answer_questions(t: Star) -> DataFrame:
    folder = _fresh(t, "answers")
    fact = t.sales(*PRODUCT_FACT, "order_date", "region")
    summary = writers.stage(products.monthly_summary(fact, t.products(), ["revenue", "profit", "orders"]), f"{folder}/summary")
    members = writers.stage(_segmented_customers(t), f"{folder}/customers")
    answered = questions.answer_questions(raw.questions(t), summary, t.products(), members)
    return answered.select("conv_id", "turn", "intent", "answer", F.array_join("evidence", " | ").alias("evidence"),
                           "explanation", "recommendation", "confidence", "note")


add("sql_is_safe", lambda t: raw.statements(t).select(
    "conv_id", "turn", questions.sql_is_safe(F.col("statement")).alias("safe")))
add("guarded_query", lambda t: questions.guarded_query(
    t.spark, GUARDED, sales=t.sales("region", "payment_method", "revenue")))
add("classify_questions", lambda t: questions.classify_questions(raw.questions(t)))
add("answer_best_sellers", lambda t: questions.answer_best_sellers(t.sales("product_id", "revenue"), t.products()))
add("answer_worst_region", lambda t: questions.answer_worst_region(_cells(t, "region")))
add("answer_losing_products", lambda t: questions.answer_losing_products(t.sales(*PRODUCT_FACT), t.products()))
add("answer_churn_risk", lambda t: questions.answer_churn_risk(_segmented_customers(t)))
add("answer_mom", lambda t: questions.answer_mom(_cells(t, "order_date")))
add("answer_questions", answer_questions)
