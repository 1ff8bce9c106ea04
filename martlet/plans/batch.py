"""The whole batch: raw files in, audited store, derived tables and reports out.

Stages meet only in written tables below one output folder.  A stage that is
run again after a failure reads what the one before it stored; nothing is held
in executor memory from stage to stage.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import advice, anomalies, churn, products as pr, quality, segments as sg
from ..sources import readers, writers
from . import cube
from .session import prepare


def load(spark: SparkSession, raw_folder: str, out: str, as_of: date, regions: list[str]) -> DataFrame:
    """Audits the raw files, keeps every trace of the audit, appends what is valid to the store.

    Returns per table the rows of this batch, how many of them the store now holds as
    they are, and OK or MISMATCH; for the orders also the stored lines without their
    customer or product, and the stored revenue.
    """
    raw = readers.read_star(spark, raw_folder)
    audit = quality.audit_star(raw["customers"], raw["products"], raw["orders"], as_of, regions)
    outputs = writers.write_quality_outputs(spark, audit, f"{out}/quality")
    clean = {name: outputs[f"cleaned/{name}"] for name in ("customers", "products", "orders")}
    writers.append_cleaned(spark, clean, f"{out}/store")
    stored = {name: readers.read_cleaned(spark, f"{out}/store", name) for name in clean}
    distinct = {name: df.distinct() for name, df in clean.items()}
    held = {name: stored[name].join(df.select(F.xxhash64(*df.columns).alias("content")), F.xxhash64(*df.columns) == F.col("content"), "left_semi")
            for name, df in distinct.items()}
    orphans = quality.orphan_orders(stored["orders"], stored["customers"], stored["products"]).agg(F.sum("orphans"))
    revenue = quality.load_total_revenue(stored["orders"])
    of_orders = F.col("table_name") == "orders"
    return quality.load_reconcile(distinct, held).select(
        "*", F.when(of_orders, orphans.scalar()).alias("orphans"), F.when(of_orders, revenue.scalar()).alias("total_revenue"))


def derive(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Segments, churn model and scores, daily metrics, anomalies and recommendation cards, from the store."""
    customers, products, sales = (readers.read_cleaned(spark, f"{out}/store", n) for n in ("customers", "products", "orders"))
    results = f"{out}/results"

    segments = writers.stage(sg.rfm_segments(sg.rfm_scores(sg.rfm_base(sales, customers))), f"{results}/customer_segments")
    features = writers.stage(churn.churn_features(sales, customers), f"{results}/churn_features")
    cube.refresh(spark, f"{out}/store", f"{out}/cube")
    cells = cube.read(spark, f"{out}/cube")
    daily = writers.stage(anomalies.daily_metrics(cells, customers), f"{results}/daily_metrics")
    summary = writers.stage(pr.monthly_summary(sales, products), f"{results}/monthly_summary")
    spending = segments.select("customer_id", F.col("monetary").alias("revenue"))
    writers.publish({
        "segment_profile": sg.segment_profile(segments),
        "anomalies": anomalies.detect_anomalies(daily, cells, products),
    }, results)
    # The store's customers with their segments: what reads the store finds them there.
    writers.publish({"customers_segmented": sg.apply_segments(customers, segments)}, f"{out}/store")
    writers.publish({"recommendations": advice.recommendation_cards(summary, products, segments, spending)}, results, "json")

    trained = churn.train(features, f"{results}/churn_split")
    churn.save_model(trained.model, f"{results}/churn_model")
    writers.publish({"churn_predictions": churn.churn_score(trained.model, features),
                     "churn_feature_impact": churn.churn_feature_impact(trained.model, features)}, results)
    writers.publish({"churn_metrics": trained.metrics.withColumn("selected", F.col("model") == trained.selected)}, results, "json")

    tables = ["customer_segments", "churn_features", "daily_metrics", "monthly_summary",
              "segment_profile", "anomalies", "churn_predictions", "churn_feature_impact"]
    found = {name: spark.read.parquet(f"{results}/{name}") for name in tables}
    found["customers_segmented"] = readers.read_segmented(spark, f"{out}/store")
    return {**found, **{name: spark.read.json(f"{results}/{name}") for name in ("recommendations", "churn_metrics")}}


def run(spark: SparkSession, raw_folder: str, out: str, as_of: date,
        regions: list[str] = quality.VALID_REGIONS) -> tuple[DataFrame, dict[str, DataFrame]]:
    prepare(spark)
    check = load(spark, raw_folder, out, as_of, regions)
    return check, derive(spark, out)
