"""Sinks: raw and cleaned tables, audit trail, published results."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.quality import Audit, StarAudit, with_overall_score
from .readers import read_stored, stored_batches
from .schemas import KEYS, STAR


# Text is written as it stands: white space kept, quotes doubled, line breaks in quotes.
WRITTEN_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv_star(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").options(**WRITTEN_CSV).csv(f"{folder}/{name}.csv")


def append_cleaned(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Adds customers, products and orders as one batch, so that a key stands for one row in the store.

    A row that is stored already as it is, or comes several times alike, is taken
    once.  Conflicts are kept out of the store and recorded (`conflicts`): keys that
    the batch has with different contents, and keys whose stored row differs from the
    batch's.

    All that a batch writes lies in folders of its own, which nobody reads until its
    last write, one row in `_batches`, names it: a batch is stored in whole or not at
    all, and one that was stopped is simply loaded again.  Beside the rows a batch
    keeps its keys with a hash of each row's content, sorted by key.  What is stored is
    looked up there, between the least and the greatest key that come, so that files of
    other keys are passed over by their statistics and no stored row is read.  Orders
    are partitioned by month; the rebalance hint lets AQE cut an overfull month into
    several files and join small ones.  Returns the rows now stored and the conflicting
    keys of this batch per table, read back from storage.
    """
    batch = uuid.uuid4().hex
    for name in ("customers", "products", "orders"):
        path, key = f"{folder}/{name}/batch={batch}", KEYS[name]
        columns = tables[name].columns
        df = tables[name].withColumn("__content", F.xxhash64(*columns))
        # One narrow row per key decides; full rows meet only these decisions.
        per_key = stage(df.groupBy(F.col(key).alias("__key")).agg(F.min("__content").alias("lo"), F.max("__content").alias("hi")),
                        f"{folder}/_verdicts/{batch}/{name}/keys")
        held = stored_keys(spark, folder, name, *per_key.agg(F.min("__key"), F.max("__key")).first())
        if held is not None:
            per_key = per_key.join(held.select(F.col("row_key").alias("__held"), F.col("content").alias("held")), F.col("__key").eqNullSafe(F.col("__held")), "left").drop("__held")
        else:
            per_key = per_key.withColumn("held", F.lit(None).cast("bigint"))
        kind = F.when(F.col("lo") != F.col("hi"), "differs_in_batch").when(F.col("held") != F.col("lo"), "differs_from_store")
        verdicts = stage(per_key.select("__key", F.col("lo").alias("content"), kind.alias("kind"), F.col("held").isNotNull().alias("known")),
                         f"{folder}/_verdicts/{batch}/{name}/decided")
        verdicts.where("kind IS NOT NULL").select(
            F.lit(name).alias("table_name"), F.col("__key").cast("string").alias("row_key"), "kind").write.mode("append").parquet(f"{folder}/_conflicts/batch={batch}")
        new = verdicts.where("kind IS NULL AND NOT known").select(F.col("__key").alias("row_key"), "content")
        new.repartitionByRange("row_key").sortWithinPartitions("row_key").write.parquet(f"{folder}/_keys/{name}/batch={batch}")
        refused = verdicts.where("kind IS NOT NULL OR known").select("__key")
        df = df.join(refused, df[key].eqNullSafe(refused["__key"]), "left_anti").dropDuplicates([key]).select(*columns)
        if name == "orders":
            df = df.withColumn("order_month", F.trunc("order_date", "month")).hint("rebalance", "order_month")
            df.write.partitionBy("order_month").parquet(path)
        else:
            df.write.parquet(path)
    # From here on the batch counts.
    spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("stored_at")).write.mode("append").parquet(f"{folder}/_batches")
    clashes = conflicts(spark, folder).where(F.col("batch") == batch)
    counts = [
        read_stored(spark, folder, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("stored_rows")).withColumn(
            "conflicts", clashes.where(F.col("table_name") == name).agg(F.count("*").alias("n")).scalar())
        for name in ("customers", "products", "orders")
    ]
    return reduce(DataFrame.unionByName, counts)


def stored_keys(spark: SparkSession, folder: str, table: str, least, greatest) -> DataFrame | None:
    """row_key and content hash of the stored rows whose key lies in a range (null keys always); None while nothing is stored."""
    batches = stored_batches(spark, folder)
    if not batches:
        return None
    places = [f"{folder}/_keys/{table}/batch={b}" for b in batches]
    kind = STAR[table][KEYS[table]].dataType.simpleString()
    keys = spark.read.schema(f"row_key {kind}, content bigint").parquet(*places)
    between = F.col("row_key").between(least, greatest) if least is not None else F.lit(False)
    return keys.where(between | F.col("row_key").isNull())


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """batch, table_name, row_key and kind of every key that was kept out of the store."""
    places = [f"{folder}/_conflicts/batch={b}" for b in stored_batches(spark, folder) or []]
    found = spark.read.schema("table_name string, row_key string, kind string").option("basePath", f"{folder}/_conflicts").parquet(*places)
    return found.select("batch", "table_name", "row_key", "kind")


def judge(audit: StarAudit, folder: str) -> StarAudit:
    """The audit with every table's judged rows written once, and its counters taken on that write.

    Orders are judged against the stored customers and products, so no check runs
    twice.  The counters stand where the rows leave for the files: the metric of a
    task counts once, whatever is tried again.
    """
    def stored(part: Audit) -> Audit:
        metrics = Observation()
        rows = stage(part.rows.observe(metrics, *part.counters()), f"{folder}/{part.table}")
        counts = {name: int(n) for name, n in metrics.get.items()}
        counted = rows.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"`{name}` bigint" for name in counts))
        return replace(part, rows=rows, counted=counted)

    customers, products = stored(audit.customers), stored(audit.products)
    orders = stored(audit.judge_orders(customers.cleaned(), products.cleaned(), lambda df, what: stage(df, f"{folder}/orders_{what}")))
    return replace(audit, customers=customers, products=products, orders=orders)


def write_quality_outputs(spark: SparkSession, audit: StarAudit, folder: str) -> dict[str, DataFrame]:
    """Cleaned and rejected rows, change log and report, each as a dataset.

    The checks of a table run once (`judge`); all outputs are narrow reads of the
    judged rows, so a lost executor costs a re-read, not a second audit.
    """
    judged = judge(audit, f"{folder}/judged")
    for part in judged:
        part.cleaned().write.mode("overwrite").parquet(f"{folder}/cleaned/{part.table}")
        part.rejected().write.mode("overwrite").parquet(f"{folder}/rejected/{part.table}")
    logs, reports = [part.log() for part in judged], [part.report() for part in judged]
    reduce(DataFrame.unionByName, logs).write.mode("overwrite").parquet(f"{folder}/transformation_log")
    report = with_overall_score(reduce(DataFrame.unionByName, reports))
    report.write.mode("overwrite").json(f"{folder}/quality_report")
    names = [f"{kind}/{part.table}" for part in audit for kind in ("cleaned", "rejected")] + ["transformation_log"]
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    out["quality_report"] = spark.read.schema(report.schema).json(f"{folder}/quality_report")
    return out


def publish(frames: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Writes each result as a dataset of its own."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes an intermediate result once and returns a read of it, so that its plan ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_rows(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    counts = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("dataset"), F.count("*").alias("stored_rows"))
              for n in names]
    return reduce(DataFrame.unionByName, counts)
