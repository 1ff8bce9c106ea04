"""A stored daily cube of the fact, brought up to date month by month.

One cell per day, region and category with sums that can be summed further: its size
follows the calendar and the names there are, not the number of orders.  Daily metrics
and what explains an anomaly read the cube, so the fact is scanned once for both.

The cube lies in partitions by month.  Each refresh finds the batches of the store that
the cube has not seen, computes the months they touch anew from the store, and replaces
just those partitions.  It then writes down the batches.  A refresh that was stopped
before that is repeated with the same result; one that adds twice is not possible.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import anomalies
from ..sources import readers

MONTH = "order_month"


def refresh(spark: SparkSession, store: str, folder: str) -> list:
    """Brings the cube in `folder` up to the batches of `store`; the months that were written (a list no longer than the calendar)."""
    known = _seen(spark, folder)
    batches = [b for b in readers.stored_batches(spark, store) or [] if b not in known]
    if not batches:
        return []
    # Months are partitions: these reads open no column.
    arrived = readers.read_stored(spark, store, "orders").where(F.col("batch").isin(batches))
    months = sorted(r[0] for r in arrived.select(MONTH).distinct().collect() if r[0] is not None)
    if months:
        fact = readers.read_stored(spark, store, "orders").where(F.col(MONTH).isin(months))
        write(anomalies.daily_cells(fact, readers.read_cleaned(spark, store, "products")), folder)
    spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("append").parquet(f"{folder}/seen")
    return months


def write(cells: DataFrame, folder: str) -> None:
    """Replaces the months that the cells have, and no other."""
    placed = cells.withColumn(MONTH, F.trunc("order_date", "month")).hint("rebalance", MONTH)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{folder}/cells")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(anomalies.CELLS).parquet(f"{folder}/cells").drop(MONTH)


def _seen(spark: SparkSession, folder: str) -> set[str]:
    try:
        return {r["batch"] for r in spark.read.schema("batch string").parquet(f"{folder}/seen").collect()}
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing.getCondition()):
            return set()
        raise
