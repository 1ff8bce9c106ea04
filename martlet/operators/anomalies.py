"""Daily metrics and the days on which they misbehave.

The fact is reduced to days first; everything after works on one row per day
and metric, so windows per metric are as long as the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exact
from .products import named_cells, sums

# Window, thresholds, metric names and texts.
WINDOW = 14
Z_THRESHOLD = 2.5
METRICS = ["revenue", "profit", "orders", "returns", "new_customers"]
EXPLAINED = ["revenue", "profit"]
NO_ORDERS = "no orders that day"
CONTRIBUTORS = 3

_AMOUNT = "decimal(24,2)"
CELLS = "order_date date, region string, category string, revenue decimal(24,2), profit decimal(24,2), orders bigint, returned bigint"


def daily_cells(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, profit, orders and returned orders per day, region and category.

    Daily metrics and contributors can read these cells instead of order lines.  Lines
    of unknown products have no category and no profit; they count in the rest.  Lines
    without a day are left out.
    """
    measures = ["revenue", "profit", "orders", "returned"]
    named = named_cells(sales.where(F.col("order_date").isNotNull()), products, ["category"], measures, ["order_date", "region"], "left")
    kinds = {"revenue": _AMOUNT, "profit": _AMOUNT, "orders": "bigint", "returned": "bigint"}
    return named.groupBy("order_date", "region", "category").agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in measures])


def daily_metrics(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per calendar day from the first to the last order; days without orders are 0."""
    daily = sales.groupBy("order_date").agg(
        *sums(sales, ["revenue", "profit", "orders"]), *[c.alias("returns") for c in sums(sales, ["returned"])]).where(F.col("order_date").isNotNull())
    # A day with orders is followed by its gap days, up to the next day with orders.
    following = F.lead("order_date").over(Window.orderBy("order_date"))
    last_gap_day = F.coalesce(F.date_sub("next", 1), F.col("order_date"))
    filled = (
        daily.withColumn("next", following)
        .withColumn("date", F.explode(F.sequence("order_date", last_gap_day)))
        .select("date", *[F.when(F.col("date") == F.col("order_date"), F.col(m)).otherwise(0).alias(m)
                          for m in METRICS[:4]])
    )
    signups = customers.groupBy(F.col("signup_date").alias("date")).agg(F.count("*").alias("new_customers"))
    return filled.join(signups, "date", "left").select(
        "date", *METRICS[:4], F.coalesce("new_customers", F.lit(0)).alias("new_customers"))


def _long(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric and day, the value also in whole hundredths."""
    typed = daily.select("date", *[F.col(m).cast(_AMOUNT).alias(m) for m in metrics])
    return typed.unpivot("date", metrics, "metric", "value").withColumn("units", exact.cents(F.col("value")))


def rolling(daily: DataFrame, metrics: list[str] = METRICS, window: int = WINDOW) -> DataFrame:
    """Trailing mean and z-score per metric and day, the day itself included.

    Both are null while fewer than half a window of days is there; the z-score
    also where the values do not vary.  Sums of squares are whole numbers.
    """
    trailing = Window.partitionBy("metric").orderBy("date").rowsBetween(1 - window, 0)
    v = F.col("units")
    sums = _long(daily, metrics).select(
        "metric", "date", "value", "units", exact.whole(F.count("*").over(trailing)).alias("n"),
        F.sum("units").over(trailing).alias("s"), F.sum(v * v).over(trailing).alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    enough = n >= window // 2
    spread = (n * (n * q - s * s)).cast("double") / (n - 1).cast("double")
    z = (n * v - s).cast("double") / F.sqrt(F.when(spread > 0, spread))
    return sums.select(
        "metric", "date", "value", "units",
        F.when(enough, exact.half_up(s, n).cast("double") / 100).alias("expected_value"),
        F.when(enough & (n > 1), z).alias("z_score"))


def rolling_mean(daily: DataFrame, metrics: list[str] = METRICS, window: int = WINDOW) -> DataFrame:
    return rolling(daily, metrics, window).select("metric", "date", "value", "expected_value")


def rolling_zscore(daily: DataFrame, metrics: list[str] = METRICS, window: int = WINDOW) -> DataFrame:
    return rolling(daily, metrics, window).select("metric", "date", "value", F.round("z_score", 2).alias("z_score"))


def _fences(long: DataFrame, whisker: str) -> DataFrame:
    """Tukey's bounds per metric, in quarters of a unit, by position in the sorted series."""
    placed = long.select(
        "metric", "units", (F.row_number().over(Window.partitionBy("metric").orderBy("units")) - 1).alias("i"),
        F.count("*").over(Window.partitionBy("metric")).alias("n"))

    def quartile(k: int) -> Column:
        spread = (F.col("n") - 1) * k
        low = exact.int_div(spread, F.lit(4))
        a = F.max(F.when(F.col("i") == low, F.col("units")))
        b = F.max(F.when(F.col("i") == F.least(low + 1, F.col("n") - 1), F.col("units")))
        return a * 4 + (b - a) * F.max(spread % 4)

    quartiles = placed.groupBy("metric").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * F.lit(whisker).cast("decimal(4,2)")
    return quartiles.select("metric", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def iqr_flags(daily: DataFrame, metrics: list[str] = METRICS, whisker: str = "1.5") -> DataFrame:
    long = _long(daily, metrics)
    quarter = F.col("units") * 4
    return long.join(_fences(long, whisker), "metric").select(
        "metric", "date", "value", ((quarter < F.col("low")) | (quarter > F.col("high"))).alias("outlier"))


def anomaly_contributors(days: DataFrame, sales: DataFrame, products: DataFrame) -> DataFrame:
    """For the given days, their three largest region/category revenues as one text.

    `sales` are order lines, or the daily cells of these.  `days` holds calendar days, so broadcasting it is bounded; it keeps all
    other days' lines out of the shuffle.
    """
    chosen = days.select(F.col("date").alias("order_date")).distinct()
    lines = sales.join(F.broadcast(chosen), "order_date", "left_semi")
    if "category" in sales.columns:
        named = lines.where(F.col("category").isNotNull())
    else:
        per_product = lines.groupBy("order_date", "region", "product_id").agg(F.sum("revenue").alias("revenue"))
        named = per_product.join(products.select("product_id", "category"), "product_id")
    slices = named.groupBy("order_date", "region", "category").agg(F.sum("revenue").alias("revenue"))
    place = F.row_number().over(Window.partitionBy("order_date").orderBy(F.desc("revenue"), "region", "category"))
    amount = F.format_number(exact.half_up(exact.cents(F.col("revenue")), F.lit(100).cast(exact.WHOLE)), 0)
    top = slices.withColumn("place", place).where(F.col("place") <= CONTRIBUTORS).select(
        F.col("order_date").alias("date"), "place", F.concat("region", F.lit("/"), "category", F.lit(": "), amount).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("place", "text")))
    return top.groupBy("date").agg(F.concat_ws("; ", F.transform(listed, lambda e: e.getField("text"))).alias("listed"))


def detect_anomalies(daily: DataFrame, sales: DataFrame, products: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Days whose z-score reaches 2.5 or whose value lies outside the fence of its series."""
    measured = rolling(daily, metrics).join(_fences(_long(daily, metrics), "1.5"), "metric")
    quarter = F.col("units") * 4
    far = F.coalesce(F.abs("z_score") >= Z_THRESHOLD, F.lit(False))
    flagged = measured.withColumn("far", far).where(
        F.col("far") | (quarter < F.col("low")) | (quarter > F.col("high")))
    explained = [m for m in metrics if m in EXPLAINED]
    needs_text = F.col("metric").isin(*explained) if explained else F.lit(False)
    texts = anomaly_contributors(flagged.where(needs_text), sales, products)
    return flagged.join(texts, "date", "left").select(
        "metric", "date", F.col("value").cast("double").alias("actual_value"), "expected_value",
        F.round("z_score", 2).alias("z_score"), F.when(F.col("far"), "z-score").otherwise("IQR").alias("flagged_by"),
        F.when(needs_text, F.coalesce("listed", F.lit(NO_ORDERS))).otherwise("").alias("possible_contributors"),
    ).orderBy("metric", "date")


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("metric").agg(F.count("*").alias("anomalies")).orderBy(F.desc("anomalies"), "metric")


def recent_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return anomalies.orderBy(F.desc("date"), "metric").limit(n)


def anomaly_filter(anomalies: DataFrame, metric: str | None = None) -> DataFrame:
    chosen = anomalies.where(F.col("metric") == metric) if metric else anomalies
    return chosen.orderBy(F.desc("date"), "metric")
