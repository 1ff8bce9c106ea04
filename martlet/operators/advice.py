"""Rules that turn conditions in the data into recommendation cards.

Every rule returns one row when it fires and none otherwise.  The figures are
columns; the sentences repeat them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from ..functions.order_stats import attach
from ..functions.shared import latest_row
from .products import PAIR, sums, totals_by

# Thresholds and priority order.
PRIORITIES = ["Critical", "High", "Medium", "Low"]
CRITICAL_ABOVE = 3
DECLINE_PERCENT = -20
RETURN_RATE = "0.10"
SLOW_DAYS = 4
CARD = ["finding", "evidence", "impact", "action", "priority"]


def rounded(amount: Column) -> Column:
    """Money without decimals and with thousands separators."""
    return F.format_number(exact.half_up(exact.cents(amount), F.lit(100).cast(exact.WHOLE)), 0)


def number(count: Column) -> Column:
    return F.format_number(count, 0)


def tenths(value: Column) -> Column:
    """One decimal place, from a whole number of tenths."""
    return F.format_number((value / 10).cast("decimal(20,1)"), 1)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _card(df: DataFrame, priority: Column | str, finding, evidence, impact, action, figures: list[str]) -> DataFrame:
    return df.select(
        *figures, text(*finding).alias("finding"), text(*evidence).alias("evidence"), text(*impact).alias("impact"),
        text(*action).alias("action"), (F.lit(priority) if isinstance(priority, str) else priority).alias("priority"))


def rec_at_risk_customers(sales: DataFrame, segments: DataFrame) -> DataFrame:
    """Spend at stake in the At Risk segment; the fact is summed per customer before the join."""
    spent = sales.groupBy("customer_id").agg(F.sum("revenue").alias("spent"))
    members = segments.where(F.col("segment") == "At Risk").select("customer_id")
    stake = spent.join(members, "customer_id", "left_semi").agg(F.count("*").alias("customers"), F.sum("spent").alias("at_stake"))
    fired = stake.where(F.col("customers") > 0).withColumn(
        "average_spend", exact.mean_money(F.col("at_stake"), F.col("customers")))
    average = F.format_number(exact.half_up(exact.cents(F.col("at_stake")), exact.whole(F.col("customers")) * 100), 0)
    return _card(
        fired, "High",
        (F.col("customers"), " formerly active customers are in the At Risk segment and have stopped ordering."),
        ("They spent Rs.", average, " each on average."),
        ("About Rs.", rounded(F.col("at_stake")), " of revenue is exposed if all of them leave (an estimate: customers"
         " times average past spend)."),
        ("Contact At Risk customers with a personal offer before they become Dormant.",),
        ["customers", "average_spend", "at_stake"])


def rec_unprofitable_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    losing = totals_by(sales, products, PAIR, ["profit", "revenue"]).where(F.col("profit") < 0)
    worst = F.min(F.struct("profit", "product_name", "category", "revenue")).alias("worst")
    fired = losing.agg(F.count("*").alias("products"), F.sum("profit").alias("loss"), worst).where(F.col("products") > 0)
    flat = fired.select("products", F.abs("loss").alias("total_loss"), F.col("worst.product_name").alias("worst_product"),
                        F.col("worst.category").alias("worst_category"), F.abs("worst.profit").alias("worst_loss"),
                        F.col("worst.revenue").alias("worst_revenue"))
    return _card(
        flat, F.when(F.col("products") > CRITICAL_ABOVE, "Critical").otherwise("High"),
        (F.col("products"), " product(s) lose money over all their orders; the worst is ", F.col("worst_product"), " (",
         F.col("worst_category"), ")."),
        (F.col("worst_product"), " earned Rs.", rounded(F.col("worst_revenue")), " and lost Rs.", rounded(F.col("worst_loss")), "."),
        ("Together these products lost Rs.", rounded(F.col("total_loss")), "."),
        ("Revisit price and supplier cost of these products, or stop selling them.",),
        ["products", "worst_product", "worst_category", "worst_revenue", "worst_loss", "total_loss"])


def rec_regional_decline(sales: DataFrame, products: DataFrame) -> DataFrame:
    """The region and category furthest below the mean of its earlier months that have sales."""
    lines = sales.withColumn("month", F.trunc("order_date", "month"))
    monthly = totals_by(lines, products, ["category"], ["revenue"], ["region", "month"])
    earlier, latest = F.col("month") < F.col("top.latest"), F.col("month") == F.col("top.latest")
    pairs = attach(monthly, "top", latest_row(monthly, "month")).groupBy("region", "category").agg(
        F.sum(F.when(earlier, F.col("revenue"))).alias("past"), F.count_if(earlier).alias("months"),
        F.sum(F.when(latest, F.col("revenue"))).alias("latest"))
    both = pairs.where(F.col("past").isNotNull() & F.col("latest").isNotNull() & (F.col("past") != 0))
    # latest against past / months, in whole numbers
    past, change = exact.cents(F.col("past")), exact.cents(F.col("latest")) * F.col("months") - exact.cents(F.col("past"))
    measured = both.select(
        "region", "category", (change.cast("double") / past.cast("double")).alias("share"),
        (exact.half_up(change, past, 10_000).cast("double") / 100).alias("pct_vs_baseline"),
        exact.half_up(change, past, 100).alias("whole_percent"), "latest",
        exact.mean_money(F.col("past"), F.col("months")).alias("baseline"),
        exact.half_up(past, exact.whole(F.col("months")) * 100).alias("whole_baseline"))
    worst = measured.orderBy("share", "region", "category").limit(1).where(F.col("share") * 100 <= DECLINE_PERCENT)
    place = (F.col("region"), " / ", F.col("category"))
    return _card(
        worst, "High",
        ("Revenue of ", *place, " is ", F.abs("whole_percent"), "% below its own monthly average in the latest month."),
        ("The latest month brought Rs.", rounded(F.col("latest")), " against an average of Rs.",
         F.format_number("whole_baseline", 0), "."),
        ("The decline is local to one region and category; finding its cause early keeps it there.",),
        ("Look into supply, marketing and competitors for ", *place, " before changing anything elsewhere.",),
        ["region", "category", "pct_vs_baseline", "latest", "baseline"])


def rec_high_return_category(sales: DataFrame, products: DataFrame) -> DataFrame:
    totals = totals_by(sales, products, ["category"], ["orders", "returned"])
    rate = F.col("returned").cast("double") / F.col("orders").cast("double")
    top = totals.withColumn("rate", rate).orderBy(F.desc("rate"), "category").limit(1)
    threshold = F.lit(RETURN_RATE).cast("decimal(4,2)")
    fired = top.where(F.col("returned") >= F.col("orders") * threshold).withColumns({
        "return_rate_pct": exact.count_percent(F.col("returned"), F.col("orders")),
        "shown": exact.half_up(exact.whole(F.col("returned")), exact.whole(F.col("orders")), 1000)})
    return _card(
        fired, "Medium",
        ("Category ", F.col("category"), " has the highest return rate, ", tenths(F.col("shown")), "%."),
        ("It had ", number(F.col("orders")), " orders."),
        ("Returns add handling cost to every sale and may point to quality or description problems.",),
        ("Check the product descriptions, sizes and quality in ", F.col("category"), "."),
        ["category", "orders", "returned", "return_rate_pct"])


def rec_slow_delivery_region(sales: DataFrame) -> DataFrame:
    waits = sales.groupBy("region").agg(*sums(sales, ["days", "timed"])).withColumnRenamed("timed", "n")
    slowest = waits.where(F.col("n") > 0).withColumn("mean", F.col("days").cast("double") / F.col("n").cast("double"))
    top = slowest.orderBy(F.desc("mean"), "region").limit(1).where(F.col("days") >= F.col("n") * SLOW_DAYS)
    fired = top.withColumns({
        "avg_delivery_days": exact.mean_count(F.col("days"), F.col("n")),
        "shown": exact.half_up(exact.whole(F.col("days")), exact.whole(F.col("n")), 10)})
    return _card(
        fired, "Medium",
        (F.col("region"), " waits longest for deliveries, ", tenths(F.col("shown")), " days on average."),
        ("All ", number(F.col("n")), " deliveries to the region were counted.",),
        ("Slow delivery can cost repeat orders and cause returns, though these data do not prove it.",),
        ("Review the carriers and warehouses that serve ", F.col("region"), "."),
        ["region", "avg_delivery_days"])


def recommendation_cards(sales: DataFrame, products: DataFrame, segments: DataFrame, spending: DataFrame | None = None) -> DataFrame:
    """The cards of all rules that fired: by priority, then in the order of the rules.

    `sales` may be a stored monthly summary, with the spending per customer
    given apart (`customer_id`, `revenue`); then the fact is not read again.
    """
    rules = [
        rec_unprofitable_products(sales, products), rec_regional_decline(sales, products),
        rec_at_risk_customers(sales if spending is None else spending, segments), rec_high_return_category(sales, products), rec_slow_delivery_region(sales),
    ]
    cards = reduce(DataFrame.unionByName, [r.select(F.lit(i).alias("rule"), *CARD) for i, r in enumerate(rules, 1)])
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return cards.withColumn("priority_rank", rank).orderBy("priority_rank", "rule")
