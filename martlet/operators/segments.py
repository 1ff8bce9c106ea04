"""Recency, frequency and monetary scores, and the customer segments made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from ..functions.shared import latest
from ..functions.order_stats import attach, bucket_levels, order_statistics, quantile_edge, quantile_positions

# Segment names with their descriptions, and the label of customers without orders.
DESCRIPTIONS = {
    "High Value": "Recent, frequent, big spenders — the core revenue base. Protect with priority service and early "
                  "access to new products.",
    "Loyal": "Frequent, consistent purchasers who aren't necessarily top spenders. Reward consistency to push them "
             "toward High Value.",
    "New": "Recent first-time or early-stage buyers with limited order history. Focus on onboarding and a strong "
           "second-purchase experience.",
    "At Risk": "Used to buy frequently/well but haven't ordered recently — the clearest re-engagement target before "
               "they go Dormant.",
    "Dormant": "Long inactive, low historical frequency and spend. Lowest-cost segment to deprioritize in favor of "
               "the other four.",
}
NO_ORDERS = "No Orders Yet"
BINS = 5


def rfm_base(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Days since the last order, number of orders and money spent, per known customer who ordered."""
    # Filtered first, as the join below would filter it: one plan, one shuffle for rows and latest date.
    spent = sales.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"), F.count("*").alias("frequency"), F.sum("revenue").alias("monetary"))
    known = spent.join(customers.select("customer_id"), "customer_id", "left_semi")
    return known.select("customer_id", F.datediff(latest(spent, "last_order"), F.col("last_order")).alias("recency_days"),
                        "frequency", "monetary")


def _quintile_bounds(base: DataFrame) -> DataFrame:
    """One row: inner quintile edges of recency (r) and spend (m), scaled by 5, and the customers at the
    frequency quintiles (f).

    The three orderings are searched together, as three labelled rows per
    customer.  Frequency ties are broken by customer id, so its sort order is
    (frequency, customer): one more level than the other two need.
    """
    units = base.select("customer_id", F.col("recency_days").cast("bigint").alias("r"), "frequency",
                        exact.cents(F.col("monetary")).cast("bigint").alias("m"))
    extent = units.agg(F.struct(
        F.min("r").alias("r_lo"), F.max("r").alias("r_hi"), F.min("m").alias("m_lo"), F.max("m").alias("m_hi"),
        F.min("customer_id").alias("c_lo"), F.max("customer_id").alias("c_hi"), F.max("frequency").alias("f_hi"),
        F.count("*").alias("total")))

    def entry(label: str, *levels: Column) -> Column:
        return F.struct(F.lit(label).alias("ordering"), *[c.cast("bigint").alias(f"l{i}") for i, c in enumerate(levels, 1)],
                        F.lit(1).alias("n"), F.col("extent.total").alias("total"))

    def buckets(name: str, prefix: str) -> tuple[Column, Column]:
        return bucket_levels(F.col(name), F.col(f"extent.{prefix}_lo"), F.col(f"extent.{prefix}_hi"))

    rows = attach(units, "extent", extent).select(F.explode(F.array(
        entry("r", *buckets("r", "r"), F.col("r"), F.lit(0)),
        entry("m", *buckets("m", "m"), F.col("m"), F.lit(0)),
        entry("f", F.col("frequency"), *buckets("customer_id", "c"), F.col("customer_id")),
    )).alias("e")).select("e.*")

    found = order_statistics(rows, ["l1", "l2", "l3", "l4"], quantile_positions(BINS), group=("ordering",)).agg(
        F.max("total").alias("total"),
        *[F.map_from_entries(F.collect_list(F.when(F.col("ordering") == o, F.struct("rank", value)))).alias(o)
          for o, value in (("r", exact.whole(F.col("l3")).alias("v")), ("m", exact.whole(F.col("l3")).alias("v")),
                           ("f", F.struct(F.col("l1").alias("frequency"), F.col("l4").alias("customer_id")).alias("v")))])
    total, inner = F.col("total"), range(1, BINS)
    return found.select(F.struct(
        F.array(*[quantile_edge("r", total, k, BINS) for k in inner]).alias("r"),
        F.array(*[F.try_element_at("f", exact.int_div((total - 1) * k, F.lit(BINS))) for k in inner]).alias("f"),
        F.array(*[quantile_edge("m", total, k, BINS) for k in inner]).alias("m"),
    ))


def _exceeded(bounds: Column, value: Column) -> Column:
    """How many of the inner edges lie below the value."""
    return reduce(lambda a, b: a + b, [F.when(bounds[i] < value, 1).otherwise(0) for i in range(BINS - 1)])


def rfm_scores(base: DataFrame) -> DataFrame:
    """Quintile scores 1..5 (5 is best) and their sum.

    Bins are closed on the right and cut at interpolated quantiles, so a score
    is one more than the number of inner edges below the value; this is not
    `ntile`.  Equal edges give an empty bin instead of an error.
    """
    recency = exact.whole(F.col("recency_days")) * BINS
    spend = exact.cents(F.col("monetary")) * BINS
    place = F.struct(F.col("frequency"), F.col("customer_id"))
    scored = attach(base, "bounds", _quintile_bounds(base)).withColumns({
        "r_score": BINS - _exceeded(F.col("bounds.r"), recency),
        "f_score": 1 + _exceeded(F.col("bounds.f"), place),
        "m_score": 1 + _exceeded(F.col("bounds.m"), spend),
    }).drop("bounds")
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def segment_of(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "High Value")
        .when((f >= 4) & (r >= 3), "Loyal")
        .when((r >= 4) & (f <= 2), "New")
        .when((r <= 2) & (f >= 3), "At Risk")
        .otherwise("Dormant")
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.select(
        "customer_id", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score",
        segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("segment"))


def segment_profile(segments: DataFrame) -> DataFrame:
    sums = segments.groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum("recency_days").alias("days"), F.sum("frequency").alias("orders"),
        F.sum("monetary").alias("spent"))
    n = F.col("customers")
    text = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return sums.select(
        "segment", "customers",
        exact.mean_count(F.col("days"), n, 1).alias("avg_recency_days"),
        exact.mean_count(F.col("orders"), n, 1).alias("avg_frequency"),
        (exact.half_up(exact.cents(F.col("spent")), exact.whole(n) * 10).cast("double") / 10).alias("avg_monetary"),
        F.element_at(text, F.col("segment")).alias("description"),
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "segment")


def apply_segments(customers: DataFrame, segments: DataFrame) -> DataFrame:
    """Customers with their new segment; the old one where there is none, else 'No Orders Yet'."""
    new = segments.select("customer_id", "segment")
    return customers.join(new, "customer_id", "left").select(
        *[c for c in customers.columns if c != "customer_segment"],
        F.coalesce("segment", "customer_segment", F.lit(NO_ORDERS)).alias("customer_segment"))
