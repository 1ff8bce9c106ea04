"""Exact order statistics, quantile edges and ranks without sorting everything in one task.

Built-in `percentile` gathers every distinct value on one reducer and an
unpartitioned `rank` sends every row to one.  Here values are first counted
(map-side), then located level by level: which coarse bucket holds the wanted
position, which fine bucket inside it, which value inside that.  The bucket
width is the cube root of the value range, so no window ever sees more than
about cbrt(max - min) rows, whatever the distribution.

The input is read once: the counts are shuffled, and the extent, the buckets
and every level are computed from that one shuffle, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exact import int_div, whole


def attach(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Adds the single value of a one-row frame to every row.

    The value is a scalar subquery.  Exploding it from an array of one keeps the
    optimizer from copying the subquery into every expression and pushed-down
    filter that uses the column, each copy of which would be planned again.
    """
    return df.select("*", F.explode(F.array(one_row.scalar())).alias(name))


def bucket_levels(value: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Coarse and fine bucket of a BIGINT between lo and hi."""
    width = F.greatest(F.ceil(F.cbrt((hi - lo + 1).cast("double"))), F.lit(1)).cast("bigint")
    return int_div(value - lo, width * width), int_div(value - lo, width)


def counted_buckets(df: DataFrame, value: str, group: str | None = None) -> tuple[DataFrame, list[str]]:
    """Copies `n` per distinct value of a BIGINT column, with its buckets and the `total` of its group.

    With a group column (of few values) every group has its own extent.
    Returns the frame and its level columns.
    """
    keys = [group] if group else []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    extent = F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total")).alias("extent")
    if group:
        entry = F.struct(F.col(group), F.col("extent"))
        extents = counts.groupBy(group).agg(extent).agg(F.map_from_entries(F.collect_list(entry)).alias("extents"))
        known = attach(counts, "__extents", extents).withColumn("__extent", F.element_at("__extents", F.col(group)))
    else:
        known = attach(counts, "__extent", counts.agg(extent))
    coarse, fine = bucket_levels(F.col(value), F.col("__extent.lo"), F.col("__extent.hi"))
    levels = [f"{value}_coarse", f"{value}_fine", value]
    return known.select(*keys, coarse.alias(levels[0]), fine.alias(levels[1]), value, "n",
                        F.col("__extent.total").alias("total")), levels


def _before(window) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def order_statistics(cells: DataFrame, levels: list[str], ranks: Callable[[Column], Column],
                     group: tuple[str, ...] = ()) -> DataFrame:
    """The level values found at 0-based positions of the sort order by `levels`.

    `cells` holds the group and level columns, copies `n`, and the `total` of
    the group; `ranks` maps a total to the array of wanted positions.  Returns
    group, total, rank and levels: one row per group and rank.  Groups must be
    few: the hits, one per group and rank, are broadcast.
    """
    here = Window.partitionBy(*group).orderBy(levels[0])
    hits = (
        cells.groupBy(*group, levels[0]).agg(F.sum("n").alias("n"), F.max("total").alias("total"))
        .withColumn("before", _before(here))
        .withColumn("rank", F.explode(F.filter(
            F.array_distinct(ranks(F.col("total"))),
            lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))))
        .select(*group, levels[0], "total", "rank", (F.col("rank") - F.col("before")).alias("rest"))
    )
    for depth in range(2, len(levels) + 1):
        level, known = levels[depth - 1], [*group, *levels[:depth - 1]]
        inside = cells.drop("total").join(F.broadcast(hits), known)
        here = Window.partitionBy(*group, "rank").orderBy(level)
        hits = (
            inside.groupBy(*known, level, "total", "rank", "rest").agg(F.sum("n").alias("n"))
            .withColumn("before", _before(here))
            .where((F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n")))
            .select(*known, level, "total", "rank", (F.col("rest") - F.col("before")).alias("rest"))
        )
    return hits.select(*group, "total", "rank", *levels)


def quantile_positions(parts: int) -> Callable[[Column], Column]:
    """Positions next to the inner quantiles 1/parts, 2/parts, ... of a sorted column."""
    def positions(total: Column) -> Column:
        low = [int_div((total - 1) * k, F.lit(parts)) for k in range(1, parts)]
        return F.array(*low, *[F.least(p + 1, total - 1) for p in low])
    return positions


def quantile_edge(at: str, total: Column, k: int, parts: int) -> Column:
    """Linearly interpolated quantile k/parts times parts, from a map of position to value."""
    spread = (total - 1) * k
    low = int_div(spread, F.lit(parts))
    a, b = F.try_element_at(at, low), F.try_element_at(at, F.least(low + 1, total - 1))
    return a * parts + (b - a) * (spread % parts)


def quantile_edges(df: DataFrame, value: str, parts: int, group: str | None = None) -> DataFrame:
    """`edges`: the linearly interpolated inner quantiles 1/parts ... of a BIGINT column, times parts.

    One row, or one per value of the group column (which must have few).
    Scaling by `parts` keeps interpolation in whole numbers.  Nulls are ignored.
    """
    keys = [group] if group else []
    cells, levels = counted_buckets(df.where(F.col(value).isNotNull()), value, group)
    found = order_statistics(cells, levels, quantile_positions(parts), tuple(keys)).groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("rank", whole(F.col(value)).alias("v")))).alias("at"),
    )
    edges = [quantile_edge("at", F.col("total"), k, parts) for k in range(1, parts)]
    return found.select(*keys, "total", F.array(*edges).alias("edges"))


def iqr_fence(df: DataFrame, value: str, whisker: str = "1.5") -> DataFrame:
    """One row: struct `fence` (low, high) of Tukey's outlier bounds, in units of value / 4."""
    edges = quantile_edges(df, value, 4)
    q1, q3 = F.element_at("edges", 1), F.element_at("edges", 3)
    reach = (q3 - q1) * F.lit(whisker).cast("decimal(4,2)")
    return edges.select(F.struct((q1 - reach).alias("low"), (q3 + reach).alias("high")).alias("fence"))


def mark_outside(df: DataFrame, value: Column, fence: DataFrame, name: str) -> DataFrame:
    """Adds a flag: the value lies outside the fence; a missing value does not."""
    quarter = whole(value) * 4
    out = (quarter < F.col("__fence.low")) | (quarter > F.col("__fence.high"))
    return attach(df, "__fence", fence).withColumn(name, F.coalesce(out, F.lit(False))).drop("__fence")


def with_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of a BIGINT column, largest first, equal values sharing a rank."""
    cells, levels = counted_buckets(df.select((-F.col(value)).alias("down")), "down")
    coarse, fine, down = levels
    by_fine = cells.groupBy(coarse, fine).agg(F.sum("n").alias("n"))
    by_coarse = by_fine.groupBy(coarse).agg(F.sum("n").alias("n"))
    offset_coarse = by_coarse.select(coarse, _before(Window.orderBy(coarse)).alias("o1"))
    offset_fine = by_fine.select(coarse, fine, _before(Window.partitionBy(coarse).orderBy(fine)).alias("o2"))
    offset_value = cells.select(*levels, _before(Window.partitionBy(coarse, fine).orderBy(down)).alias("o3"))
    ranks = (
        offset_value.join(offset_fine, [coarse, fine]).join(offset_coarse, coarse)
        .select((-F.col(down)).alias(value), (F.col("o1") + F.col("o2") + F.col("o3") + 1).alias(name))
    )
    return df.join(ranks, value)
