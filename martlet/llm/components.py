"""Connected components of a graph given as a table of edges, by alternating stars.

Each round points every node's larger neighbours to its smallest neighbour (large
star), then its smaller neighbours and itself to their smallest (small star).  The
number of rounds grows with the logarithm of the longest path.  Every half round is
a map-side minimum per node and a join, written to the shared folder; a node with
very many edges is split by Spark's skew join, as both sides are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import stage


def _star(edges: DataFrame) -> DataFrame:
    """(node, other) and the smallest of node and its others, per edge."""
    least = stage(edges.groupBy("node").agg(F.min("other").alias("least")))
    return edges.join(least, "node").withColumn("least", F.least("least", "node"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    return (_star(both).filter("other > node AND other <> least")
            .select(F.col("other").alias("node"), F.col("least").alias("other")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    star = _star(down)
    own = star.select("node", F.col("least").alias("other"))
    others = star.filter("other <> least").select(F.col("other").alias("node"), F.col("least").alias("other"))
    return own.unionByName(others).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "other")), F.sum(F.xxhash64("node", "other") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    `edges` has two columns, node and other, of one orderable type; direction, loops,
    nulls and repetitions don't matter.
    """
    edges = stage(edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
                  .filter("node <> other").distinct())
    seen = _signature(edges)
    while seen[0]:
        edges = stage(_small(stage(_large(edges))))
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select("node", F.col("other").alias("root"))
