"""Which rows are later copies of a row already seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .bits import CELL, MOST_CELLS, cells_of, mark_members

# A group of equal rows is spread over this many lanes before its first row is
# chosen, so that a row copied a billion times is not numbered by one task.
LANES = 4096


def mark_later_copies(df: DataFrame, keys: list[str], first: list[str], name: str, lanes: int = LANES) -> DataFrame:
    """Adds a flag: true for every row but the first (by `first`) among rows equal on `keys`.

    Nulls count as equal.  Step one finds the first row of every lane; step two
    compares only those, at most `lanes` per group.  Rows that lost in step one
    keep to their lane, so no window partition holds a whole hot group.
    """
    lane, best, contender = "__lane", "__best", "__contender"
    laned = df.withColumn(lane, F.pmod(F.xxhash64(*first), F.lit(lanes)).cast("int"))
    order = [F.col(c) for c in first]
    in_lane = laned.withColumn(best, F.row_number().over(Window.partitionBy(*keys, lane).orderBy(*order)) == 1)
    finals = in_lane.withColumn(contender, F.when(F.col(best), F.lit(-1)).otherwise(F.col(lane)))
    place = F.row_number().over(Window.partitionBy(*keys, contender).orderBy(*order))
    flagged: Column = ~(F.col(best) & (place == 1))
    return finals.withColumn(name, flagged).drop(lane, best, contender)


def mark_later_copies_stored(df: DataFrame, keys: list[str], first: list[str], name: str,
                             keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`mark_later_copies` of a stored table: whole rows are shuffled only where their content may come again.

    Hashes of the contents are counted first, 8 bytes a row.  Those that come more than
    once set one bit each in a bitmap that goes to every task; rows that hit none have
    no copy.  A false hit costs a shuffle, never the result.  `keep` stores a table
    under a name and reads it back.
    """
    content = F.xxhash64(*keys)
    repeated = keep(df.groupBy(content.alias("content")).agg(F.count("*").alias("n")).where("n > 1").select("content"), "repeated")
    bits, n = CELL, repeated.count()
    while bits < CELL * MOST_CELLS and bits < 16 * n:
        bits *= 2
    spot = F.lit(bits - 1).cast("bigint")
    cells = keep(cells_of(repeated, F.col("content").bitwiseAND(spot)), "repeated_cells")
    told = mark_members(df, content.bitwiseAND(spot), cells, "__again")
    doubtful = mark_later_copies(told.where("__again").drop("__again"), keys, first, name)
    return told.where("NOT __again").drop("__again").withColumn(name, F.lit(False)).unionByName(doubtful)
