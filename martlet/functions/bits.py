"""Sets of whole numbers as bitmaps in cells, small enough to be sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CELL = 1 << 15      # bits of a cell: 4 KB, as Spark's bitmap functions make them
MOST_CELLS = 8192   # cells sent to the tasks at most (32 MB)


def cell_of(number: Column) -> Column:
    return F.shiftright(number.cast("bigint"), 15)


def place_of(number: Column) -> Column:
    return number.cast("bigint").bitwiseAND(F.lit(CELL - 1))


def cells_of(numbers: DataFrame, number: Column) -> DataFrame:
    """One row per cell that holds any of the numbers: `cell` and its `bits`."""
    spots = numbers.where(number.isNotNull()).select(cell_of(number).alias("cell"), place_of(number).alias("place"))
    return spots.groupBy("cell").agg(F.bitmap_construct_agg("place").alias("bits"))


def mark_members(df: DataFrame, number: Column, cells: DataFrame, name: str) -> DataFrame:
    """Adds a flag: whether the number is in the set; false for null.  The cells go to every task."""
    place = place_of(number)
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(place, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    sent = F.broadcast(cells.select(F.col("cell").alias("__cell"), F.col("bits").alias("__bits")))
    is_set = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(sent, cell_of(number) == F.col("__cell"), "left").withColumn(
        name, F.coalesce(is_set, F.lit(False))).drop("__cell", "__bits")
