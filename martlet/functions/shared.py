"""Helpers that let several results come from one pass over the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_row(df: DataFrame, column: str) -> DataFrame:
    """One row: struct whose `latest` is the maximum of the column.

    It takes the maximum of every other column too.  Without that, column
    pruning would give this one-row plan a narrower shuffle of its own; with it,
    the plan below equals that of the rows, and Spark runs their shuffle once.
    """
    others = [F.max(c).alias(c) for c in df.columns if c != column]
    return df.agg(F.struct(F.max(column).alias("latest"), *others).alias("top"))


def latest(df: DataFrame, column: str) -> Column:
    return latest_row(df, column).scalar().getField("latest")
