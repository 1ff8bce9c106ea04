"""Helpers the operators share: tables, written stages, text primitives."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.plans.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Sends the functions of a module to the tasks by value, so that executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def kept_in_worker(name: str, of, make):
    """In a task: what `make` gave this Python worker for `name`, made anew when `of` differs from last time.

    A worker runs many tasks; vocabularies are read once in it, and at most one object
    is held under a name.
    """
    held = vars(sys.modules.setdefault("_kept_in_worker", type(sys)("_kept_in_worker")))
    if name not in held or held[name][0] != of:
        held.pop(name, None)
        held[name] = (of, make())
    return held[name][1]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """The rows written once below the shared folder and read back.

    It cuts the lineage: what follows reads files that survive a lost executor,
    and is not computed again for each reader.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(hashes: DataFrame, most: int):
    """The different values of the column h, sorted as unsigned numbers, as a broadcast; None if they are more than `most`."""
    hashes = stage(hashes.select("h").distinct())
    if hashes.count() > most:
        return None
    return hashes.sparkSession.sparkContext.broadcast(np.sort(hashes.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
