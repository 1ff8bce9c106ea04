"""A training corpus from the documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
`documents` (and whatever further columns the documents have).

1. quality: rejects documents by the rule ensemble; a document stays at a score of 0.3.
2. lines: drops recurring line templates; documents of which nothing is left go, and
   n_chars follows the text.  Documents that were blank before stay.
3. near_duplicates: one row of each group of near copies stays: that of the smallest id,
   rows without id last; of texts under one id that of the smallest hash; of rows equal in
   both the first by all columns.  Reruns agree.  Unrelated texts under one id all stay.
4. benchmark: documents that contain an item of the benchmark go.
5. mixing: how often each document is taken, by source weights; documents taken zero
   times go, the others get size, source_size, target, copies and taken, which take the
   place of columns of these names.

Rows that repeat an id with another text, or have none, are documents of their own in
the last three stages: two go by id and text, and mixing decides row by row.
Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm import containment, linetree, mixing, rules, simhash
from martlet.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rule ensemble (9): documents that it rejects go."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The log-template tree (8)."""
    cleaned = linetree.drop_lines(docs)
    left = (F.col("__dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("__dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.filter(left).withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups (4): one row of each stays."""
    groups = stage(simhash.document_groups(docs))
    # Documents are told apart by id and text; narrow rows decide, map-side first.
    texts = groups.groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("t"), F.col("rows"))
    first = stage(texts.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("texts")))
    many = first.filter("texts > 1").select("root", F.col("first.doc_id").alias("__id"), F.col("first.t").alias("__t"))
    later = texts.join(many, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))))
    repeated = stage(first.filter("first.rows > 1").select("first.doc_id", "first.t"))
    kept = docs.join(*_same_document(docs, later), "left_anti")
    if repeated.isEmpty():
        return kept
    copies = docs.join(*_same_document(docs, repeated), "left_semi")
    # Rows equal in id and text can differ in other columns; their order as text decides.
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    once = copies.groupBy("doc_id", text).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("__row"))
    return kept.join(*_same_document(kept, repeated), "left_anti").unionByName(once.select("__row.*"))


def _same_document(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, Column]:
    """The documents named by doc_id and t (hash of the text), and the condition to meet them."""
    named = keys.select(F.col("doc_id").alias("__doc_id"), F.col("t").alias("__t"))
    return named, docs["doc_id"].eqNullSafe(named["__doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == named["__t"])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash containment (10): contaminated documents go."""
    leaks = containment.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(*_same_document(docs, leaks), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pareto sampling (1)."""
    taken = mixing.mix(docs, carry=True).filter("copies > 0")
    added = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c.lower() not in added]
    return taken.select(*[F.col("__row").getField(c).alias(c) for c in own], *added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixing", mix),
]

# Fitted trees and weights are beyond SQL; tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = work(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
