"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  A target of r times the source's
words gives each of its documents floor(r) whole copies for certain; the rest, a
fraction f of the source's words, is a sample without replacement.  Each document
has inclusion odds f / (1 - f) * preference and a fixed random number u; documents
rank by the odds of u divided by their inclusion odds, and the sample is the head
of that ranking whose words come nearest to what is left of the target.  The
sample's size is thus fixed in words, while documents differ in probability.

The ranking is never sorted as a whole.  Ranks fall into about sqrt(n) bins a
source; words are summed per bin map-side, the bin that holds the cut is found on
those sums, and only the documents of that one bin are put in order.  So a source
with a third of all rows is no larger a task than sqrt(n) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.llm.common import WORD, stage

EXACT = "decimal(38,0)"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number strictly between 0 and 1 that depends on seed and keys alone (52 bits of an MD5)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: its words, documents and target.

    Sources in code point order (null last) weigh `weights`, repeating.  They share
    the words of all sources by weight; a target stops at `most` times the source's
    words and the excess is shared again.  A source is stopped if the share it would
    get, all sources of smaller words-per-weight being stopped, is still above its
    stop; so one pass in that order settles all rounds.  Windows run over sources.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(cycle, (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")))
    first_full = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = F.coalesce(F.sum("source_size").over(first_full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(first_full.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    per = per.select("*", total.alias("total"), before.alias("before"), rest.alias("rest"))
    share = (F.col("total") - most * F.col("before")).cast(EXACT) * F.col("weight")
    per = per.withColumn("stopped", share > F.col("source_size").cast(EXACT) * F.lit(most) * F.col("rest"))
    stopped_words = F.sum(F.when(F.col("stopped"), F.col("source_size")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)
    target = (F.when(F.col("stopped"), (most * F.col("source_size")).cast("double"))
              .otherwise((F.col("total") - most * stopped_words).cast("double") * F.col("weight") / open_weight))
    return (per.withColumn("target", target)
            .withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("goal", F.col("target") - F.col("certain") * F.col("source_size"))
            .withColumn("fraction", F.when(F.col("source_size") > 0, F.col("goal") / F.col("source_size")).otherwise(0.0))
            .select("source", "source_size", "docs", "target", "certain", "goal", "fraction"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix", carry: bool = False) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    One row per input row.  Null text has size 0; null is a source of its own.  Rows
    of equal rank (repeated rows) order by doc_id, and equal rows are interchangeable.
    An empty table gives no rows.  Only doc_id, text and source are read; the result
    depends on them and on `seed`.  `preference` of a document is 1 + s / (s + m)
    for s words and m the source's mean: longer documents are favoured, at most 2 to 1.

    With `carry`, every row keeps all columns of `docs`, as the struct __row, and rows
    without id are told apart by their texts, each with a random number of its own.
    """
    carried, text_key = [], F.lit("")
    if carry:
        text_key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text:"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))).otherwise("")
        carried = [F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("__row")]
    slim = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), text_key.alias("__text_key"), *carried))
    sources = stage(source_targets(slim, weights, most))
    mean = F.col("source_size") / F.col("docs")
    preference = F.when(F.col("size") > 0, 1.0 + F.col("size") / (F.col("size") + mean)).otherwise(1.0)
    odds = F.col("fraction") / (1.0 - F.col("fraction")) * preference
    u = uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("__text_key")))
    rank = F.when(F.col("fraction") > 0, u / (1.0 - u) / odds).otherwise(0.0)
    bins = F.ceil(F.sqrt(F.col("docs").cast("double")))
    bin_of = F.least(F.floor(F.col("rank") / (1.0 + F.col("rank")) * bins), bins - 1)
    right = sources.withColumnRenamed("source", "__source")
    ranked = (slim.join(right, slim["source"].eqNullSafe(right["__source"])).drop("__source")
              .withColumn("rank", rank).withColumn("bin", bin_of))

    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("goal").alias("goal"))
    up_to = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    cut = (sums.withColumn("up_to", up_to).filter(F.col("up_to") > F.col("goal"))
           .groupBy("source").agg(F.min_by(F.struct("bin", (F.col("up_to") - F.col("words")).alias("before")), "bin").alias("cut")))
    cut = stage(cut.select(F.col("source").alias("__source"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before")))
    placed = ranked.join(cut, ranked["source"].eqNullSafe(cut["__source"]), "left").drop("__source")
    whole = F.when(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")), 1).otherwise(0)
    ahead = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("rank", "doc_id", "__text_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_cut = placed.filter(F.col("bin") == F.col("cut_bin"))
    settled = placed.filter(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
    fits = F.col("cut_before") + ahead + F.col("size") / 2.0 <= F.col("goal")
    chosen = settled.withColumn("chosen", whole).unionByName(in_cut.withColumn("chosen", F.when(fits, 1).otherwise(0)))
    copies = (F.col("certain") + F.when(F.col("fraction") > 0, F.col("chosen")).otherwise(0)).cast("long")
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(["__row"] if carry else []))
