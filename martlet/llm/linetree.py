"""Line dedup by a log-template tree.

The tree has a fixed depth: a line goes by its number of tokens, then by its first
`LEADING` tokens, to a leaf.  Tokens with a digit are variable fields from the start.
In a leaf, a position is constant if more than half of the leaf's different lines
have the same token there, and variable otherwise.  If enough positions are constant
they make the leaf's template, and every line that agrees with it belongs to it,
whatever its variable fields hold; any other line is a template of its own.
Templates found in at least `MIN_DOCS` documents are dropped from all of them but the
one with the smallest id, so that what copies share survives once.

Lines are handled as hashes: one table of (document, line number, leaf, line) is
written, with the masked text beside the hashes; different lines are counted before
they are compared, and only leaves with several different lines are looked at token by
token.  A line that a third of the
documents have is one row there; its documents are counted map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import GAP, stage

LEADING, MIN_DOCS = 3, 3
CONSTANT = 0.7   # share of a template's positions that must be constant
AGREE = 0.8      # share of the constant positions in which a line must agree


def masked(line: Column) -> Column:
    """The line with single spaces and with `<*>` for each token that has a digit."""
    body = F.trim(F.regexp_replace(line, GAP, " "))
    return F.regexp_replace(body, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a token: doc_id, t (hash of the text), pos, n, leaf, body (hashes) and line (masked)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    line = split.select("doc_id", "t", "pos", masked(F.col("raw")).alias("line")).filter("line <> ''")
    n = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")
    return line.select("*", n).select("*", F.xxhash64("n", F.substring_index("line", " ", LEADING)).alias("leaf"), F.xxhash64("line").alias("body"))


def _generalised(lines: DataFrame, wide: DataFrame, constant: float, agree: float) -> DataFrame:
    """(leaf, body) of the lines that belong to the template of their leaf.  `wide`: leaf and bodies, its different lines."""
    lines = lines.select("leaf", "body", "n", "line").join(wide, "leaf").groupBy("leaf", "body", "n", "bodies").agg(F.first("line").alias("line"))
    cells = stage(lines.select("leaf", "body", "n", "bodies", F.posexplode(F.split("line", " ")).alias("pos", "token")))
    counted = cells.groupBy("leaf", "n", "bodies", "pos", "token").agg(F.count(F.lit(1)).alias("lines"))
    fixed = counted.filter("lines * 2 > bodies")
    enough = fixed.groupBy("leaf").agg(F.count(F.lit(1)).alias("constants"), F.max("n").alias("n")).filter(F.col("constants") >= F.col("n") * constant)
    template = stage(fixed.select("leaf", "pos", "token").join(enough.select("leaf", "constants"), "leaf"))
    agreeing = cells.select("leaf", "body", "pos", "token").join(template, ["leaf", "pos", "token"]).groupBy("leaf", "body", "constants").agg(F.count(F.lit(1)).alias("same"))
    return agreeing.filter(F.col("same") >= F.col("constants") * agree).select("leaf", "body")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, agree: float = AGREE) -> DataFrame:
    """(doc_id, t, pos) of the lines to drop; t is the hash of the document's text."""
    lines = stage(_lines(docs))
    holders = lines.select("leaf", "body", "doc_id", "t").distinct()
    bodies = stage(holders.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("docs")))
    wide = stage(bodies.groupBy("leaf").agg(F.count(F.lit(1)).alias("bodies"), F.sum("docs").alias("docs"))
                 .filter((F.col("bodies") > 1) & (F.col("docs") >= min_docs)).select("leaf", "bodies"))
    joined = stage(_generalised(lines, wide, constant, agree))
    # Lines that can recur at all: those of a template of several lines, and those that recur themselves.
    joined_key = joined.withColumn("template", F.lit(True))
    told = bodies.join(joined_key, ["leaf", "body"], "left").filter(F.col("template") | (F.col("docs") >= min_docs))
    told = stage(told.select("leaf", "body", F.when(F.col("template"), F.lit(0)).otherwise(F.col("body")).alias("of")))
    placed = stage(lines.join(told, ["leaf", "body"]).select("doc_id", "t", "pos", "leaf", "of"))
    per = placed.select("leaf", "of", "doc_id", "t").distinct().groupBy("leaf", "of").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
    recurring = stage(per.filter((F.col("docs") >= min_docs) & F.col("first").isNotNull()).select("leaf", "of", "first"))
    return placed.join(recurring, ["leaf", "of"]).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "t", "pos")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of `docs`, text without the recurring lines, and __lines, __dropped (their numbers).

    Lines end at \\n; blank lines never recur.  Null text stays null, with 0 lines.
    Rows that repeat an id with its text count as one document and change alike; an id
    with two texts is two documents.  Rows without id count as documents and lose the
    lines that a document with an id has too; a template that only such rows have stays.
    """
    drops = recurring_lines(docs, min_docs).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("__drop"))
    drops = stage(drops.select(F.col("doc_id").alias("__drop_id"), F.col("t").alias("__drop_t"), "__drop"))
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    both = docs.join(drops, docs["doc_id"].eqNullSafe(drops["__drop_id"]) & (key == drops["__drop_t"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__drop", i)), "\n")
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return (both.withColumn("__lines", lines).withColumn("__dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
            .withColumn("text", F.when(F.col("__drop").isNotNull(), kept).otherwise(F.col("text"))).drop("__drop_id", "__drop_t", "__drop"))
