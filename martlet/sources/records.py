"""CSV records of large files, read by many tasks although quoted text may hold line breaks.

A line break ends a record if an even number of quotes stands before it in the file
(quotes inside quoted text are doubled).  So quotes are counted per block of the file,
summed up over the blocks before, and every task knows whether its block begins inside
quotes.  Lines that are no record of their own are put together by record; a record may
reach over blocks.  A file in which no line has an odd number of quotes, the usual case,
needs none of that: each line is a record and nothing is shuffled.

A quote inside unquoted text (5" disk) is not valid CSV and would be counted: such files
need the one-task reader.  Lines end with \\n or \\r\\n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK = ["file", "block"]
# With these options a record without quotes is its text as it stands, cut at the commas.
PLAIN = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"}
FILES = 100_000   # places of so many headers are sent to the tasks at most


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and place (file, block, row) of every line, and whether it has an odd number of quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"), (quotes % 2).alias("odd"))


def _blocks(lines: DataFrame) -> DataFrame:
    """Per block: whether it begins inside quotes (`inside`), and the last block before it in which a record begins (`owner`).

    One row per block of a file, so the windows over a file's blocks see few rows.
    """
    counted = lines.groupBy(*BLOCK).agg((F.sum("odd") % 2).alias("odd"), F.min(F.when(F.col("odd") == 1, F.col("row"))).alias("first_odd"), F.max("row").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)))
    # Inside quotes, the first record begins after the line that closes them.
    begins = (F.col("inside") == 0) | (F.col("first_odd") < F.col("last"))
    return known.select(*BLOCK, "inside", F.last(F.when(begins, F.col("block")), ignorenulls=True).over(before).alias("owner"))


def _joined(lines: DataFrame) -> DataFrame:
    """Records of files with line breaks in quotes."""
    in_block = Window.partitionBy(*BLOCK).orderBy("row")
    up_to, all_of = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*BLOCK)
    placed = lines.join(_blocks(lines), BLOCK)
    quoted = (F.sum("odd").over(up_to) - F.col("odd") + F.col("inside")) % 2
    placed = placed.withColumn("begins", F.when(quoted == 0, 1).otherwise(0))
    placed = placed.withColumns({"number": F.sum("begins").over(up_to), "records": F.sum("begins").over(all_of)})
    alone = (F.col("begins") == 1) & (F.col("odd") == 0)
    # The last record of a block goes on in the lines before the first record of the next.
    last = (F.col("number") == 0) | (F.col("number") == F.col("records"))
    pieces = placed.where(~alone).select(
        "file", F.when(F.col("number") > 0, F.col("block")).otherwise(F.col("owner")).alias("from_block"),
        F.when(last, -1).otherwise(F.col("number")).alias("number"), F.struct("block", "row", "value").alias("line"))
    whole = pieces.groupBy("file", "from_block", "number").agg(F.array_sort(F.collect_list("line")).alias("parts"))
    whole = whole.select(F.array_join(F.col("parts.value"), "\n").alias("value"), "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["row"].alias("row"))
    return placed.where(alone).select("value", *BLOCK, "row").unionByName(whole)


def _records(lines: DataFrame) -> DataFrame:
    """value, file, block and row (of its first line) of every record; empty lines are none.  Looks through the file once to see whether lines must be joined."""
    found = lines.drop("odd") if lines.where("odd = 1").isEmpty() else _joined(lines)
    ended = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", r"\r$", "")).otherwise(F.col("value"))
    return found.withColumn("value", ended).where("value != ''")


def read_split(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The columns of a CSV file, or of a folder of them, as text, and `seq`, each row's place of ingest.

    The header is the first record of every file; one with other names is an error, as
    are columns of the file itself called seq.  White space and quotes are as `options`
    of Spark's reader say.
    """
    names = spark.read.options(**options, multiLine="true").csv(path).columns
    lines = _lines(spark, path)
    # A file begins in its block 0; one row per file.
    heads = lines.where("block = 0 AND value NOT IN ('', '\r')").groupBy("file").agg(F.min("row").alias("head"), F.min_by(F.col("value").endswith("\r"), "row").alias("crlf"))
    heads = F.broadcast(heads) if len(lines.inputFiles()) <= FILES else heads
    parser = {k: v for k, v in options.items() if k not in ("header", "enforceSchema")} | {"multiLine": "true"}
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    # A file of \\r\\n lines has plain line breaks in its values, as Spark's reader gives them.
    text = F.when(F.col("crlf"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    rows = _records(lines).join(heads, "file").withColumn("text", text)
    # Without quotes and line breaks a record is its text cut at the commas; empty fields are missing.
    plain = ~reduce(Column.__or__, [F.contains("text", F.lit(c)) for c in ('"', "\r", "\n", "\0")]) & F.lit(parser == PLAIN)
    rows = rows.withColumns({"cut": F.when(plain, F.split("text", ",")), "fields": F.when(~plain, F.from_csv("text", schema, parser))})
    values = [F.when(F.col("cut").isNotNull(), F.nullif(F.get("cut", F.lit(i)), F.lit(""))).otherwise(F.col("fields")[f"c{i}"]) for i in range(len(names))]
    told = F.array(*[F.lower(v) for v in values])
    wrong = (F.col("row") == F.col("head")) & ~told.eqNullSafe(F.array(*[F.lit(n.lower()) for n in names]))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit(f"header is not {','.join(names)} in "), F.col("file"))).cast("boolean")).otherwise(F.col("row") != F.col("head"))
    return rows.where(checked).select(*[v.alias(n) for v, n in zip(values, names)], F.struct(*BLOCK, "row").alias("seq"))
