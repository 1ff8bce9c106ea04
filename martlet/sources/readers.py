"""Readers for the star tables, and the profile of an uploaded file."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .records import read_split
from .schemas import RAW, STAR

# Quotes inside quoted text are doubled, white space is kept, and a header that contradicts the columns read is an error.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "enforceSchema": "false"}


def read_star(spark: SparkSession, folder: str, one_task: bool = False) -> dict[str, DataFrame]:
    """The three raw CSV tables, columns found by their name in the header; dates stay text until checked.

    `seq` gives every row its place of ingest (file, block, row), which is what
    "the first of several copies" refers to.  `unreadable` lists the columns whose text
    is not of the declared type; their value is null, and the audits reject the row.  A
    column that the file lacks is null throughout.  Quoted text may hold line breaks;
    a file is read by many tasks all the same (see `records`).  `one_task` reads a file
    in one task, for files with single quotes inside unquoted text.
    """
    tables = {}
    for name, schema in RAW.items():
        path = f"{folder}/{name}.csv"
        if one_task:
            rows = spark.read.options(**CSV, multiLine="true").csv(path)
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("row")).alias("seq")
        else:
            rows, place = read_split(spark, path, CSV), F.col("seq")
        present = {f.name: F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast("string") for f in schema.fields}
        typed = {f.name: _typed(present[f.name], f.dataType) for f in schema.fields}
        bad = [F.when(present[n].isNotNull() & value.isNull(), F.lit(n)) for n, value in typed.items()]
        tables[name] = rows.select(*[v.alias(n) for n, v in typed.items()], F.array_compact(F.array(*bad)).alias("unreadable"), place)
    return tables


def _typed(text: Column, kind: T.DataType) -> Column:
    """The value of a text; null if it is not written as one.  Whole numbers may carry a zero fraction (33.0)."""
    if isinstance(kind, T.StringType):
        return text
    number = F.trim(text).try_cast("decimal(38,10)")
    if isinstance(kind, T.IntegralType):
        whole = F.when(number == F.floor(number), number.cast("decimal(28,0)").cast("string"))
        return whole.try_cast(kind.simpleString())
    return F.trim(text).try_cast(kind.simpleString())


def read_cleaned(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One cleaned table; a missing one is an error.  Of a store that is loaded in batches, the batches that are complete."""
    if table not in STAR:
        raise ValueError(f"unknown table {table}")
    return read_stored(spark, folder, table).select(*STAR[table].names)


def stored_batches(spark: SparkSession, folder: str) -> list[str] | None:
    """The batches that are stored in whole; None for a folder that isn't loaded in batches.  One row per batch."""
    try:
        listed = spark.read.schema("batch string, stored_at timestamp").parquet(f"{folder}/_batches")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing.getCondition()):
            return None
        raise
    return [r["batch"] for r in listed.orderBy("stored_at", "batch").collect()]


def read_stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the store with its partition columns."""
    batches = stored_batches(spark, folder)
    if batches is None:
        return spark.read.parquet(f"{folder}/{table}")
    places = [f"{folder}/{table}/batch={b}" for b in batches]
    return spark.read.schema(STAR[table]).option("basePath", f"{folder}/{table}").parquet(*places)


def read_segmented(spark: SparkSession, folder: str) -> DataFrame:
    """The stored customers with the segment that the last run gave them."""
    return spark.read.parquet(f"{folder}/customers_segmented").select(*STAR["customers"].names)


# Types an uploaded column may have, in the order in which they are tried, and how their values look.  A number's
# pattern fits every text that can be read as one: a failing cast is slow, so texts of other looks are not cast.
# Dates and times count only as usually written.
_AROUND = r"[\x00-\x20\x7F-\uFFFF]*"
_WHOLE = rf"^{_AROUND}[+-]?[0-9]*{_AROUND}$"
TYPES = {"int": _WHOLE, "bigint": _WHOLE,
         "double": rf"(?i)^{_AROUND}[+-]?([0-9]*\.?[0-9]*(e[+-]?[0-9]+)?|0x[0-9a-f.]*p[+-]?[0-9]+|nan|inf|infinity)[fd]?{_AROUND}$",
         "date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "timestamp": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9:.]+", "boolean": r"(?i)^(true|false)$"}


def _read_as(text: Column, kind: str) -> Column:
    return F.when(text.rlike(TYPES[kind]), text).try_cast(kind)


def _unread(text: Column) -> Column:
    """One bit per type that a text cannot be read as; null for a missing value."""
    bits = {name: 1 << i for i, name in enumerate(TYPES)}
    each = reduce(Column.bitwiseOR, [F.when(_read_as(text, name).isNull(), bit).otherwise(0) for name, bit in bits.items()])
    # Plain whole numbers, the usual case, are numbers of all three types and nothing else.
    plain = F.lit(bits["date"] | bits["timestamp"] | bits["boolean"])
    return F.when(text.rlike(r"^-?[0-9]{1,9}\z"), plain).when(text.isNotNull(), each)


def _type_of(unread: Column) -> Column:
    """Aggregate of `_unread`: the first type all values can be read as; a column without values is text."""
    ever, kind = F.bit_or(unread), F.lit("string")
    for i, name in reversed(list(enumerate(TYPES))):
        kind = F.when(ever.bitwiseAND(1 << i) == 0, F.lit(name)).otherwise(kind)
    return F.when(ever.isNull(), F.lit("string")).otherwise(kind)


def profile_upload(spark: SparkSession, path: str) -> DataFrame:
    """Column name, inferred type, rows and missing values of a CSV file: one aggregate over its records."""
    uploaded = _uploaded(spark, path)
    judged = uploaded.select(*[_unread(F.col(f"`{name}`")).alias(f"c{i}") for i, name in enumerate(uploaded.columns)])
    counts = judged.agg(
        F.count("*").alias("rows"),
        F.array(*[F.struct(F.lit(name).alias("column_name"), _type_of(F.col(f"c{i}")).alias("data_type"),
                           F.count_if(F.col(f"c{i}").isNull()).alias("missing"))
                  for i, name in enumerate(uploaded.columns)]).alias("profile"))
    return counts.select("rows", F.explode("profile").alias("p")).select("p.*", "rows")


def preview_upload(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The first `n` rows of the file, as text."""
    if not path.endswith(".csv"):
        raise ValueError("Only .csv files are accepted.")
    return spark.read.options(**CSV, multiLine="true").csv(path).limit(n)


def _uploaded(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".csv"):
        raise ValueError("Only .csv files are accepted.")
    return read_split(spark, path, CSV).drop("seq")
