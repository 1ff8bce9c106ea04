"""Rounding and ratio helpers that stay exact.

Money is summed as DECIMAL and ratios are formed on whole numbers (cents or
counts), so a result does not depend on the order in which partitions are
merged.  One rounding rule everywhere: half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

WHOLE = "decimal(38,0)"


def cents(money: Column) -> Column:
    """DECIMAL(p,2) amount as a whole number of cents."""
    return (money * 100).cast(WHOLE)


def whole(count: Column) -> Column:
    return count.cast(WHOLE)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def half_up(num: Column, den: Column, times: int = 1) -> Column:
    """num * times / den rounded to a whole number; null for a zero divisor."""
    size = F.nullif(F.abs(den), F.lit(0).cast(WHOLE))
    magnitude = int_div(F.abs(num) * (2 * times) + size, size * 2)
    return F.when((num < 0) != (den < 0), -magnitude).otherwise(magnitude)


def percent(num: Column, den: Column) -> Column:
    """100 * num / den with two decimals; both whole numbers of one unit."""
    return half_up(num, den, 10_000).cast("double") / 100


def count_percent(part: Column, total: Column) -> Column:
    return percent(whole(part), whole(total))


def money_percent(part: Column, total: Column) -> Column:
    return percent(cents(part), cents(total))


def mean_money(total: Column, n: Column) -> Column:
    """Mean of n amounts with two decimals."""
    return half_up(cents(total), whole(n)).cast("double") / 100


def mean_count(total: Column, n: Column, decimals: int = 2) -> Column:
    """Mean of n whole numbers, rounded to the given decimals."""
    return half_up(whole(total), whole(n), 10**decimals).cast("double") / 10**decimals


def fraction(num: Column, den: Column) -> Column:
    """num / den as a double, 0 where the divisor is 0 or missing."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def flag(condition: Column) -> Column:
    """Boolean verdict: an unknown comparison does not count as a hit."""
    return F.coalesce(condition, F.lit(False))


def portable(df: DataFrame) -> DataFrame:
    """Plain output types: money as double, whole numbers as bigint."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
