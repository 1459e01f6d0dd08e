"""Guarded division and half-up rounding with the same digits on every engine.

Doubles are brought to a fixed number of decimals first and rounded there, so a
value such as 0.8496 is banded after rounding (0.850) and sums of rounded values do
not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATIO = T.DecimalType(18, 6)
MONEY = T.DecimalType(28, 6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double; NULL where the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded(value: Column, places: int, fixed: T.DecimalType = RATIO) -> Column:
    """Half-up rounding of ``value`` after fixing it to ``fixed`` decimals."""
    return F.round(value.cast(fixed), places)


def hundredths(value: Column) -> Column:
    """A double with two decimals (money, percent, hours) as an exact bigint.

    Casting every row from double to decimal goes through text and costs several times
    the rest of an aggregation; rounding to a bigint stays in generated code.  A value with
    more than two decimals is an error, as its digits would be lost.
    """
    units = F.rint(value * 100)
    # the double nearest to two decimals, times 100, is off by two roundings at most
    lost = F.abs(value * 100 - units) > F.abs(units) * 2.0**-50
    error = F.raise_error(F.concat(F.lit("more than two decimals: "), value.cast("string")))
    return F.when(lost, error.cast("bigint")).otherwise(units.cast("bigint"))


def exact_sum(units: Column, unit: str) -> Column:
    """Sum of bigint ``units`` worth ``unit`` each, exact, as a decimal.

    High and low 20-bit parts are summed as two bigints and put together once per group:
    as fast as a plain bigint sum, which a single very large group could overflow (an
    overflow of the parts would take 2^43 rows of amounts below 2^40, and is an error).
    """
    low = units.bitwiseAND(F.lit((1 << 20) - 1))
    high = F.shiftright(units, 20)
    whole = F.sum(high).cast("decimal(20,0)") * (1 << 20) + F.sum(low).cast("decimal(20,0)")
    return whole.cast("decimal(28,0)") * F.lit(Decimal(unit))


def mean(value: Column) -> Column:
    """Mean of a decimal column: exact sum, one double division, NULLs skipped."""
    return ratio(F.sum(value), F.count(value))


def presentable(df: DataFrame) -> DataFrame:
    """Decimals as double and integers as bigint, for consumers outside Spark."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)
