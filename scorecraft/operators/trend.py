"""Window features over the periods of a key.

Every function builds on one (key, period) window, so features taken together share a
single exchange and sort.  The grain is one row per key and period: a key's group is
as long as its calendar (weeks, quarters), not as its raw data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorecraft.functions.numeric import ratio


def periods(key: str, period: str) -> WindowSpec:
    return W.partitionBy(key).orderBy(period)


def change(value: Column, window: WindowSpec, rows: int = 1) -> Column:
    """Difference from the row ``rows`` before; NULL at the start."""
    return value - F.lag(value, rows).over(window)


def moving_mean(value: Column, window: WindowSpec, rows: int) -> Column:
    """Mean of the last ``rows`` rows (gaps in time ignored, NULLs skipped)."""
    frame = window.rowsBetween(1 - rows, 0)
    return ratio(F.sum(value).over(frame), F.count(value).over(frame))


def running_total(value: Column, window: WindowSpec) -> Column:
    return F.sum(value).over(window.rowsBetween(W.unboundedPreceding, 0))


def current_falling_run(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Per key: newest period and the number of consecutive falls that end there.

    A row falls if its value is below the row before; a NULL on either side does not.
    The run is the distance from the last row that did not fall, so the window output
    is reduced on the same partitioning, without another exchange.
    """
    window = periods(key, period)
    fell = F.coalesce(change(F.col(value), window) < 0, F.lit(False))
    rows = df.select(
        key, period, value, F.row_number().over(window).alias("seq"), fell.alias("fell")
    )
    return (
        rows.groupBy(key)
        .agg(
            F.max(period).alias(period),
            F.max_by(value, "seq").alias(value),
            (F.max("seq") - F.max(F.when(~F.col("fell"), F.col("seq")))).alias("falling_run"),
        )
    )


def nth_period_pivot(
    df: DataFrame, key: str, period: str, value: str, first: int, last: int
) -> DataFrame:
    """Value at the ``first`` and the ``last``-numbered period of each key, side by side.

    A key without that many periods has NULL.  ``seq <= last`` lets Spark drop later
    rows before the sort.
    """
    seq = F.row_number().over(periods(key, period))
    return (
        df.select(key, period, value, seq.alias("seq"))
        .where((F.col("seq") <= last) & F.col("seq").isin(first, last))
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("seq") == first, F.col(value))).alias("first_value"),
            F.max(F.when(F.col("seq") == last, F.col(value))).alias("last_value"),
        )
    )
