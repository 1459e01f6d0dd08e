"""Comparisons of rows with their own group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.numeric import mean


def above_group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows whose decimal ``value`` is above the mean of their group.

    The correlated subquery as a grouped mean joined back: groups are reduced
    map-side, where a window would sort a hot group in one task.
    """
    means = df.groupBy(F.col(group).alias("peer_group")).agg(mean(F.col(value)).alias("peer_mean"))
    return (
        df.join(means, F.col(group) == F.col("peer_group"))
        .where(F.col(value) > F.col("peer_mean"))
        .drop("peer_group")
    )
