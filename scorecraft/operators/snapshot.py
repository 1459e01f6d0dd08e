"""Two meanings of "latest", kept apart: per key, and over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Rows at their key's own newest period; several rows in that period are all kept.

    One exchange on the keys, shared with trend windows over the same keys.  A key's
    window holds its periods only.
    """
    newest = F.max(period).over(W.partitionBy(*keys))
    return df.withColumn("newest", newest).where(F.col(period) == F.col("newest")).drop("newest")


def latest_overall(
    df: DataFrame, period: str, newest: DataFrame | bool | None = None
) -> DataFrame:
    """Rows at the newest period of the whole table.

    ``newest`` is a one-row, one-column frame with that period for callers that know a
    cheaper source of it.  It is evaluated as a scalar subquery, once per query.
    False says that ``df`` holds that period only.
    """
    if newest is False:
        return df
    if newest is None:
        newest = df.agg(F.max(period))
    return df.where(F.col(period) == newest.scalar())
