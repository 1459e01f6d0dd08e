"""Joins to small lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_counted(
    lookup: DataFrame, keys: DataFrame, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``lookup`` with a broadcast hint if ``keys`` is counted to be small.

    ``lookup`` must hold at most one row per row of ``keys``, a stored table that is
    cheap to count; the count stops one past the limit.  Beyond it the join is left to
    Catalyst and AQE.  Needed where ``lookup`` is computed, since size estimates of
    computed tables grow with the tables they come from.
    """
    return F.broadcast(lookup) if keys.limit(rows + 1).count() <= rows else lookup
