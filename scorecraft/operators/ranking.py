"""Exact ranks, row numbers and n-tiles over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorecraft.operators.joins import BROADCAST_ROWS

#: Rows are numbered in ``SIDE ** 2`` ranges, whose borders are quantiles of ``SAMPLE`` rows.
SIDE, SAMPLE = 32, 1 << 14


def _above(hist: DataFrame, score: str, within: Sequence[str], name: str) -> DataFrame:
    """Rank of each histogram row: one more than the rows with a greater score."""
    before = (
        W.partitionBy(*within)
        .orderBy(F.desc_nulls_last(score))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return hist.withColumn(name, F.coalesce(F.sum("hist_rows").over(before), F.lit(0)) + 1)


def rank_descending(
    df: DataFrame, score: str, name: str, max_distinct: int
) -> DataFrame:
    """``RANK() OVER (ORDER BY score DESC)`` for a score with few distinct values.

    Equal scores are counted map-side, so only the histogram (at most
    ``max_distinct`` rows) is sorted in one place and joined back.  A score without
    such a bound goes through ``rank_unbounded``.
    """
    if max_distinct > BROADCAST_ROWS:
        return rank_unbounded(df, score, name)
    hist = df.groupBy(F.col(score).alias("hist_score")).agg(F.count(F.lit(1)).alias("hist_rows"))
    ranks = _above(hist, "hist_score", [], name).drop("hist_rows")
    matches = F.col(score).eqNullSafe(F.col("hist_score"))
    return df.join(F.broadcast(ranks), matches).drop("hist_score")


def rank_overall_and_within(
    df: DataFrame,
    score: str,
    group: str,
    overall_name: str,
    within_name: str,
    max_distinct: int,
) -> DataFrame:
    """Rank over all rows and within ``group`` from one (group, score) histogram.

    A group's histogram has at most ``max_distinct`` rows however many rows the group
    holds, so a group with a third of the table costs its task no more than another.
    The number of groups is not bounded here, so the join back carries no hint: its
    size is known once the histogram is built and AQE broadcasts it only if it fits.
    """
    hist = df.groupBy(F.col(group).alias("hist_group"), F.col(score).alias("hist_score")).agg(
        F.count(F.lit(1)).alias("hist_rows")
    )
    within = _above(hist, "hist_score", ["hist_group"], within_name)
    totals = hist.groupBy(F.col("hist_score").alias("total_score")).agg(
        F.sum("hist_rows").alias("hist_rows")
    )
    overall = _above(totals, "total_score", [], overall_name).drop("hist_rows")
    if max_distinct <= BROADCAST_ROWS:
        overall = F.broadcast(overall)
    ranks = within.join(
        overall, F.col("hist_score").eqNullSafe(F.col("total_score"))
    ).drop("hist_rows", "total_score")
    return df.join(
        ranks,
        F.col(group).eqNullSafe(F.col("hist_group"))
        & F.col(score).eqNullSafe(F.col("hist_score")),
    ).drop("hist_group", "hist_score")


def _ranged(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the range, from 0 to ``SIDE ** 2 - 1``, that a row's order columns
    lie in.

    Borders come from a sketch: the ``SAMPLE`` rows of least hash, found by a bounded top-k
    and read by a scalar subquery.  It depends on the rows only, so every reader of the plan
    sees the same borders.  They are whole tuples of the order columns, so a value that many
    rows share is split by the columns after it.  A row is placed in two steps, among the
    first borders of ``SIDE`` blocks and among those of its block.  The hash is taken over
    all columns, so the plan below, and its exchanges, are those of the rows themselves.
    """
    sample = (
        df.select(F.struct(*order).alias("border"), F.xxhash64(*df.columns).alias("hash"))
        .orderBy("hash", "border")
        .limit(SAMPLE)
        .agg(F.sort_array(F.collect_list("border")).alias("sample"))
    )
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)),
        lambda i: F.get("sample", F.floor(i * F.size("sample") / F.lit(SIDE * SIDE)).cast("int")),
    )
    borders = (
        sample.select(cut.alias("cut"))
        .select(
            F.transform(
                F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda b: F.slice("cut", b * SIDE + 1, SIDE)
            ).alias("blocks")
        )
        .select(
            F.struct(F.transform("blocks", lambda x: x[0]).alias("first"), F.col("blocks")).alias("b")
        )
        .scalar()
    )
    own = F.struct(*order)

    def passed(values: Column) -> Column:
        # the first border of all is the least row of the sample; rows below it stay there
        return F.greatest(F.size(F.filter(values, lambda x: x <= own)) - 1, F.lit(0))

    placed = df.withColumn("range_borders", borders).withColumn(
        "range_block", passed(F.col("range_borders.first"))
    )
    inside = passed(F.get(F.col("range_borders.blocks"), F.col("range_block")))
    return placed.withColumn(name, F.col("range_block") * SIDE + inside).drop(
        "range_borders", "range_block"
    )


def _offsets(
    ranged: DataFrame, column: str, rows: Column, descending: bool, total: str | None = None
) -> DataFrame:
    """``range, offset``: the ``rows`` in all ranges before each, a bounded number of rows."""
    order = F.desc("range") if descending else F.asc("range")
    earlier = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    everywhere = earlier.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the digest of all columns keeps the plan below the one that the rows have
    whole = F.bit_xor(F.xxhash64(*ranged.columns)).alias("digest")
    sizes = ranged.groupBy(F.col(column).alias("range")).agg(rows.alias("size"), whole)
    return sizes.where("digest is not null").select(
        "range",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"),
        *([F.sum("size").over(everywhere).alias(total)] if total else []),
    )


def number_rows(
    df: DataFrame, *order: str, name: str = "row_number", total: str | None = None
) -> DataFrame:
    """1-based position of every row by the order columns, ascending with NULLs first, and
    the ``total`` of rows.

    Rows are numbered inside their range; the rows of earlier ranges are added by a join with
    one row per range.  The last order column should be unique.  One plan, without a
    checkpoint: the sketch, the counts and the rows share the exchanges below them.
    """
    ranged = _ranged(df, order, "row_range")
    offsets = _offsets(ranged, "row_range", F.count(F.lit(1)), descending=False, total=total)
    inside = W.partitionBy("row_range").orderBy(*[F.asc_nulls_first(c) for c in order])
    return (
        ranged.withColumn("position", F.row_number().over(inside))
        .join(F.broadcast(offsets), F.col("row_range") == F.col("range"))
        .withColumn(name, F.col("position") + F.col("offset"))
        .drop("row_range", "range", "position", "offset")
    )


def rank_unbounded(df: DataFrame, score: str, name: str) -> DataFrame:
    """``RANK() OVER (ORDER BY score DESC)`` whatever the number of distinct scores.

    The histogram has one row per score and is ranged like the rows of ``number_rows``; the
    count of rows above a score is a running sum in two steps, inside ranges and over them.
    """
    hist = df.groupBy(F.col(score).alias("hist_score")).agg(F.count(F.lit(1)).alias("hist_rows"))
    ranged = _ranged(hist, ["hist_score"], "hist_range")
    offsets = _offsets(ranged, "hist_range", F.sum("hist_rows"), descending=True)
    inside = (
        W.partitionBy("hist_range")
        .orderBy(F.desc_nulls_last("hist_score"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    ranks = ranged.join(F.broadcast(offsets), F.col("hist_range") == F.col("range")).select(
        "hist_score",
        (F.coalesce(F.sum("hist_rows").over(inside), F.lit(0)) + F.col("offset") + 1).alias(name),
    )
    return df.join(ranks, F.col(score).eqNullSafe(F.col("hist_score"))).drop("hist_score")


def ntile(df: DataFrame, buckets: int, *order: str, name: str = "bucket") -> DataFrame:
    """``NTILE(buckets)`` over a total order; the first ``n % buckets`` get one row more."""
    numbered = number_rows(df, *order, name="tile_row", total="tile_rows")
    sized = numbered.selectExpr(
        "*",
        f"tile_rows div {buckets} AS small",
        f"tile_rows % {buckets} AS larger",
        f"(tile_rows % {buckets}) * (tile_rows div {buckets} + 1) AS in_larger",
    )
    # with fewer rows than buckets every row is in a larger one and small is 0
    bucket = F.expr(
        """CASE WHEN tile_row <= in_larger THEN (tile_row - 1) div (small + 1) + 1
                ELSE larger + (tile_row - in_larger - 1) div nullif(small, 0) + 1 END"""
    )
    return sized.withColumn(name, bucket.cast("bigint")).drop(
        "tile_row", "tile_rows", "small", "larger", "in_larger"
    )
