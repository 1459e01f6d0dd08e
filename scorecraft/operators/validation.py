"""Cleaning with a reject reason per record, and reconciliation of two sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_records(
    raw: DataFrame,
    texts: Sequence[str],
    types: Mapping[str, str],
    checks: Mapping[str, Column],
) -> DataFrame:
    """Trim and case-fold ``texts``, coerce ``types``, and name the first failed check.

    A value that does not parse becomes NULL and fails as ``bad_<column>``; then
    ``checks`` run in order, and a check that is not true fails under its name.  Valid
    records have a NULL ``reject_reason``.
    """
    typed = raw.select(
        *[
            F.lower(F.trim(name)).alias(name)
            if name in texts
            else F.trim(name).try_cast(types[name]).alias(name)
            if name in types
            else F.col(name)
            for name in raw.columns
        ]
    )
    reason = F
    for name in types:
        reason = reason.when(F.col(name).isNull(), F.lit(f"bad_{name}"))
    for name, check in checks.items():
        reason = reason.when(~F.coalesce(check, F.lit(False)), F.lit(name))
    return typed.withColumn("reject_reason", reason.otherwise(F.lit(None).cast("string")))


def reject_duplicates(
    records: DataFrame, keys: Sequence[str], record_id: str, version: Column
) -> DataFrame:
    """Keep, per key, the valid record with the greatest ``version``; reject the others.

    ``ROW_NUMBER() = 1`` as an aggregate: the record with the greatest version is found
    map-side first, so a key repeated in a third of the table is never sorted in one
    task.  Survivors are matched back by ``record_id``, which is unique and so cannot be
    skewed.  ``version`` must be unique within a key, and both of fixed width (numbers,
    dates), so that Spark can aggregate them by hash without sorting.
    """
    valid = records.where(F.col("reject_reason").isNull())
    survivors = valid.groupBy(*keys).agg(F.max_by(record_id, version).alias("survivor"))
    # about as many survivors as records: never worth a broadcast
    kept = survivors.select("survivor").hint("merge")
    marked = records.join(kept, F.col(record_id) == F.col("survivor"), "left")
    duplicate = F.col("reject_reason").isNull() & F.col("survivor").isNull()
    return marked.withColumn(
        "reject_reason", F.when(duplicate, "duplicate").otherwise(F.col("reject_reason"))
    ).drop("survivor")


#: Buckets of keys whose digests are compared; one row each is the most that is broadcast.
BUCKETS = 4096


def _digests(side: DataFrame, key: str, value: str) -> DataFrame:
    """``bucket, digest``: the number of rows and two order-free checksums of each bucket."""
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), key, value)) for seed in (1, 2)]
    return side.groupBy(_bucket(key).alias("bucket")).agg(
        F.struct(F.count(F.lit(1)), *sums).alias("digest")
    )


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(BUCKETS))


def differing_buckets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``bucket``: those whose rows are not the same on both sides, ``BUCKETS`` at most."""
    other = _digests(right, key, value).select(F.col("bucket").alias("in"), F.col("digest").alias("of"))
    both = _digests(left, key, value).join(other, F.col("bucket") == F.col("in"), "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("of"))).select(
        F.coalesce("bucket", "in").alias("bucket")
    )


def reconcile(
    left: DataFrame,
    right: DataFrame,
    key: str,
    value: str,
    tolerance: Column,
    mostly_equal: bool = False,
) -> DataFrame:
    """Compare two sources key by key.

    ``tolerance`` may use ``left_value``, ``right_value`` and their ``difference``.
    Both sides must have one row per key, so a shuffle on the key cannot be skewed.  Rows
    with a null key match nothing.

    Sources that are ``mostly_equal`` are compared by digests of buckets of keys first.
    Only buckets that differ in any digit are shuffled and joined; the rows of the others
    are those of the left side, with the same value on the right.  The result is the same.
    """
    ours = left.select(key, F.col(value).alias("left_value"))
    theirs = right.select(key, F.col(value).alias("right_value"))
    if not mostly_equal:
        matched = ours.join(theirs, key, "full")
    else:
        # null keys have a bucket as well, but match nothing, so they are always joined
        unequal = F.broadcast(differing_buckets(left, right, key, value))
        in_unequal = _bucket(key) == unequal["bucket"]
        open_ours = ours.where(F.col(key).isNotNull()).join(unequal, in_unequal, "left_semi")
        open_theirs = theirs.where(F.col(key).isNotNull()).join(unequal, in_unequal, "left_semi")
        same = ours.where(F.col(key).isNotNull()).join(unequal, in_unequal, "left_anti")
        matched = (
            open_ours.join(open_theirs, key, "full")
            .unionByName(same.withColumn("right_value", F.col("left_value")))
            .unionByName(ours.where(F.col(key).isNull()), allowMissingColumns=True)
            .unionByName(theirs.where(F.col(key).isNull()), allowMissingColumns=True)
        )
    return matched.withColumn(
        "difference", F.col("left_value") - F.col("right_value")
    ).withColumn(
        "status",
        F.when(F.col("left_value").isNull(), "missing_left")
        .when(F.col("right_value").isNull(), "missing_right")
        .when(F.abs("difference") > tolerance, "mismatch")
        .otherwise("match"),
    )
