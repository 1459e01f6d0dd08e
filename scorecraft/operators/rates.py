"""Pooled rates, allocation of parent values, provider density, cohort benchmarks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.numeric import ratio, rounded
from scorecraft.sources.tables import require_columns


@dataclass(frozen=True)
class Rate:
    """``factor * sum(events) / sum(base)``, reported as ``name``."""

    name: str
    events: str
    factor: int


def pooled_rates(
    counts: DataFrame,
    keys: Sequence[str],
    rates: Sequence[Rate],
    years: tuple[int, int] | None = None,
    base: str = "base",
) -> DataFrame:
    """Ratio of sums per key over a window of years, never the mean of yearly rates.

    Keeps the pooled base and event counts next to the rates.
    """
    require_columns(counts, *keys, base, *[rate.events for rate in rates])
    if years:
        counts = counts.where(F.col("year").between(*years))
    sums = [F.sum(name).alias(name) for name in [base, *[rate.events for rate in rates]]]
    pooled = counts.groupBy(*keys).agg(*sums)
    return pooled.select(
        "*",
        *[
            ratio(rate.factor * F.col(rate.events), F.col(base)).alias(rate.name)
            for rate in rates
        ],
    )


def allocate_by_share(
    children: DataFrame, parents: DataFrame, parent: str, base: str, value: str
) -> DataFrame:
    """Split each parent's value over its children by their share of the parent's base.

    ``parents(parent, value)`` may bring its own ``parent_base``; otherwise it is the
    sum over the children, as a grouped sum rather than a window, so that a parent
    that owns a third of the children is combined map-side instead of sorted in one
    task.  A parent whose base is zero allocates NULL.
    """
    if "parent_base" not in parents.columns:
        totals = children.groupBy(parent).agg(F.sum(base).alias("parent_base"))
        parents = totals.join(parents, parent)
    whole = F.col("parent_base")
    return (
        children.join(parents, parent)
        .withColumn("share", rounded(ratio(F.col(base), whole), 6))
        .withColumn("allocated", rounded(ratio(F.col(value) * F.col(base), whole), 4))
    )


def provider_density(
    areas: DataFrame,
    providers: DataFrame,
    population: DataFrame,
    key: str,
    per: int = 10000,
    threshold: float | None = None,
) -> DataFrame:
    """Providers per ``per`` inhabitants; 0 without providers, NULL without inhabitants.

    With a ``threshold``, ``low_access`` tells whether the density lies below it.
    """
    found = (
        areas.join(population.select(key, F.col("n").alias("inhabitants")), key, "left")
        .join(providers.select(key, F.col("n").alias("provider_rows")), key, "left")
        .withColumn("providers", F.coalesce("provider_rows", F.lit(0)))
        .withColumn("density", ratio(per * F.col("providers"), F.col("inhabitants")))
        .drop("provider_rows")
    )
    if threshold is None:
        return found
    return found.withColumn("low_access", F.col("density") < threshold)


def benchmark_excess(
    pooled: DataFrame,
    rates: Sequence[Rate],
    base: str = "base",
    suffix: str = "_excess_pct",
    parent: str | None = None,
) -> DataFrame:
    """Percent by which each rate exceeds the rate of the whole cohort, or of the ``parent``.

    The cohort rate is again a ratio of sums, one scalar subquery for all metrics.  Parents'
    rates are grouped and joined back, so a parent with a third of the areas is combined
    map-side; areas without a parent are compared with each other.
    """
    benchmark = F.struct(
        *[
            ratio(rate.factor * F.sum(rate.events), F.sum(base)).alias(rate.name)
            for rate in rates
        ]
    ).alias("cohort")
    if parent:
        cohorts = pooled.groupBy(F.col(parent).alias("cohort_parent")).agg(benchmark)
        compared = pooled.join(cohorts, F.col(parent).eqNullSafe(F.col("cohort_parent")))
    else:
        compared = pooled.withColumn("cohort", pooled.agg(benchmark).scalar())
    return compared.select(
        *pooled.columns,
        *[
            rounded(
                (ratio(F.col(rate.name), F.col(f"cohort.{rate.name}")) - 1) * 100, 2
            ).alias(rate.name + suffix)
            for rate in rates
        ],
    )


def flag_small_base(pooled: DataFrame, minimum: int, base: str = "base") -> DataFrame:
    """Mark keys whose pooled denominator is too small for a stable rate."""
    return pooled.withColumn(
        "small_base", F.coalesce(F.col(base) < minimum, F.lit(True))
    )
