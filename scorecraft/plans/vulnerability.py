"""Area vulnerability: the composite scorecard and the readings taken from it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.banding import VULNERABILITY_TIERS
from scorecraft.functions.exact import exact_means
from scorecraft.functions.numeric import rounded
from scorecraft.operators.normalize import CompositeSpec, Domain, Metric, composite_scores
from scorecraft.operators.ranking import rank_descending

# fixed values: metrics and weights of the published index
VULNERABILITY = CompositeSpec(
    domains=(
        Domain("score_mortality", "0.25", (Metric("maternal_mortality_rate"),)),
        Domain("score_preterm", "0.20", (Metric("preterm_birth_rate"),)),
        Domain("score_prenatal_care", "0.20", (Metric("late_no_prenatal_pct"),)),
        Domain("score_low_birthweight", "0.15", (Metric("low_birthweight_rate"),)),
        Domain("score_csection", "0.10", (Metric("csection_rate"),)),
        Domain(
            "score_provider_density", "0.10", (Metric("obgyn_per_10k_women", inverted=True),)
        ),
    ),
    composite="composite_score",
    tier="risk_tier",
    tiers=VULNERABILITY_TIERS,
    degenerate="zero",
)


def scored_areas(aggregate: DataFrame, spec: CompositeSpec = VULNERABILITY) -> DataFrame:
    """The aggregate with scores, composite and tier."""
    return composite_scores(aggregate, spec)


def composite_scorecard(
    aggregate: DataFrame, spec: CompositeSpec = VULNERABILITY, ordered: bool = True
) -> DataFrame:
    """Ranked scorecard, most vulnerable area first."""
    ranked = rank_descending(
        scored_areas(aggregate, spec), spec.composite, "vulnerability_rank", spec.max_distinct
    ).select(
        "vulnerability_rank",
        "zip_code",
        "community_name",
        "region_type",
        spec.composite,
        spec.tier,
        *spec.scores,
    )
    return ranked.orderBy(F.desc_nulls_last(spec.composite), "zip_code") if ordered else ranked


def disparity_gap(scored: DataFrame, parent: str, composite: str = "composite_score") -> DataFrame:
    """Highest minus lowest composite over all areas and within each parent region.

    The overall row re-aggregates the parents' extremes instead of the areas.
    """
    by_parent = scored.groupBy(parent).agg(
        F.count(F.lit(1)).alias("areas"),
        F.max(composite).alias("highest"),
        F.min(composite).alias("lowest"),
    )
    overall = by_parent.agg(
        F.sum("areas").alias("areas"),
        F.max("highest").alias("highest"),
        F.min("lowest").alias("lowest"),
    )
    return (
        by_parent.withColumn("level", F.lit("parent"))
        .unionByName(
            overall.select(
                F.lit("overall").alias("level"), F.lit(None).alias(parent), "*"
            )
        )
        .select(
            "level", parent, "areas", "highest", "lowest",
            (F.col("highest") - F.col("lowest")).alias("gap"),
        )
    )


def primary_driver(scored: DataFrame, spec: CompositeSpec = VULNERABILITY) -> DataFrame:
    """The metric that adds most to each area's composite; NULL in the lowest tier.

    ``primary_driver`` is the first in declared order, ``drivers`` names all that tie.
    """
    points = {
        domain.score: F.col(domain.score) * F.lit(Decimal(domain.weight)) * 10
        for domain in spec.domains
    }
    most = F.greatest(*points.values())
    names = F.array_compact(
        F.array(*[F.when(value == F.col("most"), F.lit(name)) for name, value in points.items()])
    )
    concerned = (F.col(spec.tier) != spec.tiers.otherwise) & (F.size("names") > 0)
    return (
        scored.withColumn("most", most)
        .withColumn("names", names)
        .select(
            "zip_code",
            spec.composite,
            spec.tier,
            F.when(concerned, F.get("names", F.lit(0))).alias("primary_driver"),
            F.when(concerned, F.array_join("names", "+")).alias("drivers"),
            F.when(concerned, F.round("most", 2)).alias("driver_points"),
        )
    )


def region_contrast(
    aggregate: DataFrame, baseline: str, spec: CompositeSpec = VULNERABILITY
) -> DataFrame:
    """Mean of every metric by region type and its difference from the baseline type."""
    means = exact_means(
        aggregate, ["region_type"], spec.columns, {"areas": F.lit(1).cast("bigint")}
    )

    def entry(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            rounded(F.col(name), 4).alias("mean_value"),
            rounded(F.col(name) - F.col(f"reference.{name}"), 4).alias("difference"),
        )

    # an aggregate over all types, as a filter would be pushed below the exchanges to share
    reference = means.agg(
        F.max(F.when(F.col("region_type") == baseline, F.struct(*spec.columns)))
    ).scalar()
    return means.withColumn("reference", reference).select(
        "region_type", "areas", F.inline(F.array(*[entry(name) for name in spec.columns]))
    )
