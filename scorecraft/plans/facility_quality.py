"""Facility quality: composite scores, staffing quartiles and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorecraft.functions.banding import (
    QUALITY_TIERS,
    STAFFING_QUARTILE_LABELS,
    TRAJECTORY_SEGMENTS,
    code_label,
)
from scorecraft.functions.exact import exact_means
from scorecraft.functions.numeric import mean, ratio, rounded
from scorecraft.operators.normalize import CompositeSpec, Domain, Metric, composite_scores
from scorecraft.operators.peers import above_group_mean
from scorecraft.operators.ranking import ntile, rank_overall_and_within
from scorecraft.operators.snapshot import latest_overall
from scorecraft.operators.trend import change, moving_mean, nth_period_pivot, periods
from scorecraft.sources.tables import require_columns

# fixed values: domains and weights of the published score
QUALITY = CompositeSpec(
    domains=(
        Domain(
            "score_readmission",
            "0.30",
            (
                Metric("readmission_rate_30d", inverted=True),
                Metric("hospital_transfer_rate", inverted=True),
            ),
        ),
        Domain(
            "score_clinical",
            "0.25",
            (
                Metric("pressure_ulcer_rate", inverted=True),
                Metric("fall_injury_rate", inverted=True),
                Metric("pain_management_rate"),
            ),
        ),
        Domain(
            "score_staffing",
            "0.25",
            (Metric("rn_hours_per_resident"), Metric("cna_hours_per_resident")),
        ),
        Domain("score_compliance", "0.20", (Metric("health_deficiency_count", inverted=True),)),
    ),
    composite="composite_quality_score",
    tier="quality_tier",
    tiers=QUALITY_TIERS,
    degenerate="null",
)
KEY = "cms_certification_number"
QUARTERS_TRACKED = 8


def scored_facilities(
    measures: DataFrame,
    facilities: DataFrame,
    spec: CompositeSpec = QUALITY,
    newest: DataFrame | bool | None = None,
) -> DataFrame:
    """Facilities of the newest quarter with domain scores, composite and tier.

    The newest quarter is that of all measures, also of facilities not listed; the
    bounds are those of the listed ones.
    """
    require_columns(measures, KEY, "report_quarter", *spec.columns)
    latest = latest_overall(measures, "report_quarter", newest)
    profile = facilities.select(
        KEY, "facility_name", "state", "ownership_type", "certified_beds", "urban_rural"
    )
    return composite_scores(profile.join(latest, KEY), spec)


def quality_scores(
    measures: DataFrame,
    facilities: DataFrame,
    spec: CompositeSpec = QUALITY,
    newest: DataFrame | bool | None = None,
) -> DataFrame:
    """Scored facilities with their rank over all and within their state."""
    scored = scored_facilities(measures, facilities, spec, newest)
    return rank_overall_and_within(
        scored, spec.composite, "state", "national_rank", "state_rank", spec.max_distinct
    ).select(
        KEY,
        "facility_name",
        "state",
        "ownership_type",
        "certified_beds",
        "urban_rural",
        "report_quarter",
        *spec.scores,
        "readmission_rate_30d",
        "rn_hours_per_resident",
        "cna_hours_per_resident",
        "health_deficiency_count",
        "pressure_ulcer_rate",
        "fall_injury_rate",
        spec.composite,
        spec.tier,
        "national_rank",
        "state_rank",
    )


def staffing_quartiles(scores: DataFrame, spec: CompositeSpec = QUALITY) -> DataFrame:
    """Readmission and quality by quartile of nursing hours.

    Equal hours are split by facility number, so every run gives the same quartiles.
    """
    binned = ntile(
        scores.select(KEY, "rn_hours_per_resident", "readmission_rate_30d", spec.composite),
        4,
        "rn_hours_per_resident",
        KEY,
        name="rn_staffing_quartile",
    )
    quartiles = exact_means(
        binned,
        ["rn_staffing_quartile"],
        ["rn_hours_per_resident", "readmission_rate_30d"],
        {
            "facility_count": F.lit(1).cast("bigint"),
            "quality": F.col(spec.composite),
            "scored": F.when(F.col(spec.composite).isNotNull(), F.lit(1).cast("bigint")),
        },
    )
    # over the four rows; a subquery would read the facilities once more
    in_best = F.when(F.col("rn_staffing_quartile") == 4, F.col("readmission_rate_30d"))
    best = F.max(in_best).over(W.partitionBy(F.lit(1)))
    return quartiles.select(
        "rn_staffing_quartile",
        code_label(F.col("rn_staffing_quartile"), STAFFING_QUARTILE_LABELS).alias(
            "staffing_tier_label"
        ),
        "facility_count",
        rounded(F.col("rn_hours_per_resident"), 2).alias("avg_rn_hours"),
        rounded(F.col("readmission_rate_30d"), 2).alias("avg_readmission_rate"),
        rounded(ratio(F.col("quality"), F.col("scored")), 1).alias("avg_quality_score"),
        rounded(F.col("readmission_rate_30d") - best, 2).alias("readmission_gap_vs_best_staffed"),
    ).orderBy("rn_staffing_quartile")


def trajectory_segments(
    measures: DataFrame,
    facilities: DataFrame,
    last: int | None = QUARTERS_TRACKED,
    ordered: bool = True,
) -> DataFrame:
    """Change of the readmission rate from the first to the eighth quarter.

    A facility with fewer quarters has no change and counts as at risk.  ``last=None``
    compares with each facility's newest quarter instead.
    """
    rates = measures.select(KEY, "report_quarter", "readmission_rate_30d")
    if last is None:
        pivot = rates.groupBy(KEY).agg(
            F.min_by("readmission_rate_30d", "report_quarter").alias("first_value"),
            F.max_by("readmission_rate_30d", "report_quarter").alias("last_value"),
        )
    else:
        pivot = nth_period_pivot(
            rates, KEY, "report_quarter", "readmission_rate_30d", 1, last
        )
    moved = F.col("last_value") - F.col("first_value")
    segments = pivot.join(facilities.select(KEY, "facility_name", "state"), KEY).select(
        KEY,
        "facility_name",
        "state",
        rounded(F.col("first_value"), 2).alias("first_quarter_readmission"),
        rounded(F.col("last_value"), 2).alias("latest_quarter_readmission"),
        rounded(moved, 2).alias("rate_change"),
        rounded(ratio(moved, F.col("first_value")) * 100, 1).alias("pct_change"),
        TRAJECTORY_SEGMENTS.label(moved).alias("trajectory_segment"),
    )
    return segments.orderBy(F.asc_nulls_first("rate_change"), KEY) if ordered else segments


def predictive_features(measures: DataFrame) -> DataFrame:
    """Lagged, leading and rolling readmission features per facility and quarter."""
    window = periods(KEY, "report_quarter")
    rate = rounded(F.col("readmission_rate_30d"), 4)
    hours = rounded(F.col("rn_hours_per_resident"), 4)
    return measures.select(KEY, "report_quarter", rate.alias("rate"), hours.alias("hours")).select(
        KEY,
        "report_quarter",
        F.row_number().over(window).alias("quarter_num"),
        F.col("rate").alias("readmission_rate"),
        F.lag("rate", 1).over(window).alias("previous_rate"),
        F.lead("rate", 1).over(window).alias("next_rate"),
        change(F.col("rate"), window).alias("rate_change"),
        rounded(moving_mean(F.col("rate"), window, 4), 4).alias("rate_4q_avg"),
        change(F.col("hours"), window).alias("hours_change"),
    )


def above_peer_mean(scored: DataFrame, spec: CompositeSpec = QUALITY) -> DataFrame:
    """Facilities that score above the mean of their state."""
    return above_group_mean(scored, "state", spec.composite).select(
        KEY,
        "state",
        spec.composite,
        rounded(F.col("peer_mean"), 3).alias("state_mean"),
    )
