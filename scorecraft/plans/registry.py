"""Every report by name, over the star schema in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions.numeric import rounded
from scorecraft.operators.ranking import rank_unbounded
from scorecraft.operators.rates import allocate_by_share, benchmark_excess, flag_small_base
from scorecraft.operators.validation import reconcile
from scorecraft.plans import facility_quality as quality
from scorecraft.plans import performance as perf
from scorecraft.plans import portfolio, vulnerability
from scorecraft.sources import adapters, views
from scorecraft.sources.adapters import AREA_RATES
from scorecraft.sources.tables import StarSchema

SMALL_BASE = 30
BASELINE_REGION = "MACHINERY"
# fixed value: providers per 10 000 inhabitants below which access is low
ACCESS_THRESHOLD = 2.0
RATE_NAMES = [rate.name for rate in AREA_RATES]
EVENT_NAMES = [rate.events for rate in AREA_RATES]


def _metrics(db: StarSchema) -> DataFrame:
    return perf.earned_value(adapters.weekly_performance(db), adapters.workstreams(db))


def _flags(db: StarSchema) -> DataFrame:
    return perf.risk_flags(_metrics(db), ordered=False)


def _scored_areas(db: StarSchema) -> DataFrame:
    return vulnerability.scored_areas(adapters.five_year_aggregate(db))


def _quality(db: StarSchema) -> DataFrame:
    return quality.quality_scores(
        adapters.quality_measures(db, newest=True), adapters.facilities(db), newest=False
    )


def _scored_facilities(db: StarSchema) -> DataFrame:
    return quality.scored_facilities(
        adapters.quality_measures(db, newest=True), adapters.facilities(db), newest=False
    )


def _placed_areas(db: StarSchema) -> DataFrame:
    return adapters.areas(db).select("area_id", "parent_id")


def multi_year_rates(db: StarSchema) -> DataFrame:
    return adapters.pooled_area_rates(db).select(
        "area_id",
        "base",
        *EVENT_NAMES,
        *[rounded(F.col(name), 4).alias(name) for name in RATE_NAMES],
    )


def proportional_allocation(db: StarSchema) -> DataFrame:
    """The nation's mortality events, split over its customers by their lines.

    The customers' own events stay in the result, beside what they were allocated.
    """
    children = adapters.pooled_area_rates(db, of=_placed_areas(db)).select(
        "area_id", "parent_id", "base", "mortality_events"
    )
    parents = children.groupBy("parent_id").agg(
        F.sum("base").alias("parent_base"), F.sum("mortality_events").alias("parent_value")
    )
    return allocate_by_share(children, parents, "parent_id", "base", "parent_value")


def provider_density(db: StarSchema) -> DataFrame:
    density = adapters.area_density(db, threshold=ACCESS_THRESHOLD)
    return density.withColumn("density", rounded(F.col("density"), 4))


def small_base_flag(db: StarSchema) -> DataFrame:
    flagged = flag_small_base(adapters.pooled_area_rates(db), SMALL_BASE)
    rate = "maternal_mortality_rate"
    return flagged.select("area_id", "base", rounded(F.col(rate), 4).alias(rate), "small_base")


def cohort_excess(db: StarSchema) -> DataFrame:
    excess = benchmark_excess(adapters.pooled_area_rates(db), AREA_RATES)
    return excess.select("area_id", "base", *[f"{name}_excess_pct" for name in RATE_NAMES])


def parent_excess(db: StarSchema) -> DataFrame:
    placed = adapters.pooled_area_rates(db, of=_placed_areas(db))
    excess = benchmark_excess(placed, AREA_RATES, parent="parent_id")
    return excess.select(
        "area_id", "parent_id", "base", *[f"{name}_excess_pct" for name in RATE_NAMES]
    )


def rate_rank(db: StarSchema) -> DataFrame:
    """Every area's place by its unrounded rate, of which there is no bounded number."""
    rate = "maternal_mortality_rate"
    rates = adapters.pooled_area_rates(db).select("area_id", "base", rate)
    return rank_unbounded(rates, rate, "rate_rank").select(
        "area_id", "base", rounded(F.col(rate), 4).alias(rate), "rate_rank"
    )


def source_reconciliation(db: StarSchema) -> DataFrame:
    return reconcile(
        adapters.order_totals(db),
        adapters.line_totals(db),
        key="record_id",
        value="amount",
        tolerance=F.col("left_value") * F.lit(0.25).cast("decimal(3,2)"),
    )


def extract_reconciliation(db: StarSchema) -> DataFrame:
    """Order totals against those of the text extract, which agree but for what is lost."""
    extract = adapters.raw_orders(db).select(
        F.col("record_id").cast("bigint").alias("record_id"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
    )
    return reconcile(
        adapters.order_totals(db),
        extract,
        key="record_id",
        value="amount",
        tolerance=F.lit(0).cast("decimal(3,2)"),
        mostly_equal=True,
    )


def area_rollup(db: StarSchema) -> DataFrame:
    nation, region = db.table("nation"), db.table("region")
    counties = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("parent_id"),
        F.col("r_name").alias("state"),
        F.col("n_name").alias("county"),
    )
    placed = (
        adapters.pooled_area_rates(db, years=None, of=_placed_areas(db))
        .join(counties, "parent_id")
        .withColumnRenamed("area_id", "zip_code")
    )
    return portfolio.area_rollup(placed, ["state", "county", "zip_code"], AREA_RATES)


REPORTS: dict[str, Callable[[StarSchema], DataFrame]] = {
    "earned_value": _metrics,
    "variance_trend": lambda db: perf.variance_trend(_metrics(db)),
    "risk_flags": lambda db: perf.risk_flags(_metrics(db)),
    "program_summary": lambda db: perf.program_summary(_metrics(db)),
    "composite_scorecard": lambda db: vulnerability.composite_scorecard(
        adapters.five_year_aggregate(db)
    ),
    "quality_scores": _quality,
    "staffing_quartiles": lambda db: quality.staffing_quartiles(_scored_facilities(db)),
    "trajectory_segments": lambda db: quality.trajectory_segments(
        adapters.quality_measures(db), adapters.facilities(db)
    ),
    "multi_year_rates": multi_year_rates,
    "proportional_allocation": proportional_allocation,
    "provider_density": provider_density,
    "disparity_gap": lambda db: vulnerability.disparity_gap(_scored_areas(db), "parent_id"),
    "benchmark_excess": cohort_excess,
    "parent_excess": parent_excess,
    "primary_driver": lambda db: vulnerability.primary_driver(_scored_areas(db)),
    "small_base_flag": small_base_flag,
    "rate_rank": rate_rank,
    "region_contrast": lambda db: vulnerability.region_contrast(
        adapters.five_year_aggregate(db), BASELINE_REGION
    ),
    "flag_register": lambda db: perf.flag_register(
        _flags(db), perf.declining_streak(_metrics(db))
    ),
    "watch_list": lambda db: views.query(db, "SELECT * FROM vw_watch_list", "vw_watch_list"),
    "workstream_status": lambda db: perf.workstream_status(_flags(db), "NOT_STARTED"),
    "declining_streak": lambda db: perf.declining_streak(_metrics(db)),
    "program_scorecard": lambda db: perf.program_scorecard(perf.program_summary(_metrics(db))),
    "delay_cascade": lambda db: perf.delay_cascade(
        _flags(db), adapters.workstream_dependency(db)
    ),
    "risk_stratification": lambda db: portfolio.risk_stratification(adapters.members(db)),
    "claims_reimbursement": lambda db: portfolio.claims_reimbursement(
        adapters.claims(db), unit=adapters.CENT_PERCENT
    ),
    "source_reconciliation": source_reconciliation,
    "extract_reconciliation": extract_reconciliation,
    "clean_normalize": lambda db: portfolio.clean_orders(adapters.raw_orders(db)),
    "predictive_features": lambda db: quality.predictive_features(adapters.quality_measures(db)),
    "above_peer_mean": lambda db: quality.above_peer_mean(_scored_facilities(db)),
    "area_rollup": area_rollup,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """One report; amounts and rounded values are decimals."""
    return REPORTS[name](StarSchema(spark, folder))
