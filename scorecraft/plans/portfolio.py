"""Reports over members, claims, sources and area totals."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorecraft.functions.banding import VULNERABILITY_TIERS
from scorecraft.functions.numeric import exact_sum, mean, ratio, rounded
from scorecraft.operators.normalize import CompositeSpec, Domain, Metric, composite_scores
from scorecraft.operators.rates import Rate
from scorecraft.operators.validation import clean_records, reject_duplicates

# our own metrics and weights
SOCIAL_RISK = CompositeSpec(
    domains=(
        Domain("score_emergency", "0.35", (Metric("emergency_pct"),)),
        Domain("score_unresolved", "0.25", (Metric("unresolved_pct"),)),
        Domain("score_access", "0.20", (Metric("visit_count", inverted=True),)),
        Domain("score_income", "0.20", (Metric("income_proxy", inverted=True),)),
    ),
    composite="risk_score",
    tier="risk_tier",
    tiers=VULNERABILITY_TIERS,
    degenerate="zero",
)


def risk_stratification(members: DataFrame, spec: CompositeSpec = SOCIAL_RISK) -> DataFrame:
    """Members, mean score and cost by risk tier and population segment."""
    return (
        composite_scores(members, spec, read_along=["cost"])
        .groupBy(spec.tier, "segment")
        .agg(
            F.count(F.lit(1)).alias("members"),
            rounded(mean(F.col(spec.composite)), 2).alias("mean_score"),
            rounded(mean(F.col("cost")), 2).alias("mean_cost"),
            F.sum("cost").alias("total_cost"),
        )
    )


def claims_reimbursement(
    claims: DataFrame, min_claims: int = 50, unit: str = "1"
) -> DataFrame:
    """Paid ratio and denial rate by code group and payer, with subtotals.

    ``billed`` and ``paid`` are whole numbers of ``unit``.

    ``grouping_level`` is 0 for a pair, 1 for a code group and 3 for the grand total.
    Pairs with fewer than ``min_claims`` claims are left out (after subtotals are
    formed), and ``denial_rank`` orders the payers of a code group.
    """
    # pairs first: the rollup then expands pairs, not claims
    pairs = claims.groupBy("code_group", "payer").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("denied").alias("n_denied"),
        exact_sum(F.col("billed"), unit).alias("sum_billed"),
        exact_sum(F.col("paid"), unit).alias("sum_paid"),
    )
    levels = (
        pairs.rollup("code_group", "payer")
        .agg(
            F.grouping_id().alias("grouping_level"),
            F.sum("n").alias("claims"),
            F.sum("n_denied").alias("denied"),
            F.sum("sum_billed").alias("billed"),
            F.sum("sum_paid").alias("paid"),
        )
        .where(F.col("claims") >= min_claims)
    )
    # a code group has one row per payer here, not per claim
    by_denial = W.partitionBy("grouping_level", "code_group").orderBy(
        F.desc_nulls_last("denial_pct")
    )
    return levels.select(
        F.col("grouping_level").cast("int").alias("grouping_level"),
        "code_group",
        "payer",
        "claims",
        "denied",
        F.round("billed", 2).alias("billed"),
        F.round("paid", 2).alias("paid"),
        rounded(ratio(F.col("paid"), F.col("billed")) * 100, 2).alias("paid_pct"),
        rounded(ratio(F.col("denied"), F.col("claims")) * 100, 2).alias("denial_pct"),
    ).withColumn(
        "denial_rank", F.when(F.col("grouping_level") == 0, F.rank().over(by_denial))
    )


def clean_orders(raw: DataFrame) -> DataFrame:
    """Typed orders with a reject reason.

    Of a customer's valid orders on one day the largest is kept, the last on a tie.
    """
    typed = clean_records(
        raw,
        texts=["status", "priority_name"],
        types={
            "record_id": "bigint",
            "priority_code": "int",
            "amount": "decimal(18,2)",
            "order_date": "date",
            "customer_id": "bigint",
        },
        checks={
            "amount_out_of_range": F.col("amount").between(1000, 450000),
            "unknown_status": F.col("status").isin("o", "f", "p"),
        },
    )
    # amount in cents, then 19 digits for the record number
    version = (F.col("amount") * 100).cast("decimal(19,0)") * F.lit(Decimal(10) ** 19) + F.col(
        "record_id"
    )
    return reject_duplicates(typed, ["customer_id", "order_date"], "record_id", version)


def area_rollup(
    pooled: DataFrame, levels: Sequence[str], rates: Sequence[Rate], base: str = "base"
) -> DataFrame:
    """Totals and pooled rates from the smallest area up to the grand total.

    ``pooled`` has one row per smallest area (the last of ``levels``), so these rows are
    taken as they are, and only their totals by the level above are rolled up.
    ``grouping_level`` has one bit per level that is summed away, the last level's bit
    lowest.
    """
    *upper, smallest = levels
    names = [base, *[rate.events for rate in rates]]
    sums = [F.sum(name).alias(name) for name in names]
    above = pooled.groupBy(*upper).agg(F.count(F.lit(1)).alias("areas"), *sums)
    totals = above.rollup(*upper).agg(
        (F.shiftleft(F.grouping_id(), 1) + 1).cast("int").alias("grouping_level"),
        F.sum("areas").alias("areas"),
        *sums,
    )
    leaves = pooled.select(
        F.lit(0).alias("grouping_level"), *levels, F.lit(1).cast("bigint").alias("areas"), *names
    )
    no_leaf = F.lit(None).cast(pooled.schema[smallest].dataType)
    return leaves.unionByName(totals.withColumn(smallest, no_leaf)).select(
        "grouping_level",
        *levels,
        "areas",
        base,
        *[
            rounded(ratio(rate.factor * F.col(rate.events), F.col(base)), 3).alias(rate.name)
            for rate in rates
        ],
    )
