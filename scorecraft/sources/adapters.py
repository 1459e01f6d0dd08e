"""Scorecard inputs derived from the star schema.

Where a fact is grouped by the key it is joined on (lines to orders, lines to
facilities) it is reduced first, with map-side partial sums, so that an order or a
facility with a large share of the lines reaches a reducer as one row per map task
and the join reuses the aggregate's partitioning.  Where a dimension only supplies the
grouping column (supplier to nation, part to code group) the lines are joined as they
are: grouping by the finer key first would shuffle more.

Joins of stored tables carry no hints: Catalyst broadcasts a side only when its
measured size is under the session's threshold and otherwise shuffles both, with AQE
splitting the partitions of a hot key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorecraft.functions.numeric import exact_sum, hundredths, ratio, rounded
from scorecraft.operators.joins import broadcast_if_counted
from scorecraft.operators.rates import Rate, pooled_rates, provider_density
from scorecraft.sources.tables import StarSchema

FIRST_YEAR, LAST_YEAR = 1996, 2000

# events counted per order line, and the factor each is reported by
AREA_RATES = (
    Rate("maternal_mortality_rate", "mortality_events", 100000),
    Rate("preterm_birth_rate", "preterm_events", 100),
    Rate("late_no_prenatal_pct", "prenatal_events", 100),
    Rate("low_birthweight_rate", "low_birthweight_events", 100),
    Rate("csection_rate", "csection_events", 100),
)


CENT, CENT_PERCENT = "0.01", "0.0001"  # worth of a unit: hundredths, and their product


# ---- program performance ----


def workstreams(db: StarSchema) -> DataFrame:
    return db.table("nation").select(
        F.col("n_nationkey").cast("bigint").alias("workstream_id"),
        F.col("n_name").alias("workstream_name"),
    )


def weekly_performance(db: StarSchema) -> DataFrame:
    """Workstream (the supplier's nation) by week of shipment."""
    price = hundredths(F.col("l_extendedprice"))
    lines = db.table("lineitem").select(
        "l_suppkey",
        F.trunc(F.to_date("l_shipdate"), "week").alias("report_week"),
        price.alias("price"),
        (price * (100 + hundredths(F.col("l_tax")))).alias("gross"),
        "l_linestatus",
        "l_returnflag",
    )
    suppliers = db.table("supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("bigint").alias("workstream_id")
    )

    def total(units: Column, unit: str) -> Column:
        return F.coalesce(exact_sum(units, unit), F.lit(Decimal(0))).cast("decimal(18,2)")

    weekly = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("workstream_id", "report_week")
        .agg(
            # half the price of all lines, the price of finished lines, and 72 % of the
            # taxed price of lines not returned
            total(F.col("price"), "0.005").alias("planned_value"),
            total(F.when(F.col("l_linestatus") == "F", F.col("price")), CENT).alias(
                "earned_value"
            ),
            total(F.when(F.col("l_returnflag") != "R", F.col("gross")), "0.000072").alias(
                "actual_cost"
            ),
        )
    )
    # a workstream holds one row per calendar week, whatever its number of lines
    by_workstream = W.partitionBy("workstream_id")
    to_date = by_workstream.orderBy("report_week").rowsBetween(W.unboundedPreceding, 0)
    whole = F.sum("planned_value").over(by_workstream).cast("decimal(18,2)")

    def complete(name: str) -> Column:
        done = ratio(F.sum(name).over(to_date), F.col("budget_at_completion"))
        return rounded(done * 100, 2).cast("decimal(9,2)")

    return weekly.withColumn("budget_at_completion", whole).select(
        "workstream_id",
        "report_week",
        F.date_add("report_week", 6).alias("report_date"),
        "planned_value",
        "earned_value",
        "actual_cost",
        complete("earned_value").alias("pct_complete_actual"),
        complete("planned_value").alias("pct_complete_planned"),
        "budget_at_completion",
    )


def workstream_dependency(db: StarSchema) -> DataFrame:
    """Within a region each workstream waits for the one before it."""
    in_region = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    return (
        db.table("nation")
        .select(
            F.lag("n_nationkey").over(in_region).cast("bigint").alias("predecessor_id"),
            F.col("n_nationkey").cast("bigint").alias("successor_id"),
        )
        .where(F.col("predecessor_id").isNotNull())
    )


# ---- area vulnerability ----


def area_year_counts(
    db: StarSchema, years: tuple[int, int] | None = (FIRST_YEAR, LAST_YEAR)
) -> DataFrame:
    """Events and their base (order lines) per order, with its area and year.

    Only orders of ``years`` are read; None reads all.

    Rows are finer than area by year, which pooled rates do not mind: they sum.
    Reducing lines to orders first lets the join reuse the aggregate's partitioning.
    """

    def hits(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    per_order = (
        db.table("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("base"),
            hits(
                (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09),
                "mortality_events",
            ),
            hits(F.col("l_returnflag") == "R", "preterm_events"),
            hits(F.col("l_linestatus") == "O", "prenatal_events"),
            hits(F.col("l_quantity") < 10, "low_birthweight_events"),
            hits(F.col("l_tax") >= 0.07, "csection_events"),
        )
    )
    orders = db.table("orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("area_id"),
        F.col("o_orderdate").alias("event_date"),
    )
    if years:
        orders = orders.where(
            (F.col("event_date") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz"))
            & (F.col("event_date") < F.lit(f"{years[1] + 1}-01-01").cast("timestamp_ntz"))
        )
    return (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            "area_id",
            F.year("event_date").alias("year"),
            "base",
            *[rate.events for rate in AREA_RATES],
        )
    )


def pooled_area_rates(
    db: StarSchema,
    years: tuple[int, int] | None = (FIRST_YEAR, LAST_YEAR),
    of: DataFrame | None = None,
) -> DataFrame:
    """Pooled rates of every area; one without events has base 0 and NULL rates.

    ``of`` are the areas with what else is wanted of them, so that they are read once; else
    their ids only.
    """
    pooled = pooled_rates(area_year_counts(db, years), ["area_id"], AREA_RATES, years=years)
    every = db.table("customer").select(F.col("c_custkey").alias("area_id")) if of is None else of
    counts = ["base", *[rate.events for rate in AREA_RATES]]
    return every.join(pooled, "area_id", "left").na.fill(0, counts)


def providers(db: StarSchema) -> DataFrame:
    return (
        db.table("supplier")
        .groupBy(F.col("s_nationkey").alias("parent_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def population(db: StarSchema) -> DataFrame:
    return (
        db.table("customer")
        .groupBy(F.col("c_nationkey").alias("parent_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parent_areas(db: StarSchema) -> DataFrame:
    return db.table("nation").select(
        F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("parent_name")
    )


def area_density(db: StarSchema, threshold: float | None = None) -> DataFrame:
    return provider_density(
        parent_areas(db), providers(db), population(db), "parent_id", threshold=threshold
    )


def areas(db: StarSchema) -> DataFrame:
    return db.table("customer").select(
        F.col("c_custkey").alias("area_id"),
        F.col("c_name").alias("community_name"),
        F.col("c_mktsegment").alias("region_type"),
        F.col("c_nationkey").alias("parent_id"),
    )


def five_year_aggregate(db: StarSchema) -> DataFrame:
    """One row per area (customer): pooled rates, names and provider density."""
    density = area_density(db).select("parent_id", "density")
    return (
        pooled_area_rates(db, of=areas(db))
        .join(broadcast_if_counted(density, parent_areas(db)), "parent_id", "left")
        .select(
            F.col("area_id").alias("zip_code"),
            "community_name",
            "region_type",
            "parent_id",
            "base",
            *[rate.name for rate in AREA_RATES],
            F.col("density").alias("obgyn_per_10k_women"),
        )
    )


# ---- facility quality ----


def facilities(db: StarSchema) -> DataFrame:
    """Suppliers, with their nation as state."""
    nation = db.table("nation").select("n_nationkey", F.col("n_name").alias("state"))
    return (
        db.table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("cms_certification_number"),
            F.col("s_name").alias("facility_name"),
            "state",
            F.when(F.col("s_acctbal") < 0, "Government").otherwise("Private").alias(
                "ownership_type"
            ),
            (F.col("s_suppkey") % 200 + 20).cast("int").alias("certified_beds"),
            F.when(F.col("s_nationkey") % 2 == 0, "Urban").otherwise("Rural").alias(
                "urban_rural"
            ),
        )
    )


def _quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def _quarter_lines(db: StarSchema, newest: bool) -> DataFrame:
    """Order lines with their quarter.

    With ``newest``, those of the newest quarter: the line date itself is compared with
    the first day of it, so the test reaches the Parquet scan.
    """
    lines = db.table("lineitem")
    if newest:
        last = lines.agg(F.date_trunc("quarter", F.max("l_shipdate")).cast("timestamp_ntz"))
        lines = lines.where(F.col("l_shipdate") >= last.scalar())
    return lines.withColumn("quarter_day", F.trunc(F.to_date("l_shipdate"), "quarter"))


def quality_measures(db: StarSchema, newest: bool = False) -> DataFrame:
    """Facility by quarter: percentages of lines, mean hours and a deficiency count.

    All quarters, or with ``newest`` the newest one only.
    """
    lines = F.count(F.lit(1))

    def pct(condition: Column, name: str) -> Column:
        return (F.count_if(condition) * F.lit(100.0) / lines).alias(name)

    def average(name: str) -> Column:
        return ratio(exact_sum(hundredths(F.col(name)), CENT), lines)

    return (
        _quarter_lines(db, newest)
        .groupBy(F.col("l_suppkey").alias("cms_certification_number"), "quarter_day")
        .agg(
            pct(F.col("l_returnflag") == "R", "readmission_rate_30d"),
            pct(F.col("l_linestatus") == "O", "hospital_transfer_rate"),
            pct(F.col("l_discount") >= 0.08, "pressure_ulcer_rate"),
            pct(F.col("l_tax") >= 0.07, "fall_injury_rate"),
            pct(F.col("l_quantity") >= 25, "pain_management_rate"),
            (average("l_quantity") / 40).alias("rn_hours_per_resident"),
            (average("l_extendedprice") / 20000).alias("cna_hours_per_resident"),
            F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias(
                "health_deficiency_count"
            ),
        )
        .withColumn("report_quarter", _quarter_label(F.col("quarter_day")))
        .drop("quarter_day")
    )


# ---- claims, sources and raw records ----


def claims(db: StarSchema) -> DataFrame:
    """Order lines as claims: code group of the part, payer by the supplier's nation.

    Amounts count ``CENT_PERCENT``.  A returned line is denied and pays nothing.
    """
    denied = F.col("l_returnflag") == "R"
    price = hundredths(F.col("l_extendedprice"))
    paid = F.when(denied, F.lit(0)).otherwise(price * (100 - hundredths(F.col("l_discount"))))
    lines = db.table("lineitem").select(
        "l_partkey",
        "l_suppkey",
        (price * 100).alias("billed"),
        paid.alias("paid"),
        denied.alias("denied"),
    )
    codes = db.table("part").select("p_partkey", F.col("p_type").alias("code_group"))
    payers = (
        db.table("supplier")
        .join(db.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("payer"))
    )
    return (
        lines.join(codes, F.col("l_partkey") == F.col("p_partkey"))
        .join(payers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("code_group", "payer", "billed", "paid", "denied")
    )


def order_totals(db: StarSchema) -> DataFrame:
    return db.table("orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def line_totals(db: StarSchema) -> DataFrame:
    return (
        db.table("lineitem")
        .groupBy(F.col("l_orderkey").alias("record_id"))
        .agg(
            exact_sum(
                hundredths(F.col("l_extendedprice")) * (100 - hundredths(F.col("l_discount"))),
                CENT_PERCENT,
            )
            .cast("decimal(18,2)")
            .alias("amount")
        )
    )


def raw_orders(db: StarSchema) -> DataFrame:
    """Orders as text, the way an extract delivers them."""
    return db.table("orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("status"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("priority_code"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("priority_name"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.to_date("o_orderdate").cast("string").alias("order_date"),
        F.col("o_custkey").cast("string").alias("customer_id"),
    )


def members(db: StarSchema) -> DataFrame:
    """Customers with social-risk style metrics over their orders."""
    orders = db.table("orders")
    per_customer = orders.groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.count_if(F.col("o_orderstatus") == "O").alias("unresolved"),
        exact_sum(hundredths(F.col("o_totalprice")), CENT).alias("cost"),
    )
    people = db.table("customer").select(
        F.col("c_custkey").alias("member_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("income_proxy"),
    )
    # a member without orders has no visits and no cost; shares of visits stay NULL
    every = people.join(per_customer, "member_id", "left").na.fill(
        0, ["visits", "urgent", "unresolved"]
    )
    return every.select(
        "member_id",
        "segment",
        F.when(F.col("visits") == 0, F.lit(0)).otherwise(F.col("cost")).alias("cost"),
        (ratio(F.col("urgent"), F.col("visits")) * 100).alias("emergency_pct"),
        (ratio(F.col("unresolved"), F.col("visits")) * 100).alias("unresolved_pct"),
        F.col("visits").cast("double").alias("visit_count"),
        "income_proxy",
    )
