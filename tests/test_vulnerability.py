"""Composite scorecard and the readings taken from it."""

from __future__ import annotations

import pytest

from scorecraft.functions.banding import VULNERABILITY_TIERS
from scorecraft.operators.rates import (
    Rate,
    allocate_by_share,
    benchmark_excess,
    flag_small_base,
    pooled_rates,
    provider_density,
)
from scorecraft.plans import vulnerability as vul

SCHEMA = (
    "zip_code string, community_name string, region_type string, "
    "maternal_mortality_rate double, preterm_birth_rate double, late_no_prenatal_pct double, "
    "low_birthweight_rate double, csection_rate double, obgyn_per_10k_women double"
)
AREAS = [
    ("00001", "Z1", "Urban", 30.0, 20.0, 40.0, 18.0, 30.0, 0.0),
    ("00002", "Z2", "Rural", 20.0, 15.0, 25.0, 12.0, 30.0, 5.0),
    ("00003", "Z3", "Rural", 10.0, 10.0, 10.0, 6.0, 30.0, 10.0),
    ("00004", "Z4", "Urban", 20.0, 15.0, 25.0, 12.0, 30.0, None),
]


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame(AREAS, SCHEMA)


def num(value):
    return None if value is None else float(value)


def test_scorecard(areas):
    got = vul.composite_scorecard(areas).collect()
    assert [(r.zip_code, num(r.composite_score), r.risk_tier, r.vulnerability_rank) for r in got] == [
        ("00001", 90.0, "Critical", 1),
        ("00002", 45.0, "Moderate", 2),
        ("00003", 0.0, "Low", 3),
        ("00004", None, "Low", 4),
    ]
    scores = {r.zip_code: [num(r[name]) for name in vul.VULNERABILITY.scores] for r in got}
    assert scores["00001"] == [10, 10, 10, 10, 0, 10]
    assert scores["00002"] == [5, 5, 5, 5, 0, 5]
    assert scores["00003"] == [0] * 6
    assert scores["00004"] == [5, 5, 5, 5, 0, None]


def test_ties_share_a_rank_and_leave_a_gap(spark):
    twice = spark.createDataFrame([*AREAS, ("00005", "Z5", "Rural", *AREAS[1][3:])], SCHEMA)
    got = vul.composite_scorecard(twice).collect()
    assert [r.vulnerability_rank for r in got] == [1, 2, 2, 4, 5]
    assert [r.zip_code for r in got] == ["00001", "00002", "00005", "00003", "00004"]


@pytest.mark.parametrize(
    "score, tier",
    [("78", "Critical"), ("74", "Critical"), ("61", "High"), ("52", "High"), ("48", "Moderate"),
     ("22", "Low"), ("70", "Critical"), ("50", "High"), ("30", "Moderate"), ("29.9", "Low")],
)
def test_published_tiers(spark, score, tier):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        VULNERABILITY_TIERS.label(F.lit(score).cast("decimal(6,1)")).alias("tier")
    ).first()
    assert row.tier == tier


def test_weights_sum_to_one():
    from decimal import Decimal

    assert sum(Decimal(d.weight) for d in vul.VULNERABILITY.domains) == 1
    assert vul.VULNERABILITY.max_distinct == 1002


def test_score_ignores_scale_and_row_order(spark, areas):
    from pyspark.sql import functions as F

    rescaled = areas.withColumn("preterm_birth_rate", F.col("preterm_birth_rate") * 8 + 3)
    rescaled = rescaled.orderBy(F.desc("zip_code"))
    before = vul.composite_scorecard(areas).collect()
    assert vul.composite_scorecard(rescaled).collect() == before


def test_disparity_gap(spark):
    scored = spark.createDataFrame(
        [("a", "m", 78), ("b", "m", 22), ("c", "r", 61), ("d", "r", 48), ("e", "x", None)],
        "zip_code string, parent string, composite_score int",
    )
    got = {(r.level, r.parent): (r.areas, r.gap) for r in
           vul.disparity_gap(scored, "parent").collect()}
    assert got == {
        ("parent", "m"): (2, 56),
        ("parent", "r"): (2, 13),
        ("parent", "x"): (1, None),
        ("overall", None): (5, 56),
    }


def test_primary_driver(areas):
    got = {r.zip_code: (r.primary_driver, r.drivers, num(r.driver_points)) for r in
           vul.primary_driver(vul.scored_areas(areas)).collect()}
    assert got["00001"] == ("score_mortality", "score_mortality", 25.0)
    assert got["00002"] == ("score_mortality", "score_mortality", 12.5)
    assert got["00003"] == (None, None, None)
    assert got["00004"] == (None, None, None)


def test_tied_drivers_keep_declared_order(spark):
    values = [("1", "a", "u", 0.0, 10.0, 10.0, 0.0, 0.0, 5.0),
              ("2", "b", "u", 10.0, 0.0, 0.0, 10.0, 10.0, 5.0)]
    scored = vul.scored_areas(spark.createDataFrame(values, SCHEMA))
    row = vul.primary_driver(scored).where("zip_code = '1'").first()
    assert row.drivers == "score_preterm+score_prenatal_care"
    assert row.primary_driver == "score_preterm"


def test_region_contrast(areas):
    got = {(r.region_type, r.metric): (num(r.mean_value), num(r.difference)) for r in
           vul.region_contrast(areas, "Rural").collect()}
    assert got["Urban", "preterm_birth_rate"] == (17.5, 5.0)
    assert got["Rural", "preterm_birth_rate"] == (12.5, 0.0)
    assert got["Urban", "obgyn_per_10k_women"] == (0.0, -7.5)  # NULL is not averaged


RATES = (Rate("rate", "events", 100),)


def test_pooled_rate_is_ratio_of_sums(spark):
    counts = spark.createDataFrame(
        [("a", 2019, 100, 10), ("a", 2020, 10, 10), ("a", 2024, 1, 1), ("b", 2019, 0, 0)],
        "area string, year int, base bigint, events bigint",
    )
    got = {r.area: (r.base, r.rate) for r in
           pooled_rates(counts, ["area"], RATES, years=(2019, 2023)).collect()}
    assert got["a"] == (110, pytest.approx(2000 / 110))
    assert got["b"] == (0, None)


def test_benchmark_excess(spark):
    pooled = pooled_rates(
        spark.createDataFrame(
            [("a", 100, 30), ("b", 300, 10), ("c", 0, 0)], "area string, base bigint, events bigint"
        ), ["area"], RATES)
    got = {r.area: num(r.rate_excess_pct) for r in benchmark_excess(pooled, RATES).collect()}
    assert got == {"a": 200.0, "b": -66.67, "c": None}  # cohort rate is 10


def test_excess_over_the_parent(spark):
    pooled = pooled_rates(
        spark.createDataFrame(
            [("a", "p", 100, 30), ("b", "p", 300, 10), ("c", "q", 50, 5), ("d", "q", 50, 15),
             ("e", None, 10, 1), ("f", "r", 0, 0)],
            "area string, parent string, base bigint, events bigint"),
        ["area", "parent"], RATES)
    got = {r.area: num(r.rate_excess_pct)
           for r in benchmark_excess(pooled, RATES, parent="parent").collect()}
    assert got == {"a": 200.0, "b": -66.67, "c": -50.0, "d": 50.0, "e": 0.0, "f": None}


def test_small_base(spark):
    df = spark.createDataFrame([("a", 29), ("b", 30), ("c", None)], "area string, base int")
    got = {r.area: r.small_base for r in flag_small_base(df, 30).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_allocation(spark):
    children = spark.createDataFrame(
        [("z1", "p", 30), ("z2", "p", 10), ("z3", "q", 0), ("z4", "r", 5)],
        "area string, parent string, base int",
    )
    parents = spark.createDataFrame(
        [("p", 8.0), ("q", 5.0), ("r", 7.0)], "parent string, value double"
    )
    got = {r.area: (num(r.share), num(r.allocated)) for r in
           allocate_by_share(children, parents, "parent", "base", "value").collect()}
    assert got == {"z1": (0.75, 6.0), "z2": (0.25, 2.0), "z3": (None, None), "z4": (1.0, 7.0)}


def test_density_without_providers_is_zero(spark):
    areas = spark.createDataFrame([("a",), ("b",), ("c",)], "area string")
    providers = spark.createDataFrame([("a", 3)], "area string, n bigint")
    population = spark.createDataFrame([("a", 15000), ("b", 500)], "area string, n bigint")
    got = {r.area: (r.providers, r.density) for r in
           provider_density(areas, providers, population, "area").collect()}
    assert got == {"a": (3, 2.0), "b": (0, 0.0), "c": (0, None)}
    low = provider_density(areas, providers, population, "area", threshold=2.0)
    assert {r.area: r.low_access for r in low.collect()} == {"a": False, "b": True, "c": None}
