"""Quality scores, staffing quartiles, trajectories and features."""

from __future__ import annotations

import pytest

from scorecraft.plans import facility_quality as fq

MEASURES = (
    "cms_certification_number string, report_quarter string, readmission_rate_30d double, "
    "hospital_transfer_rate double, pressure_ulcer_rate double, fall_injury_rate double, "
    "pain_management_rate double, rn_hours_per_resident double, cna_hours_per_resident double, "
    "health_deficiency_count int"
)
FACILITIES = (
    "cms_certification_number string, facility_name string, state string, "
    "ownership_type string, certified_beds int, urban_rural string"
)


def facilities(spark, *pairs):
    return spark.createDataFrame(
        [(ccn, f"home {ccn}", state, "Private", 50, "Urban") for ccn, state in pairs], FACILITIES
    )


def num(value):
    return None if value is None else float(value)


GOOD = (10.0, 5.0, 1.0, 1.0, 90.0, 2.0, 4.0, 0)
FAIR = (15.0, 10.0, 2.0, 2.0, 80.0, 1.5, 3.0, 5)
POOR = (20.0, 15.0, 3.0, 3.0, 70.0, 1.0, 2.0, 10)


def test_quality_scores(spark):
    measures = spark.createDataFrame(
        [("001", "2024Q1", *POOR), ("001", "2024Q2", *GOOD), ("002", "2024Q2", *FAIR),
         ("003", "2024Q2", *POOR), ("004", "2024Q1", *GOOD)], MEASURES)
    homes = facilities(spark, ("001", "IL"), ("002", "IL"), ("003", "WI"), ("004", "WI"))
    got = {r.cms_certification_number: r for r in fq.quality_scores(measures, homes).collect()}
    assert set(got) == {"001", "002", "003"}  # 004 did not report in the newest quarter
    shown = {k: (num(r.composite_quality_score), r.quality_tier, r.national_rank, r.state_rank)
             for k, r in got.items()}
    assert shown == {
        "001": (100.0, "Excellent", 1, 1),
        "002": (50.0, "Fair", 2, 2),
        "003": (0.0, "Poor", 3, 1),
    }


def test_constant_measure_makes_everything_null(spark):
    flat = (10.0, 5.0, 1.0, 1.0, 90.0, 2.0, 4.0, 3)
    measures = spark.createDataFrame(
        [("1", "q", *GOOD[:-1], 3), ("2", "q", *POOR[:-1], 3), ("3", "q", *flat)], MEASURES)
    homes = facilities(spark, ("1", "IL"), ("2", "IL"), ("3", "WI"))
    got = fq.quality_scores(measures, homes).collect()
    assert {(r.score_compliance, r.composite_quality_score, r.quality_tier, r.national_rank,
             r.state_rank) for r in got} == {(None, None, "Poor", 1, 1)}
    assert {num(r.score_readmission) for r in got} == {10.0, 0.0}


def test_unlisted_facility_sets_the_quarter_but_not_the_bounds(spark):
    measures = spark.createDataFrame(
        [("1", "2024Q1", *GOOD), ("1", "2024Q2", *FAIR), ("2", "2024Q2", *POOR),
         ("x", "2024Q2", *[v * 100 for v in POOR[:-1]], 999)], MEASURES)
    homes = facilities(spark, ("1", "IL"), ("2", "IL"))
    got = {r.cms_certification_number: num(r.composite_quality_score)
           for r in fq.quality_scores(measures, homes).collect()}
    assert got == {"1": 100.0, "2": 0.0}
    only_x_newer = measures.union(spark.createDataFrame([("x", "2024Q3", *GOOD)], MEASURES))
    assert fq.quality_scores(only_x_newer, homes).count() == 0


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "cms_certification_number string, rn_hours_per_resident double, "
        "readmission_rate_30d double, composite_quality_score decimal(6,1)")


def test_quartiles_of_five_and_three(spark):
    from decimal import Decimal

    five = scored(spark, [(str(i), float(i), 10.0 * i, Decimal(i)) for i in range(1, 6)])
    got = fq.staffing_quartiles(five).collect()
    assert [(r.rn_staffing_quartile, r.facility_count, num(r.avg_rn_hours),
             num(r.avg_readmission_rate), num(r.readmission_gap_vs_best_staffed)) for r in got] == [
        (1, 2, 1.5, 15.0, -35.0), (2, 1, 3.0, 30.0, -20.0), (3, 1, 4.0, 40.0, -10.0),
        (4, 1, 5.0, 50.0, 0.0)]
    assert got[0].staffing_tier_label == "Q1 — Lowest Staffing"
    three = fq.staffing_quartiles(five.where("rn_hours_per_resident < 4")).collect()
    assert [(r.rn_staffing_quartile, r.facility_count) for r in three] == [(1, 1), (2, 1), (3, 1)]
    assert {r.readmission_gap_vs_best_staffed for r in three} == {None}


def quarters(ccn, rates):
    return [(ccn, f"20{20 + i // 4}Q{i % 4 + 1}", rate, *[0.0] * 6, 0)
            for i, rate in enumerate(rates)]


@pytest.mark.parametrize(
    "change, segment",
    [(-3.0, "Rising Star"), (-2.99, "Improving"), (-1.0, "Improving"), (-0.99, "Stable"),
     (1.0, "Stable"), (1.01, "Declining"), (3.0, "Declining"), (3.01, "At Risk")],
)
def test_trajectory_bands(spark, change, segment):
    measures = spark.createDataFrame(quarters("1", [10.0] * 7 + [10.0 + change]), MEASURES)
    row = fq.trajectory_segments(measures, facilities(spark, ("1", "IL"))).first()
    assert row.trajectory_segment == segment
    assert num(row.rate_change) == change


def test_trajectory_counts_quarters(spark):
    measures = spark.createDataFrame(
        quarters("seven", [5.0] * 7) + quarters("nine", [5.0] * 7 + [6.0, 99.0])
        + quarters("zero", [0.0] * 7 + [2.0]) + quarters("unlisted", [5.0] * 8), MEASURES)
    homes = facilities(spark, ("seven", "IL"), ("nine", "IL"), ("zero", "IL"))
    got = fq.trajectory_segments(measures, homes).collect()
    assert got[0].cms_certification_number == "seven"  # NULL change first
    shown = {r.cms_certification_number:
             (num(r.latest_quarter_readmission), num(r.pct_change), r.trajectory_segment)
             for r in got}
    assert shown == {
        "seven": (None, None, "At Risk"),
        "nine": (6.0, 20.0, "Stable"),
        "zero": (2.0, None, "Declining"),
    }
    newest = {r.cms_certification_number: num(r.latest_quarter_readmission) for r in
              fq.trajectory_segments(measures, homes, last=None).collect()}
    assert newest == {"seven": 5.0, "nine": 99.0, "zero": 2.0}


def test_predictive_features(spark):
    measures = spark.createDataFrame(quarters("1", [1.0, 2.0, 6.0, 3.0, 8.0]), MEASURES)
    got = [(r.quarter_num, num(r.previous_rate), num(r.next_rate), num(r.rate_change),
            num(r.rate_4q_avg))
           for r in fq.predictive_features(measures).orderBy("quarter_num").collect()]
    assert got == [
        (1, None, 2.0, None, 1.0), (2, 1.0, 6.0, 1.0, 1.5), (3, 2.0, 3.0, 4.0, 3.0),
        (4, 6.0, 8.0, -3.0, 3.0), (5, 3.0, None, 5.0, 4.75)]


def test_above_peer_mean(spark):
    from decimal import Decimal

    df = spark.createDataFrame(
        [("1", "IL", Decimal(10)), ("2", "IL", Decimal(20)), ("3", "IL", None),
         ("4", "WI", Decimal(7))],
        "cms_certification_number string, state string, composite_quality_score decimal(6,1)")
    got = [(r.cms_certification_number, num(r.state_mean)) for r in fq.above_peer_mean(df).collect()]
    assert got == [("2", 15.0)]
