"""Earned value, trends, flags and summary on hand-checked rows."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scorecraft.plans import performance as perf

WEEKLY = (
    "workstream_id string, report_week int, report_date date, planned_value decimal(18,2), "
    "earned_value decimal(18,2), actual_cost decimal(18,2), pct_complete_actual decimal(9,2), "
    "pct_complete_planned decimal(9,2), budget_at_completion decimal(18,2)"
)
ROWS = [
    ("A", 1, 100, 90, 100, 9, 10, 1000),
    ("A", 2, 100, 100, 100, 20, 20, 1000),
    ("A", 3, 100, 120, 100, 32, 30, 1000),
    ("A", 4, 100, 110, 100, 43, 40, 1000),
    ("A", 5, 100, 80, 100, 51, 50, 1000),
    ("B", 5, 0, 0, 0, 0, 0, 500),
    ("C", 5, 100, "84.96", 100, 40, 45, 1000),
    ("D", 5, 50, 0, 50, 0, 10, 300),
]


def weekly(spark, rows):
    day = datetime.date(2024, 1, 1)
    values = [
        (ws, week, day, *[None if v is None else Decimal(v) for v in amounts])
        for ws, week, *amounts in rows
    ]
    return spark.createDataFrame(values, WEEKLY)


def names(spark, ids):
    return spark.createDataFrame(
        [(i, f"stream {i}") for i in ids], "workstream_id string, workstream_name string"
    )


@pytest.fixture(scope="module")
def metrics(spark):
    return perf.earned_value(weekly(spark, ROWS), names(spark, "ABCD"))


def rows(df, *columns):
    return [tuple(None if v is None else v if isinstance(v, str) else float(v) for v in row)
            for row in df.select(*columns).collect()]


def test_earned_value(metrics):
    got = rows(
        metrics.orderBy("workstream_id", "report_week"),
        "workstream_id", "report_week", "cost_variance", "cpi", "spi", "eac",
    )
    assert got == [
        ("A", 1, -10.0, 0.9, 0.9, 1111.11),
        ("A", 2, 0.0, 1.0, 1.0, 1000.0),
        ("A", 3, 20.0, 1.2, 1.2, 833.33),
        ("A", 4, 10.0, 1.1, 1.1, 909.09),
        ("A", 5, -20.0, 0.8, 0.8, 1250.0),
        ("B", 5, 0.0, None, None, None),
        ("C", 5, -15.04, 0.85, 0.85, 1177.02),
        ("D", 5, -50.0, 0.0, 0.0, None),
    ]


def test_variance_at_completion_uses_unrounded_estimate(spark):
    # 10 / (3 / 1) = 3.3333..., 10 - 3.3333... = 6.6667 rounds to 6.67
    df = perf.earned_value(weekly(spark, [("A", 1, 1, 3, 1, 1, 1, 10)]), names(spark, "A"))
    assert rows(df, "eac", "variance_at_completion") == [(3.33, 6.67)]


def test_unknown_workstream_is_dropped(spark):
    assert perf.earned_value(weekly(spark, ROWS), names(spark, "BC")).count() == 2


def test_variance_trend(metrics):
    got = rows(
        perf.variance_trend(metrics).where("workstream_id = 'A'").orderBy("report_week"),
        "cv_wow_change", "cpi_4wk_avg", "cumulative_actual_cost",
    )
    assert got == [
        (None, 0.9, 100.0),
        (10.0, 0.95, 200.0),
        (20.0, 1.033, 300.0),
        (-10.0, 1.05, 400.0),
        (-30.0, 1.025, 500.0),
    ]


def test_moving_average_counts_rows_not_weeks(spark):
    kept = [row for row in ROWS if row[:2] != ("A", 3)]
    trend = perf.variance_trend(perf.earned_value(weekly(spark, kept), names(spark, "A")))
    got = rows(trend.orderBy("report_week"), "report_week", "cpi_4wk_avg")
    assert got[-1] == (5.0, 0.95)  # mean of .9, 1, 1.1, .8


def test_moving_average_skips_nulls(spark):
    values = [("A", 1, 1, 1, 0, 1, 1, 9), ("A", 2, 1, 1, 1, 1, 1, 9), ("A", 3, 1, 1, 2, 1, 1, 9)]
    trend = perf.variance_trend(perf.earned_value(weekly(spark, values), names(spark, "A")))
    assert rows(trend.orderBy("report_week"), "cpi_4wk_avg") == [(None,), (1.0,), (0.75,)]


def test_risk_flags(metrics):
    flags = perf.risk_flags(metrics)
    got = rows(flags, "workstream_id", *perf.FLAGS)
    by_name = {row[0]: row[1:] for row in got}
    assert by_name == {
        "A": ("CRITICAL", "CRITICAL", "ON_TRACK", "CRITICAL"),
        "B": ("ON_TRACK", "ON_TRACK", "ON_TRACK", "UNDER_BUDGET"),
        "C": ("HIGH", "HIGH", "WATCH", "CRITICAL"),
        "D": ("CRITICAL", "CRITICAL", "HIGH", "UNDER_BUDGET"),
    }
    assert [row[0] for row in got] == ["B", "D", "A", "C"]  # worst first, NULL before all


def test_latest_week_is_per_workstream_and_keeps_ties(spark):
    values = [
        ("A", 1, 1, 1, 1, 1, 1, 9),
        ("A", 2, 1, 1, 1, 1, 1, 9),
        ("A", 2, 1, 2, 1, 1, 1, 9),
        ("B", 1, 1, 1, 1, 1, 1, 9),
    ]
    df = perf.earned_value(weekly(spark, values), names(spark, "AB"))
    got = sorted(rows(perf.current_performance(df), "workstream_id", "report_week", "ev"))
    assert got == [("A", 2.0, 1.0), ("A", 2.0, 2.0), ("B", 1.0, 1.0)]


def test_high_cost_index_is_watched_but_not_high_schedule_index(spark):
    df = perf.earned_value(weekly(spark, [("A", 1, 10, 12, 10, 1, 1, 9)]), names(spark, "A"))
    assert rows(perf.risk_flags(df), "cost_risk_flag", "schedule_risk_flag") == [
        ("WATCH", "ON_TRACK")
    ]


def test_program_summary(metrics):
    (got,) = rows(perf.program_summary(metrics), "*")
    assert got == (250.0, 2800.0, 8.9, 22.8, 26.3, 0.55, 0.55, 3.0, 3.0, -372.98)


def test_program_summary_options(metrics):
    paired = perf.program_summary(metrics, paired_overrun=True)
    assert rows(paired, "total_projected_overrun") == [(427.02,)]
    running = perf.program_summary(metrics, cost_basis="running")
    assert rows(running, "total_actual_cost_to_date") == [(650.0,)]
    with pytest.raises(ValueError):
        perf.program_summary(metrics, cost_basis="guess")


def test_program_summary_of_nothing_is_one_row(metrics):
    (got,) = rows(perf.program_summary(metrics.where("1 = 0")), "*")
    assert got == (None,) * 7 + (0.0, 0.0, None)


def test_published_counters(spark):
    """Five workstreams whose published indexes give two over budget and three behind."""
    published = [("1", 102, 93), ("2", 88, 72), ("3", 94, 76), ("4", 103, 106)]
    values = [
        (ws, 24, Decimal(100 * cpi) / spi, cpi, 100, 1, 1, 1000) for ws, cpi, spi in published
    ] + [("5", 24, 0, 0, 0, 0, 0, 1000)]
    df = perf.earned_value(weekly(spark, values), names(spark, "12345"))
    summary = perf.program_summary(df)
    assert rows(summary, "workstreams_over_budget", "workstreams_behind_schedule") == [(2.0, 3.0)]


def test_flag_register_and_status(metrics):
    flags = perf.risk_flags(metrics)
    register = sorted(rows(perf.flag_register(flags), "workstream_id", "risk_type", "severity"))
    assert register == [
        ("A", "budget", "CRITICAL"), ("A", "cost", "CRITICAL"), ("A", "schedule", "CRITICAL"),
        ("C", "budget", "CRITICAL"), ("C", "completion", "WATCH"), ("C", "cost", "HIGH"),
        ("C", "schedule", "HIGH"),
        ("D", "completion", "HIGH"), ("D", "cost", "CRITICAL"), ("D", "schedule", "CRITICAL"),
    ]
    status = dict(rows(perf.workstream_status(flags), "workstream_id", "status"))
    assert status == {"A": "CRITICAL", "B": "ON_TRACK", "C": "CRITICAL", "D": "CRITICAL"}


def test_workstream_that_has_not_started(spark):
    values = [("A", 1, 0, 0, 0, 0, 0, 9), ("B", 1, 1, 1, 1, 1, 1, 9), ("C", 1, 0, 0, 0, 0, 30, 9)]
    flags = perf.risk_flags(perf.earned_value(weekly(spark, values), names(spark, "ABC")))
    status = dict(rows(perf.workstream_status(flags, "NOT_STARTED"), "workstream_id", "status"))
    assert status == {"A": "NOT_STARTED", "B": "ON_TRACK", "C": "CRITICAL"}


def test_declining_streak(spark):
    def series(ws, indexes):
        return [(ws, i + 1, 100, v, 0 if v is None else 100, 1, 1, 9)
                for i, v in enumerate(indexes)]

    values = (
        series("A", [100, 99, 98, 97])       # three falls
        + series("B", [100, 90, 95, 94])     # one fall after a rise
        + series("C", [100])                 # too short
        + series("D", [100, 90, 90])         # standing still is not falling
    )
    df = perf.earned_value(weekly(spark, values), names(spark, "ABCD"))
    got = rows(perf.declining_streak(df).orderBy("workstream_id"),
               "workstream_id", "falling_weeks", "alert")
    assert got == [("A", 3, 1), ("B", 1, 0), ("C", 0, 0), ("D", 0, 0)]


def test_undefined_index_breaks_a_streak(spark):
    values = [("A", 1, 100, 99, 100, 1, 1, 9), ("A", 2, 100, 98, 0, 1, 1, 9),
              ("A", 3, 100, 97, 100, 1, 1, 9), ("A", 4, 100, 96, 100, 1, 1, 9)]
    df = perf.earned_value(weekly(spark, values), names(spark, "A"))
    assert rows(perf.declining_streak(df), "falling_weeks") == [(1.0,)]


def test_program_scorecard(metrics):
    card = {row[0]: row[1:] for row in
            rows(perf.program_scorecard(perf.program_summary(metrics)), "*")}
    assert card == {
        "pct_complete_gap": (-3.5, "WATCH"),
        "program_cpi": (0.55, "CRITICAL"),
        "program_spi": (0.55, "CRITICAL"),
        "workstreams_over_budget": (3.0, "HIGH"),
        "workstreams_behind_schedule": (3.0, "HIGH"),
        "total_projected_overrun": (-372.98, "UNDER_BUDGET"),
        "overrun_pct_of_budget": (-13.3, "UNDER_BUDGET"),
    }


def test_trend_alert_enters_the_register(spark, metrics):
    flags = perf.risk_flags(metrics)
    some = flags.select("workstream_id").first()[0]
    streaks = flags.select("workstream_id").withColumns(
        {"falling_weeks": F.lit(4), "alert": F.col("workstream_id") == F.lit(some)}
    )
    trend = perf.flag_register(flags, streaks).where("risk_type = 'trend'").collect()
    assert [(r.workstream_id, r.severity, r.value) for r in trend] == [(some, "WATCH", 4.0)]
