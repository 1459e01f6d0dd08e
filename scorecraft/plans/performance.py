"""Program performance: earned value, trends, risk flags and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.banding import (
    BUDGET_EXPOSURE,
    COMPLETION_SEVERITY,
    COST_SEVERITY,
    SCHEDULE_SEVERITY,
    SLIP_THRESHOLD,
    severity_level,
    severity_name,
)
from scorecraft.functions.numeric import MONEY, mean, ratio, rounded
from scorecraft.operators.cascade import propagate_level
from scorecraft.operators.snapshot import latest_per_key
from scorecraft.operators.trend import (
    change,
    current_falling_run,
    moving_mean,
    periods,
    running_total,
)
from scorecraft.sources.tables import require_columns

FLAGS = ("cost_risk_flag", "schedule_risk_flag", "completion_risk_flag", "budget_exposure_flag")


def earned_value(weekly: DataFrame, workstreams: DataFrame) -> DataFrame:
    """Earned-value metrics per workstream and week.

    EAC divides by the unrounded cost ratio, and the variance at completion subtracts
    the unrounded EAC.  Weeks of unknown workstreams are dropped.
    """
    require_columns(
        weekly, "workstream_id", "report_week", "planned_value", "earned_value", "actual_cost"
    )
    pv, ev, ac = F.col("planned_value"), F.col("earned_value"), F.col("actual_cost")
    bac = F.col("budget_at_completion")
    eac = ratio(bac, ratio(ev, ac))
    return weekly.join(workstreams, "workstream_id").select(
        "workstream_id",
        "workstream_name",
        "report_week",
        "report_date",
        pv.alias("pv"),
        ev.alias("ev"),
        ac.alias("ac"),
        F.round(ev - ac, 2).alias("cost_variance"),
        F.round(ev - pv, 2).alias("schedule_variance"),
        rounded(ratio(ev, ac), 3).alias("cpi"),
        rounded(ratio(ev, pv), 3).alias("spi"),
        "pct_complete_actual",
        "pct_complete_planned",
        F.round(F.col("pct_complete_actual") - F.col("pct_complete_planned"), 2).alias(
            "pct_complete_variance"
        ),
        rounded(eac, 2, MONEY).alias("eac"),
        bac.alias("bac"),
        rounded(bac.cast("double") - eac, 2, MONEY).alias("variance_at_completion"),
    )


def variance_trend(metrics: DataFrame) -> DataFrame:
    """Weekly change of the cost variance, four-row mean CPI and cumulative cost."""
    window = periods("workstream_id", "report_week")
    return metrics.select(
        "workstream_id",
        "workstream_name",
        "report_week",
        "cpi",
        "spi",
        "cost_variance",
        "schedule_variance",
        "pct_complete_actual",
        "pct_complete_planned",
        "pct_complete_variance",
        F.round(change(F.col("cost_variance"), window), 2).alias("cv_wow_change"),
        rounded(moving_mean(F.col("cpi"), window, 4), 3).alias("cpi_4wk_avg"),
        running_total(F.col("ac"), window).alias("cumulative_actual_cost"),
    )


def current_performance(metrics: DataFrame) -> DataFrame:
    """Each workstream's newest week."""
    return latest_per_key(metrics, ["workstream_id"], "report_week")


def _exposure(metrics_eac: Column, bac: Column) -> Column:
    return ratio(metrics_eac - bac, bac)


def risk_flags(metrics: DataFrame, ordered: bool = True) -> DataFrame:
    """Severity flags at the newest week, worst CPI first.

    A NULL metric gets the flag's mildest label.
    """
    overrun = F.col("eac") - F.col("bac")
    flags = current_performance(metrics).select(
        "workstream_id",
        "workstream_name",
        "report_week",
        "cpi",
        "spi",
        "pct_complete_variance",
        "eac",
        "bac",
        COST_SEVERITY.label(F.col("cpi")).alias("cost_risk_flag"),
        SCHEDULE_SEVERITY.label(F.col("spi")).alias("schedule_risk_flag"),
        COMPLETION_SEVERITY.label(F.col("pct_complete_variance")).alias("completion_risk_flag"),
        F.round(overrun, 2).alias("projected_overrun"),
        BUDGET_EXPOSURE.label(_exposure(F.col("eac"), F.col("bac"))).alias(
            "budget_exposure_flag"
        ),
    )
    return flags.orderBy(F.asc_nulls_first("cpi"), "workstream_id") if ordered else flags


def program_summary(
    metrics: DataFrame, cost_basis: str = "latest", paired_overrun: bool = False
) -> DataFrame:
    """One row over all workstreams at their newest week.

    ``cost_basis="latest"`` takes the newest week's cost as cost to date, for costs
    reported cumulatively; ``"running"`` sums every week.  The overrun subtracts the
    budget of workstreams without an EAC too, unless ``paired_overrun``.
    """
    if cost_basis not in ("latest", "running"):
        raise ValueError("cost_basis must be 'latest' or 'running'")
    if cost_basis == "running":
        window = periods("workstream_id", "report_week")
        metrics = metrics.withColumn("ac", running_total(F.col("ac"), window))
    bac = F.col("bac")
    compared = F.when(F.col("eac").isNotNull(), bac) if paired_overrun else bac
    slipping = F.lit(SLIP_THRESHOLD).cast("decimal(3,2)")
    return current_performance(metrics).agg(
        F.sum("ac").alias("total_actual_cost_to_date"),
        F.sum("bac").alias("total_program_budget"),
        rounded(ratio(F.sum("ac"), F.sum("bac")) * 100, 1).alias("pct_budget_consumed"),
        rounded(mean(F.col("pct_complete_actual")), 1).alias("avg_pct_complete"),
        rounded(mean(F.col("pct_complete_planned")), 1).alias("avg_pct_complete_planned"),
        rounded(mean(F.col("cpi")), 3).alias("program_cpi"),
        rounded(mean(F.col("spi")), 3).alias("program_spi"),
        F.count_if(F.col("cpi") < slipping).alias("workstreams_over_budget"),
        F.count_if(F.col("spi") < slipping).alias("workstreams_behind_schedule"),
        F.round(F.sum("eac") - F.sum(compared), 2).alias("total_projected_overrun"),
    )


def flag_register(flags: DataFrame, streaks: DataFrame | None = None) -> DataFrame:
    """One row per raised flag, with the value that raised it.

    ``streaks``, rows of ``declining_streak``, add a trend flag to workstreams on alert,
    with the number of falling weeks.
    """

    def entry(risk: str, flag: str, value: str) -> Column:
        return F.struct(
            F.lit(risk).alias("risk_type"),
            F.col(flag).alias("severity"),
            F.col(value).cast("double").alias("value"),
        )

    entries = F.array(
        entry("cost", "cost_risk_flag", "cpi"),
        entry("schedule", "schedule_risk_flag", "spi"),
        entry("completion", "completion_risk_flag", "pct_complete_variance"),
        entry("budget", "budget_exposure_flag", "projected_overrun"),
    )
    raised = flags.select("workstream_id", "workstream_name", F.inline(entries)).where(
        ~F.col("severity").isin("ON_TRACK", "UNDER_BUDGET")
    )
    if streaks is None:
        return raised
    falling = streaks.where("alert").select(
        "workstream_id", F.col("falling_weeks").cast("double").alias("value")
    )
    return raised.unionByName(
        flags.select("workstream_id", "workstream_name")
        .join(falling, "workstream_id")
        .select(
            "workstream_id",
            "workstream_name",
            F.lit("trend").alias("risk_type"),
            F.lit("WATCH").alias("severity"),
            "value",
        )
    )


def workstream_status(flags: DataFrame, not_started: str | None = None) -> DataFrame:
    """The worst severity of each workstream and the number of raised flags.

    A workstream without planned value and without cost at its newest week, so without
    either index, has the status ``not_started``, if given, unless a flag is raised.
    """
    levels = [severity_level(F.col(flag)) for flag in FLAGS]
    raised = sum((level > 0).cast("int") for level in levels)
    status = severity_name(F.greatest(*levels))
    if not_started:
        idle = F.col("cpi").isNull() & F.col("spi").isNull() & (F.greatest(*levels) == 0)
        status = F.when(idle, F.lit(not_started)).otherwise(status)
    return flags.select(
        "workstream_id",
        "workstream_name",
        "report_week",
        status.alias("status"),
        raised.alias("raised_flags"),
    )


def declining_streak(metrics: DataFrame, alert_after: int = 3) -> DataFrame:
    """Length of each workstream's current run of falling CPI, with an alert."""
    runs = current_falling_run(metrics, "workstream_id", "report_week", "cpi")
    return runs.select(
        "workstream_id",
        "report_week",
        "cpi",
        F.col("falling_run").alias("falling_weeks"),
        (F.col("falling_run") >= alert_after).alias("alert"),
    )


def program_scorecard(summary: DataFrame) -> DataFrame:
    """The summary row in long form: metric, value and severity.

    Slipping workstreams are HIGH as soon as there is one; the overrun is graded as a
    share of the budget.
    """
    behind = F.col("avg_pct_complete") - F.col("avg_pct_complete_planned")
    exposure = ratio(F.col("total_projected_overrun"), F.col("total_program_budget"))

    def entry(name: str, value: Column, severity: Column) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            value.cast("double").alias("value"),
            severity.alias("severity"),
        )

    def counted(name: str) -> Column:
        return entry(
            name,
            F.col(name),
            F.when(F.col(name) > 0, F.lit("HIGH")).otherwise(F.lit("ON_TRACK")),
        )

    lines = F.array(
        entry(
            "pct_complete_gap", F.round(behind, 1), COMPLETION_SEVERITY.label(behind)
        ),
        entry("program_cpi", F.col("program_cpi"), COST_SEVERITY.label(F.col("program_cpi"))),
        entry("program_spi", F.col("program_spi"), SCHEDULE_SEVERITY.label(F.col("program_spi"))),
        counted("workstreams_over_budget"),
        counted("workstreams_behind_schedule"),
        entry(
            "total_projected_overrun",
            F.col("total_projected_overrun"),
            BUDGET_EXPOSURE.label(exposure),
        ),
        entry("overrun_pct_of_budget", rounded(exposure * 100, 1), BUDGET_EXPOSURE.label(exposure)),
    )
    return summary.select(F.inline(lines))


def delay_cascade(flags: DataFrame, dependency: DataFrame) -> DataFrame:
    """Own and inherited schedule severity of each workstream.

    A late workstream passes its severity to every transitive successor; ``hops`` is
    the distance to the nearest one with the inherited severity.
    """
    levels = flags.groupBy(F.col("workstream_id").alias("node")).agg(
        F.max(severity_level(F.col("schedule_risk_flag"))).alias("level")
    )
    edges = dependency.select(
        F.col("predecessor_id").alias("predecessor"), F.col("successor_id").alias("successor")
    )
    return propagate_level(levels, edges).select(
        F.col("node").alias("workstream_id"),
        severity_name(F.col("level")).alias("own_severity"),
        severity_name(F.col("inherited_level")).alias("inherited_severity"),
        "hops",
        (F.col("inherited_level") > F.col("level")).alias("worsened"),
    )
