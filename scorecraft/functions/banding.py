"""Ordered threshold bands as data, turned into one ``CASE`` expression."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """First matching rule wins; a NULL value matches none and gets ``otherwise``.

    ``rules`` holds ``(operator, threshold, label)`` with operator one of
    ``< <= > >=``.
    """

    rules: tuple[tuple[str, str, str], ...]
    otherwise: str

    def label(self, value: Column) -> Column:
        tests = {
            "<": lambda limit: value < limit,
            "<=": lambda limit: value <= limit,
            ">": lambda limit: value > limit,
            ">=": lambda limit: value >= limit,
        }
        case = F
        for operator, threshold, label in self.rules:
            case = case.when(tests[operator](F.lit(Decimal(threshold))), F.lit(label))
        return case.otherwise(F.lit(self.otherwise))


# ---- fixed values: thresholds and labels of the published scorecards ----

COST_SEVERITY = Bands(
    (("<", "0.85", "CRITICAL"), ("<", "0.95", "HIGH"), (">", "1.10", "WATCH")), "ON_TRACK"
)
SCHEDULE_SEVERITY = Bands((("<", "0.85", "CRITICAL"), ("<", "0.95", "HIGH")), "ON_TRACK")
COMPLETION_SEVERITY = Bands(
    (("<", "-10", "CRITICAL"), ("<", "-5", "HIGH"), ("<", "-2", "WATCH")), "ON_TRACK"
)
BUDGET_EXPOSURE = Bands(
    ((">", "0.10", "CRITICAL"), (">", "0.05", "HIGH"), (">", "0", "WATCH")), "UNDER_BUDGET"
)
SLIP_THRESHOLD = "0.95"

VULNERABILITY_TIERS = Bands(
    ((">=", "70", "Critical"), (">=", "50", "High"), (">=", "30", "Moderate")), "Low"
)
QUALITY_TIERS = Bands(
    ((">=", "75", "Excellent"), (">=", "55", "Good"), (">=", "35", "Fair")), "Poor"
)
TRAJECTORY_SEGMENTS = Bands(
    (
        ("<=", "-3", "Rising Star"),
        ("<=", "-1", "Improving"),
        ("<=", "1", "Stable"),
        ("<=", "3", "Declining"),
    ),
    "At Risk",
)
STAFFING_QUARTILE_LABELS = {
    1: "Q1 — Lowest Staffing",
    2: "Q2 — Below Average",
    3: "Q3 — Above Average",
    4: "Q4 — Highest Staffing",
}

# ---- severity order, ours ----

SEVERITY_ORDER = ("ON_TRACK", "WATCH", "HIGH", "CRITICAL")


def severity_level(severity: Column) -> Column:
    """0 for no concern up to 3 for CRITICAL."""
    return (
        F.when(severity == "CRITICAL", 3)
        .when(severity == "HIGH", 2)
        .when(severity == "WATCH", 1)
        .otherwise(0)
    )


def severity_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), level + 1)


def code_label(code: Column, labels: dict[int, str]) -> Column:
    """Label of a code, NULL for codes without one."""
    case = F
    for key, label in labels.items():
        case = case.when(code == key, F.lit(label))
    return case
