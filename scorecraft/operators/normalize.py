"""Min-max scores on 0-10 against the bounds of the whole cohort, and their composite."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.banding import Bands
from scorecraft.functions.numeric import ratio, rounded
from scorecraft.sources.tables import require_columns


@dataclass(frozen=True)
class Metric:
    """A raw column; ``inverted`` where a lower value earns the higher score."""

    column: str
    inverted: bool = False


@dataclass(frozen=True)
class Domain:
    """A score: the mean of its normalised metrics, rounded, with a weight."""

    score: str
    weight: str
    metrics: tuple[Metric, ...]


@dataclass(frozen=True)
class CompositeSpec:
    """What to score and how.

    ``degenerate`` settles a metric that is constant over the cohort: ``"zero"``
    scores it 0, ``"null"`` makes its domain and the composite NULL.
    """

    domains: tuple[Domain, ...]
    composite: str
    tier: str
    tiers: Bands
    degenerate: str = "zero"

    def __post_init__(self):
        if self.degenerate not in ("zero", "null"):
            raise ValueError("degenerate must be 'zero' or 'null'")

    @property
    def columns(self) -> list[str]:
        return [metric.column for domain in self.domains for metric in domain.metrics]

    @property
    def scores(self) -> list[str]:
        return [domain.score for domain in self.domains]

    @property
    def max_distinct(self) -> int:
        """Bound on distinct composites: tenths from 0 to 100 times the weights, and NULL."""
        weights = sum(Decimal(domain.weight) for domain in self.domains)
        return int(weights * 1000) + 2


def cohort_bounds(
    df: DataFrame, columns: Sequence[str], read_along: Sequence[str] = ()
) -> Column:
    """Minimum and maximum of every column in one pass, as a scalar struct subquery.

    ``read_along`` names columns to count too.  It keeps column pruning from giving the
    subquery a narrower input than the rows it is compared with, so that a shuffled
    aggregate below both is run once and its exchange reused.
    """
    require_columns(df, *columns)
    parts = []
    for name in dict.fromkeys(columns):
        parts += [F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}")]
    parts += [F.count(name).alias(f"count_{name}") for name in read_along]
    return df.agg(F.struct(*parts)).scalar()


def _scaled(metric: Metric, degenerate: str) -> Column:
    value = F.col(metric.column)
    low, high = F.col(f"bounds.min_{metric.column}"), F.col(f"bounds.max_{metric.column}")
    distance = high - value if metric.inverted else value - low
    scaled = ratio(distance, high - low) * 10
    return F.when(high == low, F.lit(0.0)).otherwise(scaled) if degenerate == "zero" else scaled


def composite_scores(
    df: DataFrame, spec: CompositeSpec, read_along: Sequence[str] = ()
) -> DataFrame:
    """Add the domain scores, the weighted composite on 0-100 and its tier.

    Scores are rounded to two decimals before they are weighted, the weighted sum to
    two decimals before it is multiplied by ten, all in decimal arithmetic.
    """

    def domain_score(domain: Domain) -> Column:
        parts = [_scaled(metric, spec.degenerate) for metric in domain.metrics]
        total = reduce(add, parts)
        return rounded(total / len(parts) if len(parts) > 1 else total, 2)

    scored = df.withColumn("bounds", cohort_bounds(df, spec.columns, read_along)).select(
        *df.columns, *[domain_score(domain).alias(domain.score) for domain in spec.domains]
    )
    weighted = reduce(
        add,
        [F.col(domain.score) * F.lit(Decimal(domain.weight)) for domain in spec.domains],
    )
    return scored.withColumn(
        spec.composite, (F.round(weighted, 2) * 10).cast("decimal(6,1)")
    ).withColumn(spec.tier, spec.tiers.label(F.col(spec.composite)))
