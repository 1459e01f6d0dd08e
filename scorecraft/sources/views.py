"""The named views, for consumers that query with SQL.

A view declares the views that it is stacked on and is either SQL over their names or a
function of their frames.  ``register`` puts a view and all that it needs into the session's
catalog, lower ones first; nothing is computed until a view is queried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from scorecraft.plans.facility_quality import quality_scores
from scorecraft.plans.performance import earned_value, risk_flags, variance_trend
from scorecraft.sources import adapters
from scorecraft.sources.tables import StarSchema


@dataclass(frozen=True)
class View:
    """``body`` is SQL, or a function of the frames that ``needs`` names, in that order.

    A view that needs nothing is an input; its function takes the ``StarSchema``.
    """

    name: str
    needs: tuple[str, ...]
    body: str | Callable[..., DataFrame]


#: The watch list: how many workstreams are in each state, and how bad the worst is.
WATCH_LIST = """
SELECT cost_risk_flag, budget_exposure_flag, count(*) AS workstreams, min(cpi) AS worst_cpi,
       sum(CASE WHEN schedule_risk_flag = 'CRITICAL' THEN 1 ELSE 0 END) AS critical_schedules,
       sum(projected_overrun) AS overrun
FROM vw_risk_flags GROUP BY cost_risk_flag, budget_exposure_flag
"""

VIEWS = (
    View("weekly_performance", (), adapters.weekly_performance),
    View("workstreams", (), adapters.workstreams),
    View("vw_earned_value", ("weekly_performance", "workstreams"), earned_value),
    View("vw_variance_trend", ("vw_earned_value",), variance_trend),
    View("vw_risk_flags", ("vw_earned_value",), lambda metrics: risk_flags(metrics, ordered=False)),
    View("vw_watch_list", ("vw_risk_flags",), WATCH_LIST),
    View("quality_measures", (), adapters.quality_measures),
    View("facilities", (), adapters.facilities),
    View("vw_quality_scores", ("quality_measures", "facilities"), quality_scores),
    View("vw_5yr_aggregate", (), adapters.five_year_aggregate),
)


def in_order(wanted: Iterable[str], views: Iterable[View] = VIEWS) -> list[View]:
    """The wanted views and all that they need, every one after those it needs."""
    known = {view.name: view for view in views}
    graph, open_names = {}, list(wanted)
    while open_names:
        name = open_names.pop()
        if name not in known:
            raise ValueError(f"no view {name!r}; there are {sorted(known)}")
        if name not in graph:
            graph[name] = known[name].needs
            open_names += known[name].needs
    try:
        return [known[name] for name in TopologicalSorter(graph).static_order()]
    except CycleError as error:
        raise ValueError(f"views need each other: {' -> '.join(error.args[1])}") from error


def register(
    db: StarSchema, *wanted: str, views: Iterable[View] = VIEWS, **inputs: DataFrame
) -> list[str]:
    """Register the ``wanted`` views (all, if none is named) with what they need; return the
    names in the order of registration.

    ``inputs`` are frames that stand in for views of those names.
    """
    views = tuple(views)
    made: dict[str, DataFrame] = {}
    for view in in_order(wanted or [v.name for v in views], views):
        if view.name in inputs:
            made[view.name] = inputs[view.name]
        elif isinstance(view.body, str):
            made[view.name] = db.spark.sql(view.body)
        else:
            made[view.name] = view.body(*([made[n] for n in view.needs] or [db]))
        made[view.name].createOrReplaceTempView(view.name)
    return list(made)


def query(db: StarSchema, sql: str, *needs: str) -> DataFrame:
    """A consumer's SQL over the views that it names in ``needs``."""
    register(db, *needs)
    return db.spark.sql(sql)
