"""The reports as plain SQL for DuckDB over the same Parquet tables.

Written independently of the DataFrame code: single-partition windows, direct
subqueries and cross joins are fine here.
"""

from __future__ import annotations


def fixed(value: str, places: int, width: int = 18) -> str:
    """Half-up rounding after fixing a double to six decimals, as double."""
    return f"cast(round(cast({value} as decimal({width},6)), {places}) as double)"


def money(value: str, places: int = 2) -> str:
    return fixed(value, places, 28)


def over(numerator: str, denominator: str) -> str:
    return f"(cast({numerator} as double) / nullif(cast({denominator} as double), 0))"


def bands(value: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    cases = " ".join(f"WHEN {value} {test} THEN '{label}'" for test, label in rules)
    return f"CASE {cases} ELSE '{otherwise}' END"


PRICE = "cast(l_extendedprice as decimal(12,2))"
TAX = "cast(l_tax as decimal(4,2))"
DISCOUNT = "cast(l_discount as decimal(4,2))"

# ---- program performance ----

WEEKLY = f"""
weekly_sums AS (
  SELECT cast(s_nationkey as bigint) AS workstream_id,
         cast(date_trunc('week', l_shipdate) as date) AS report_week,
         cast(0.50 * sum({PRICE}) as decimal(18,2)) AS planned_value,
         cast(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN {PRICE} END), 0)
              as decimal(18,2)) AS earned_value,
         cast(0.72 * coalesce(sum(CASE WHEN l_returnflag <> 'R'
              THEN {PRICE} * (1 + {TAX}) END), 0) as decimal(18,2)) AS actual_cost
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2),
weekly_budget AS (
  SELECT *, cast(sum(planned_value) OVER (PARTITION BY workstream_id)
                 as decimal(18,2)) AS budget_at_completion,
         sum(earned_value) OVER w AS ev_to_date, sum(planned_value) OVER w AS pv_to_date
  FROM weekly_sums
  WINDOW w AS (PARTITION BY workstream_id ORDER BY report_week
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
weekly_performance AS (
  SELECT workstream_id, report_week, report_week + 6 AS report_date,
         planned_value, earned_value, actual_cost, budget_at_completion,
         cast(round(cast({over('ev_to_date', 'budget_at_completion')} * 100
              as decimal(18,6)), 2) as decimal(9,2)) AS pct_complete_actual,
         cast(round(cast({over('pv_to_date', 'budget_at_completion')} * 100
              as decimal(18,6)), 2) as decimal(9,2)) AS pct_complete_planned
  FROM weekly_budget),
metrics AS (
  SELECT workstream_id, n_name AS workstream_name, report_week, report_date,
         planned_value AS pv, earned_value AS ev, actual_cost AS ac,
         round(earned_value - actual_cost, 2) AS cost_variance,
         round(earned_value - planned_value, 2) AS schedule_variance,
         round(cast({over('earned_value', 'actual_cost')} as decimal(18,6)), 3) AS cpi,
         round(cast({over('earned_value', 'planned_value')} as decimal(18,6)), 3) AS spi,
         pct_complete_actual, pct_complete_planned,
         round(pct_complete_actual - pct_complete_planned, 2) AS pct_complete_variance,
         round(cast({over('budget_at_completion', over('earned_value', 'actual_cost'))}
               as decimal(28,6)), 2) AS eac,
         budget_at_completion AS bac,
         round(cast(cast(budget_at_completion as double)
               - {over('budget_at_completion', over('earned_value', 'actual_cost'))}
               as decimal(28,6)), 2) AS variance_at_completion
  FROM weekly_performance JOIN nation ON workstream_id = n_nationkey)
"""

COST = bands("cpi", [("< 0.85", "CRITICAL"), ("< 0.95", "HIGH"), ("> 1.10", "WATCH")], "ON_TRACK")
SCHEDULE = bands("spi", [("< 0.85", "CRITICAL"), ("< 0.95", "HIGH")], "ON_TRACK")
COMPLETION_RULES = [("< -10", "CRITICAL"), ("< -5", "HIGH"), ("< -2", "WATCH")]
COMPLETION = bands("pct_complete_variance", COMPLETION_RULES, "ON_TRACK")
EXPOSURE_RULES = [("> 0.10", "CRITICAL"), ("> 0.05", "HIGH"), ("> 0", "WATCH")]
EXPOSURE = bands(over("(eac - bac)", "bac"), EXPOSURE_RULES, "UNDER_BUDGET")

CURRENT = (
    WEEKLY
    + """,
latest_week AS (
  SELECT workstream_id AS ws, max(report_week) AS wk FROM weekly_performance GROUP BY 1),
latest AS (
  SELECT metrics.* FROM metrics
  JOIN latest_week ON workstream_id = ws AND report_week = wk)
"""
)
FLAGS = (
    CURRENT
    + f""",
flags AS (
  SELECT workstream_id, workstream_name, report_week, cpi, spi, pct_complete_variance,
         eac, bac, {COST} AS cost_risk_flag, {SCHEDULE} AS schedule_risk_flag,
         {COMPLETION} AS completion_risk_flag, round(eac - bac, 2) AS projected_overrun,
         {EXPOSURE} AS budget_exposure_flag
  FROM latest)
"""
)


def dbl(*names: str) -> str:
    return ", ".join(f"cast({name} as double) AS {name}" for name in names)


EARNED_VALUE = f"""WITH {WEEKLY}
SELECT workstream_id, workstream_name, report_week, report_date,
       {dbl('pv', 'ev', 'ac', 'cost_variance', 'schedule_variance', 'cpi', 'spi',
            'pct_complete_actual', 'pct_complete_planned', 'pct_complete_variance',
            'eac', 'bac', 'variance_at_completion')}
FROM metrics"""

VARIANCE_TREND = f"""WITH {WEEKLY}
SELECT workstream_id, workstream_name, report_week,
       {dbl('cpi', 'spi', 'cost_variance', 'schedule_variance', 'pct_complete_actual',
            'pct_complete_planned', 'pct_complete_variance')},
       cast(round(cost_variance - lag(cost_variance, 1) OVER w, 2) as double) AS cv_wow_change,
       {fixed(over('sum(cpi) OVER w4', 'count(cpi) OVER w4'), 3)} AS cpi_4wk_avg,
       cast(sum(ac) OVER (PARTITION BY workstream_id ORDER BY report_week
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) as double)
         AS cumulative_actual_cost
FROM metrics
WINDOW w AS (PARTITION BY workstream_id ORDER BY report_week),
       w4 AS (PARTITION BY workstream_id ORDER BY report_week
              ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""

RISK_FLAGS = f"""WITH {FLAGS}
SELECT workstream_id, workstream_name, report_week,
       {dbl('cpi', 'spi', 'pct_complete_variance', 'eac', 'bac', 'projected_overrun')},
       cost_risk_flag, schedule_risk_flag, completion_risk_flag, budget_exposure_flag
FROM flags"""

WATCH_LIST = f"""WITH {FLAGS}
SELECT cost_risk_flag, budget_exposure_flag, count(*) AS workstreams,
       cast(min(cpi) as double) AS worst_cpi,
       cast(count(CASE WHEN schedule_risk_flag = 'CRITICAL' THEN 1 END) as bigint) AS critical_schedules,
       cast(sum(projected_overrun) as double) AS overrun
FROM flags GROUP BY cost_risk_flag, budget_exposure_flag"""

SUMMARY = (
    CURRENT
    + f""",
summary AS (
  SELECT cast(sum(ac) as double) AS total_actual_cost_to_date,
         cast(sum(bac) as double) AS total_program_budget,
         {fixed(over('sum(ac)', 'sum(bac)') + ' * 100', 1)} AS pct_budget_consumed,
         {fixed(over('sum(pct_complete_actual)', 'count(pct_complete_actual)'), 1)}
           AS avg_pct_complete,
         {fixed(over('sum(pct_complete_planned)', 'count(pct_complete_planned)'), 1)}
           AS avg_pct_complete_planned,
         {fixed(over('sum(cpi)', 'count(cpi)'), 3)} AS program_cpi,
         {fixed(over('sum(spi)', 'count(spi)'), 3)} AS program_spi,
         count(CASE WHEN cpi < 0.95 THEN 1 END) AS workstreams_over_budget,
         count(CASE WHEN spi < 0.95 THEN 1 END) AS workstreams_behind_schedule,
         cast(round(sum(eac) - sum(bac), 2) as double) AS total_projected_overrun
  FROM latest)
"""
)
PROGRAM_SUMMARY = f"WITH {SUMMARY} SELECT * FROM summary"

def level(flag: str) -> str:
    return (
        f"CASE {flag} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END"
    )


def severity(level_sql: str) -> str:
    return (
        f"CASE {level_sql} WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' "
        "WHEN 1 THEN 'WATCH' ELSE 'ON_TRACK' END"
    )


WORKSTREAM_STATUS = f"""WITH {FLAGS},
levels AS (
  SELECT workstream_id, workstream_name, report_week, cpi, spi,
         {level('cost_risk_flag')} AS a, {level('schedule_risk_flag')} AS b,
         {level('completion_risk_flag')} AS c, {level('budget_exposure_flag')} AS d
  FROM flags)
SELECT workstream_id, workstream_name, report_week,
       CASE WHEN greatest(a, b, c, d) = 0 AND cpi IS NULL AND spi IS NULL THEN 'NOT_STARTED'
            ELSE {severity('greatest(a, b, c, d)')} END AS status,
       cast((CASE WHEN a > 0 THEN 1 ELSE 0 END) + (CASE WHEN b > 0 THEN 1 ELSE 0 END)
          + (CASE WHEN c > 0 THEN 1 ELSE 0 END) + (CASE WHEN d > 0 THEN 1 ELSE 0 END)
          as bigint) AS raised_flags
FROM levels"""

DECLINING_STREAK = f"""WITH {WEEKLY},
steps AS (
  SELECT workstream_id, report_week, cpi,
         row_number() OVER w AS seq,
         coalesce(cpi < lag(cpi) OVER w, false) AS fell
  FROM metrics WINDOW w AS (PARTITION BY workstream_id ORDER BY report_week)),
last_rise AS (
  SELECT workstream_id AS ws, max(seq) AS last_seq,
         max(CASE WHEN NOT fell THEN seq END) AS rise_seq
  FROM steps GROUP BY 1)
SELECT workstream_id, report_week, cast(cpi as double) AS cpi,
       last_seq - rise_seq AS falling_weeks, last_seq - rise_seq >= 3 AS alert
FROM steps JOIN last_rise ON workstream_id = ws AND seq = last_seq"""

FLAG_REGISTER = f"""WITH {FLAGS},
streaks AS ({DECLINING_STREAK}),
entries AS (
  SELECT workstream_id, workstream_name, 'cost' AS risk_type, cost_risk_flag AS severity,
         cast(cpi as double) AS "value" FROM flags
  UNION ALL SELECT workstream_id, workstream_name, 'schedule', schedule_risk_flag,
         cast(spi as double) FROM flags
  UNION ALL SELECT workstream_id, workstream_name, 'completion', completion_risk_flag,
         cast(pct_complete_variance as double) FROM flags
  UNION ALL SELECT workstream_id, workstream_name, 'budget', budget_exposure_flag,
         cast(projected_overrun as double) FROM flags
  UNION ALL SELECT f.workstream_id, workstream_name, 'trend', 'WATCH',
         cast(falling_weeks as double)
  FROM flags f JOIN streaks s ON f.workstream_id = s.workstream_id WHERE alert)
SELECT * FROM entries WHERE severity NOT IN ('ON_TRACK', 'UNDER_BUDGET')"""


GAP = (
    "cast(round(cast(avg_pct_complete as decimal(18,1)) "
    "- cast(avg_pct_complete_planned as decimal(18,1)), 1) as double)"
)
EXPOSED = over("total_projected_overrun", "total_program_budget")
SLIPPING = "CASE WHEN {0} > 0 THEN 'HIGH' ELSE 'ON_TRACK' END"
PROGRAM_SCORECARD = f"""WITH {SUMMARY}
SELECT 'pct_complete_gap' AS metric, {GAP} AS "value",
       {bands(GAP, COMPLETION_RULES, 'ON_TRACK')} AS severity FROM summary
UNION ALL SELECT 'program_cpi', program_cpi, {COST.replace('cpi', 'program_cpi')} FROM summary
UNION ALL SELECT 'program_spi', program_spi, {SCHEDULE.replace('spi', 'program_spi')} FROM summary
UNION ALL SELECT 'workstreams_over_budget', cast(workstreams_over_budget as double),
       {SLIPPING.format('workstreams_over_budget')} FROM summary
UNION ALL SELECT 'workstreams_behind_schedule', cast(workstreams_behind_schedule as double),
       {SLIPPING.format('workstreams_behind_schedule')} FROM summary
UNION ALL SELECT 'total_projected_overrun', total_projected_overrun,
       {bands(EXPOSED, EXPOSURE_RULES, 'UNDER_BUDGET')} FROM summary
UNION ALL SELECT 'overrun_pct_of_budget', {fixed(EXPOSED + ' * 100', 1)},
       {bands(EXPOSED, EXPOSURE_RULES, 'UNDER_BUDGET')} FROM summary"""

DELAY_CASCADE = f"""WITH RECURSIVE {FLAGS},
own AS (
  SELECT workstream_id AS node, max({level('schedule_risk_flag')}) AS lvl FROM flags GROUP BY 1),
dependency AS (
  SELECT a.n_nationkey AS predecessor,
         (SELECT min(b.n_nationkey) FROM nation b
          WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey) AS successor
  FROM nation a),
reach(origin, node, hops) AS (
  SELECT predecessor, successor, 1 FROM dependency WHERE successor IS NOT NULL
  UNION
  SELECT origin, successor, hops + 1 FROM reach JOIN dependency ON node = predecessor
  WHERE successor IS NOT NULL),
inherited AS (
  SELECT reach.node, lvl, min(hops) AS hops
  FROM reach JOIN own ON own.node = origin WHERE lvl > 0 GROUP BY 1, 2),
worst AS (
  SELECT node, lvl, hops FROM inherited
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY lvl DESC) = 1)
SELECT own.node AS workstream_id, {severity('own.lvl')} AS own_severity,
       {severity('coalesce(worst.lvl, 0)')} AS inherited_severity,
       cast(worst.hops as bigint) AS hops, coalesce(worst.lvl, 0) > own.lvl AS worsened
FROM own LEFT JOIN worst ON own.node = worst.node"""

# ---- area vulnerability ----

EVENTS = {
    "mortality_events": "l_returnflag = 'R' AND l_discount >= 0.09",
    "preterm_events": "l_returnflag = 'R'",
    "prenatal_events": "l_linestatus = 'O'",
    "low_birthweight_events": "l_quantity < 10",
    "csection_events": "l_tax >= 0.07",
}
RATES = {
    "maternal_mortality_rate": ("mortality_events", 100000),
    "preterm_birth_rate": ("preterm_events", 100),
    "late_no_prenatal_pct": ("prenatal_events", 100),
    "low_birthweight_rate": ("low_birthweight_events", 100),
    "csection_rate": ("csection_events", 100),
}


def pooled(window: str) -> str:
    """Counts and rates of every customer over the lines of its orders in a window."""
    return f"""
pooled AS (
  SELECT c_custkey AS area_id, count(l_orderkey) AS base,
         {', '.join(f"count(CASE WHEN {test} THEN 1 END) AS {name}" for name, test in EVENTS.items())}
  FROM customer
  LEFT JOIN (SELECT * FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {window})
    ON o_custkey = c_custkey
  GROUP BY 1),
rates AS (
  SELECT *, {', '.join(f"{over(f'{k} * {e}', 'base')} AS {name}" for name, (e, k) in RATES.items())}
  FROM pooled)
"""


POOLED = pooled("year(o_orderdate) BETWEEN 1996 AND 2000")
DENSITY = f"""
density AS (
  SELECT cast(n_nationkey as bigint) AS parent_id, n_name AS parent_name,
         coalesce(p.n, 0) AS providers, q.n AS inhabitants,
         {over('10000 * coalesce(p.n, 0)', 'q.n')} AS density
  FROM nation
  LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) p
    ON p.k = n_nationkey
  LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) q
    ON q.k = n_nationkey)
"""
AGGREGATE = (
    POOLED
    + ","
    + DENSITY
    + f""",
vw_5yr_aggregate AS (
  SELECT area_id AS zip_code, c_name AS community_name, c_mktsegment AS region_type,
         cast(c_nationkey as bigint) AS parent_id, base, {', '.join(RATES)},
         density AS obgyn_per_10k_women
  FROM rates JOIN customer ON area_id = c_custkey
  LEFT JOIN density ON c_nationkey = parent_id)
"""
)
INDEX = [  # raw column, score, weight, inverted
    ("maternal_mortality_rate", "score_mortality", "0.25", False),
    ("preterm_birth_rate", "score_preterm", "0.20", False),
    ("late_no_prenatal_pct", "score_prenatal_care", "0.20", False),
    ("low_birthweight_rate", "score_low_birthweight", "0.15", False),
    ("csection_rate", "score_csection", "0.10", False),
    ("obgyn_per_10k_women", "score_provider_density", "0.10", True),
]


def zero_scores(index: list[tuple[str, str, str, bool]]) -> str:
    """Score expressions against bounds columns lo_<c>/hi_<c>, constant columns scored 0."""
    out = []
    for column, score, _, inverted in index:
        distance = f"hi_{column} - {column}" if inverted else f"{column} - lo_{column}"
        out.append(
            f"round(cast(CASE WHEN hi_{column} = lo_{column} THEN 0.0 "
            f"ELSE cast({distance} as double) / cast(hi_{column} - lo_{column} as double) * 10 "
            f"END as decimal(18,6)), 2) AS {score}"
        )
    return ", ".join(out)


def bound_columns(columns: list[str]) -> str:
    return ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)


def weighted(pairs: list[tuple[str, str]]) -> str:
    return (
        "cast(round(" + " + ".join(f"{s} * {w}" for s, w in pairs) + ", 2) * 10 as decimal(6,1))"
    )


VULNERABILITY_RULES = [(">= 70", "Critical"), (">= 50", "High"), (">= 30", "Moderate")]
SCORED = (
    AGGREGATE
    + f""",
bounds AS (SELECT {bound_columns([c for c, *_ in INDEX])} FROM vw_5yr_aggregate),
normalized AS (
  SELECT vw_5yr_aggregate.*, {zero_scores(INDEX)} FROM vw_5yr_aggregate CROSS JOIN bounds),
composed AS (
  SELECT *, {weighted([(s, w) for _, s, w, _ in INDEX])} AS composite_score FROM normalized),
scored AS (
  SELECT *, {bands('composite_score', VULNERABILITY_RULES, 'Low')} AS risk_tier FROM composed)
"""
)
COMPOSITE_SCORECARD = f"""WITH {SCORED}
SELECT rank() OVER (ORDER BY composite_score DESC NULLS LAST) AS vulnerability_rank,
       zip_code, community_name, region_type, {dbl('composite_score')}, risk_tier,
       {dbl(*[s for _, s, _, _ in INDEX])}
FROM scored"""

MULTI_YEAR_RATES = f"""WITH {POOLED}
SELECT area_id, base, {', '.join(EVENTS)},
       {', '.join(f"{fixed(name, 4)} AS {name}" for name in RATES)}
FROM rates"""

RATE_RANK = f"""WITH {POOLED}
SELECT area_id, base, {fixed("maternal_mortality_rate", 4)} AS maternal_mortality_rate,
       rank() OVER (ORDER BY maternal_mortality_rate DESC NULLS LAST) AS rate_rank
FROM rates"""

PROPORTIONAL_ALLOCATION = f"""WITH {POOLED},
children AS (
  SELECT area_id, cast(c_nationkey as bigint) AS parent_id, base, mortality_events
  FROM pooled JOIN customer ON area_id = c_custkey),
parents AS (
  SELECT parent_id AS pid, sum(base) AS parent_base, sum(mortality_events) AS parent_value
  FROM children GROUP BY 1)
SELECT area_id, parent_id, base, mortality_events, cast(parent_base as bigint) AS parent_base,
       cast(parent_value as bigint) AS parent_value,
       {fixed(over('base', 'parent_base'), 6)} AS share,
       {fixed(over('parent_value * base', 'parent_base'), 4)} AS allocated
FROM children JOIN parents ON parent_id = pid"""

PROVIDER_DENSITY = f"""WITH {DENSITY}
SELECT parent_id, parent_name, providers, inhabitants, {fixed('density', 4)} AS density,
       density < 2.0 AS low_access
FROM density"""

DISPARITY_GAP = f"""WITH {SCORED}
SELECT 'parent' AS level, parent_id, count(*) AS areas,
       cast(max(composite_score) as double) AS highest,
       cast(min(composite_score) as double) AS lowest,
       cast(max(composite_score) - min(composite_score) as double) AS gap
FROM scored GROUP BY parent_id
UNION ALL
SELECT 'overall', NULL, count(*), cast(max(composite_score) as double),
       cast(min(composite_score) as double),
       cast(max(composite_score) - min(composite_score) as double)
FROM scored"""

BENCHMARK_EXCESS = f"""WITH {POOLED},
cohort AS (
  SELECT {', '.join(f"{over(f'{k} * sum({e})', 'sum(base)')} AS all_{name}" for name, (e, k) in RATES.items())}
  FROM pooled)
SELECT area_id, base,
       {', '.join(f"{fixed(f'({over(name, f"all_{name}")} - 1) * 100', 2)} AS {name}_excess_pct" for name in RATES)}
FROM rates CROSS JOIN cohort"""

PARENT_EXCESS = f"""WITH {POOLED},
states AS (
  SELECT c_nationkey AS state,
         {', '.join(f"{over(f'{k} * sum({e})', 'sum(base)')} AS all_{name}" for name, (e, k) in RATES.items())}
  FROM pooled JOIN customer ON c_custkey = area_id GROUP BY 1)
SELECT area_id, cast(c_nationkey as bigint) AS parent_id, base,
       {', '.join(f"{fixed(f'({over(name, f"all_{name}")} - 1) * 100', 2)} AS {name}_excess_pct" for name in RATES)}
FROM rates JOIN customer ON c_custkey = area_id
JOIN states ON state IS NOT DISTINCT FROM c_nationkey"""

POINTS = {s: f"({s} * {w} * 10)" for _, s, w, _ in INDEX}
MOST = f"greatest({', '.join(POINTS.values())})"
DRIVERS = ", ".join(f"CASE WHEN {p} = most THEN '{s}' END" for s, p in POINTS.items())
PRIMARY_DRIVER = f"""WITH {SCORED},
topped AS (SELECT *, {MOST} AS most FROM scored)
SELECT zip_code, {dbl('composite_score')}, risk_tier,
       CASE WHEN risk_tier <> 'Low' THEN coalesce({DRIVERS}) END AS primary_driver,
       CASE WHEN risk_tier <> 'Low' THEN concat_ws('+', {DRIVERS}) END AS drivers,
       CASE WHEN risk_tier <> 'Low' THEN cast(round(most, 2) as double) END AS driver_points
FROM topped"""

SMALL_BASE_FLAG = f"""WITH {POOLED}
SELECT area_id, base, {fixed('maternal_mortality_rate', 4)} AS maternal_mortality_rate,
       base < 30 AS small_base
FROM rates"""

INDEX_COLUMNS = [c for c, *_ in INDEX]
REGION_CONTRAST = f"""WITH {AGGREGATE},
means AS (
  SELECT region_type, count(*) AS areas,
         {', '.join(over(f'fsum({c})', f'count({c})') + f' AS {c}' for c in INDEX_COLUMNS)}
  FROM vw_5yr_aggregate GROUP BY 1),
reference AS (SELECT {', '.join(f'{c} AS ref_{c}' for c in INDEX_COLUMNS)}
              FROM means WHERE region_type = 'MACHINERY')
""" + " UNION ALL ".join(
    f"""SELECT region_type, areas, '{c}' AS metric, {fixed(c, 4)} AS mean_value,
       {fixed(f'{c} - ref_{c}', 4)} AS difference FROM means CROSS JOIN reference"""
    for c in INDEX_COLUMNS
)

# ---- facility quality ----

QTY = "cast(l_quantity as decimal(12,2))"
QUARTER = "year(l_shipdate) || 'Q' || quarter(l_shipdate)"


def pct(test: str) -> str:
    return f"count(CASE WHEN {test} THEN 1 END) * 100.0::double / count(*)"


MEASURES = f"""
quality_measures AS (
  SELECT l_suppkey AS cms_certification_number, {QUARTER} AS report_quarter,
         {pct("l_returnflag = 'R'")} AS readmission_rate_30d,
         {pct("l_linestatus = 'O'")} AS hospital_transfer_rate,
         {pct("l_discount >= 0.08")} AS pressure_ulcer_rate,
         {pct("l_tax >= 0.07")} AS fall_injury_rate,
         {pct("l_quantity >= 25")} AS pain_management_rate,
         {over(f'sum({QTY})', 'count(*)')} / 40 AS rn_hours_per_resident,
         {over(f'sum({PRICE})', 'count(*)')} / 20000 AS cna_hours_per_resident,
         count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 END)
           AS health_deficiency_count
  FROM lineitem GROUP BY 1, 2),
facilities AS (
  SELECT s_suppkey AS cms_certification_number, s_name AS facility_name, n_name AS state,
         CASE WHEN s_acctbal < 0 THEN 'Government' ELSE 'Private' END AS ownership_type,
         s_suppkey % 200 + 20 AS certified_beds,
         CASE WHEN s_nationkey % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS urban_rural
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""
QUALITY_COLUMNS = [
    "readmission_rate_30d",
    "hospital_transfer_rate",
    "pressure_ulcer_rate",
    "fall_injury_rate",
    "pain_management_rate",
    "rn_hours_per_resident",
    "cna_hours_per_resident",
    "health_deficiency_count",
]


def up(c: str) -> str:
    return f"({c} - lo_{c}) / nullif(cast(hi_{c} - lo_{c} as double), 0) * 10"


def down(c: str) -> str:
    return f"(hi_{c} - {c}) / nullif(cast(hi_{c} - lo_{c} as double), 0) * 10"


def domain(parts: list[str], name: str) -> str:
    total = f"({' + '.join(parts)}) / {len(parts)}" if len(parts) > 1 else parts[0]
    return f"round(cast({total} as decimal(18,6)), 2) AS {name}"


QUALITY_WEIGHTS = [
    ("score_readmission", "0.30"),
    ("score_clinical", "0.25"),
    ("score_staffing", "0.25"),
    ("score_compliance", "0.20"),
]
QUALITY_RULES = [(">= 75", "Excellent"), (">= 55", "Good"), (">= 35", "Fair")]
SCORED_FACILITIES = (
    MEASURES
    + f""",
current AS (
  SELECT facilities.*, q.* EXCLUDE (cms_certification_number)
  FROM quality_measures q JOIN facilities USING (cms_certification_number)
  WHERE report_quarter = (SELECT max(report_quarter) FROM quality_measures)),
bounds AS (SELECT {bound_columns(QUALITY_COLUMNS)} FROM current),
normalized AS (
  SELECT current.*,
         {domain([down('readmission_rate_30d'), down('hospital_transfer_rate')], 'score_readmission')},
         {domain([down('pressure_ulcer_rate'), down('fall_injury_rate'), up('pain_management_rate')], 'score_clinical')},
         {domain([up('rn_hours_per_resident'), up('cna_hours_per_resident')], 'score_staffing')},
         {domain([down('health_deficiency_count')], 'score_compliance')}
  FROM current CROSS JOIN bounds),
composed AS (
  SELECT *, {weighted(QUALITY_WEIGHTS)} AS composite_quality_score FROM normalized),
vw_quality_scores AS (
  SELECT *, {bands('composite_quality_score', QUALITY_RULES, 'Poor')} AS quality_tier,
         rank() OVER (ORDER BY composite_quality_score DESC NULLS LAST) AS national_rank,
         rank() OVER (PARTITION BY state ORDER BY composite_quality_score DESC NULLS LAST)
           AS state_rank
  FROM composed)
"""
)
QUALITY_SCORES = f"""WITH {SCORED_FACILITIES}
SELECT cms_certification_number, facility_name, state, ownership_type, certified_beds,
       urban_rural, report_quarter, {dbl(*[s for s, _ in QUALITY_WEIGHTS])},
       readmission_rate_30d, rn_hours_per_resident, cna_hours_per_resident,
       health_deficiency_count, pressure_ulcer_rate, fall_injury_rate,
       {dbl('composite_quality_score')}, quality_tier, national_rank, state_rank
FROM vw_quality_scores"""

HOURS_MEAN = over("fsum(rn_hours_per_resident)", "count(rn_hours_per_resident)")
READMISSION_MEAN = over("fsum(readmission_rate_30d)", "count(readmission_rate_30d)")
QUALITY_MEAN = over("sum(composite_quality_score)", "count(composite_quality_score)")
STAFFING_QUARTILES = f"""WITH {SCORED_FACILITIES},
binned AS (
  SELECT *, ntile(4) OVER (ORDER BY rn_hours_per_resident NULLS FIRST,
                           cms_certification_number) AS q
  FROM vw_quality_scores)
SELECT q AS rn_staffing_quartile,
       CASE q WHEN 1 THEN 'Q1 — Lowest Staffing' WHEN 2 THEN 'Q2 — Below Average'
              WHEN 3 THEN 'Q3 — Above Average' WHEN 4 THEN 'Q4 — Highest Staffing' END
         AS staffing_tier_label,
       count(*) AS facility_count, {fixed(HOURS_MEAN, 2)} AS avg_rn_hours,
       {fixed(READMISSION_MEAN, 2)} AS avg_readmission_rate,
       {fixed(QUALITY_MEAN, 1)} AS avg_quality_score,
       {fixed(f"{READMISSION_MEAN} - (SELECT {READMISSION_MEAN} FROM binned WHERE q = 4)", 2)}
         AS readmission_gap_vs_best_staffed
FROM binned GROUP BY q"""

TRAJECTORY_RULES = [
    ("<= -3", "Rising Star"),
    ("<= -1", "Improving"),
    ("<= 1", "Stable"),
    ("<= 3", "Declining"),
]
TRAJECTORY_SEGMENTS = f"""WITH {MEASURES},
quarterly AS (
  SELECT f.*, readmission_rate_30d,
         row_number() OVER (PARTITION BY f.cms_certification_number ORDER BY report_quarter) AS n
  FROM quality_measures q JOIN facilities f USING (cms_certification_number)),
first_last AS (
  SELECT cms_certification_number, facility_name, state,
         max(CASE WHEN n = 1 THEN readmission_rate_30d END) AS a,
         max(CASE WHEN n = 8 THEN readmission_rate_30d END) AS z
  FROM quarterly WHERE n IN (1, 8) GROUP BY 1, 2, 3)
SELECT cms_certification_number, facility_name, state,
       {fixed('a', 2)} AS first_quarter_readmission, {fixed('z', 2)} AS latest_quarter_readmission,
       {fixed('z - a', 2)} AS rate_change, {fixed(over('(z - a)', 'a') + ' * 100', 1)} AS pct_change,
       {bands('(z - a)', TRAJECTORY_RULES, 'At Risk')} AS trajectory_segment
FROM first_last"""

PREDICTIVE_FEATURES = f"""WITH {MEASURES},
r AS (
  SELECT cms_certification_number, report_quarter,
         round(cast(readmission_rate_30d as decimal(18,6)), 4) AS rate,
         round(cast(rn_hours_per_resident as decimal(18,6)), 4) AS hours
  FROM quality_measures)
SELECT cms_certification_number, report_quarter, row_number() OVER w AS quarter_num,
       cast(rate as double) AS readmission_rate,
       cast(lag(rate) OVER w as double) AS previous_rate,
       cast(lead(rate) OVER w as double) AS next_rate,
       cast(rate - lag(rate) OVER w as double) AS rate_change,
       {fixed(over('sum(rate) OVER w4', 'count(rate) OVER w4'), 4)} AS rate_4q_avg,
       cast(hours - lag(hours) OVER w as double) AS hours_change
FROM r
WINDOW w AS (PARTITION BY cms_certification_number ORDER BY report_quarter),
       w4 AS (PARTITION BY cms_certification_number ORDER BY report_quarter
              ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""

PEER_MEAN = over("sum(composite_quality_score)", "count(composite_quality_score)")
ABOVE_PEER_MEAN = f"""WITH {SCORED_FACILITIES},
peers AS (SELECT state AS s, {PEER_MEAN} AS peer_mean FROM vw_quality_scores GROUP BY 1)
SELECT cms_certification_number, state, {dbl('composite_quality_score')},
       {fixed('peer_mean', 3)} AS state_mean
FROM vw_quality_scores JOIN peers ON state = s WHERE composite_quality_score > peer_mean"""

# ---- portfolio ----

SOCIAL = [
    ("emergency_pct", "score_emergency", "0.35", False),
    ("unresolved_pct", "score_unresolved", "0.25", False),
    ("visit_count", "score_access", "0.20", True),
    ("income_proxy", "score_income", "0.20", True),
]
RISK_STRATIFICATION = f"""WITH members AS (
  SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS income_proxy,
         cast(count(o_orderkey) as double) AS visit_count,
         {over("count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END)", "count(o_orderkey)")} * 100
           AS emergency_pct,
         {over("count(CASE WHEN o_orderstatus = 'O' THEN 1 END)", "count(o_orderkey)")} * 100
           AS unresolved_pct,
         coalesce(sum(cast(o_totalprice as decimal(12,2))), 0) AS cost
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3),
bounds AS (SELECT {bound_columns([c for c, *_ in SOCIAL])} FROM members),
normalized AS (SELECT members.*, {zero_scores(SOCIAL)} FROM members CROSS JOIN bounds),
composed AS (
  SELECT *, {weighted([(s, w) for _, s, w, _ in SOCIAL])} AS risk_score FROM normalized)
SELECT {bands('risk_score', VULNERABILITY_RULES, 'Low')} AS risk_tier, segment,
       count(*) AS members, {fixed(over('sum(risk_score)', 'count(risk_score)'), 2)} AS mean_score,
       {fixed(over('sum(cost)', 'count(cost)'), 2)} AS mean_cost,
       cast(sum(cost) as double) AS total_cost
FROM composed GROUP BY 1, 2"""

CLAIMS_REIMBURSEMENT = f"""WITH claims AS (
  SELECT p_type AS code_group, n_name AS payer, {PRICE} AS billed,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE {PRICE} * (1 - {DISCOUNT}) END AS paid,
         l_returnflag = 'R' AS denied
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
levels AS (
  SELECT grouping(code_group, payer) AS grouping_level, code_group, payer,
         count(*) AS claims, count(CASE WHEN denied THEN 1 END) AS denied,
         sum(billed) AS billed, sum(paid) AS paid
  FROM claims GROUP BY ROLLUP (code_group, payer) HAVING count(*) >= 50),
shown AS (
  SELECT cast(grouping_level as bigint) AS grouping_level, code_group, payer, claims, denied,
         cast(round(billed, 2) as double) AS billed, cast(round(paid, 2) as double) AS paid,
         {fixed(over('paid', 'billed') + ' * 100', 2)} AS paid_pct,
         {fixed(over('denied', 'claims') + ' * 100', 2)} AS denial_pct
  FROM levels)
SELECT *, CASE WHEN grouping_level = 0 THEN rank() OVER (
    PARTITION BY grouping_level, code_group ORDER BY denial_pct DESC NULLS LAST) END AS denial_rank
FROM shown"""

SOURCE_RECONCILIATION = f"""WITH l AS (
  SELECT o_orderkey AS record_id, cast(o_totalprice as decimal(18,2)) AS left_value FROM orders),
r AS (
  SELECT l_orderkey AS record_id,
         cast(sum({PRICE} * (1 - {DISCOUNT})) as decimal(18,2)) AS right_value
  FROM lineitem GROUP BY 1)
SELECT coalesce(l.record_id, r.record_id) AS record_id, {dbl('left_value', 'right_value')},
       cast(left_value - right_value as double) AS difference,
       CASE WHEN left_value IS NULL THEN 'missing_left'
            WHEN right_value IS NULL THEN 'missing_right'
            WHEN abs(left_value - right_value) > left_value * 0.25 THEN 'mismatch'
            ELSE 'match' END AS status
FROM l FULL JOIN r ON l.record_id = r.record_id"""

EXTRACT_RECONCILIATION = f"""WITH l AS (
  SELECT o_orderkey AS record_id, cast(o_totalprice as decimal(18,2)) AS left_value FROM orders),
r AS (
  SELECT cast(cast(o_orderkey as varchar) as bigint) AS record_id,
         cast(cast(cast(o_totalprice as decimal(18,2)) as varchar) as decimal(18,2)) AS right_value
  FROM orders)
SELECT coalesce(l.record_id, r.record_id) AS record_id, {dbl('left_value', 'right_value')},
       cast(left_value - right_value as double) AS difference,
       CASE WHEN left_value IS NULL THEN 'missing_left' WHEN right_value IS NULL THEN 'missing_right'
            WHEN left_value <> right_value THEN 'mismatch' ELSE 'match' END AS status
FROM l FULL JOIN r ON l.record_id = r.record_id"""

CLEAN_NORMALIZE = """WITH typed AS (
  SELECT o_orderkey AS record_id, lower(trim(o_orderstatus)) AS status,
         try_cast(split_part(o_orderpriority, '-', 1) as integer) AS priority_code,
         lower(trim(split_part(o_orderpriority, '-', 2))) AS priority_name,
         cast(o_totalprice as decimal(18,2)) AS amount, cast(o_orderdate as date) AS order_date,
         o_custkey AS customer_id
  FROM orders),
checked AS (
  SELECT *, CASE WHEN priority_code IS NULL THEN 'bad_priority_code'
                 WHEN amount IS NULL THEN 'bad_amount'
                 WHEN order_date IS NULL THEN 'bad_order_date'
                 WHEN customer_id IS NULL THEN 'bad_customer_id'
                 WHEN NOT amount BETWEEN 1000 AND 450000 THEN 'amount_out_of_range'
                 WHEN status NOT IN ('o', 'f', 'p') THEN 'unknown_status' END AS reason
  FROM typed),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY reason IS NULL, customer_id, order_date
                               ORDER BY amount DESC, record_id DESC) AS n
  FROM checked)
SELECT record_id, status, cast(priority_code as bigint) AS priority_code, priority_name,
       cast(amount as double) AS amount, order_date, customer_id,
       CASE WHEN reason IS NULL AND n > 1 THEN 'duplicate' ELSE reason END AS reject_reason
FROM numbered"""

AREA_ROLLUP = f"""WITH {pooled('true')},
placed AS (
  SELECT r_name AS state, n_name AS county, area_id AS zip_code, pooled.*
  FROM pooled JOIN customer ON area_id = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
totals AS (
  SELECT cast(grouping(state, county, zip_code) as bigint) AS grouping_level,
         state, county, zip_code, count(*) AS areas, cast(sum(base) as bigint) AS base,
         {', '.join(f'sum({e}) AS {e}' for e in EVENTS)}
  FROM placed GROUP BY ROLLUP (state, county, zip_code))
SELECT grouping_level, state, county, zip_code, areas, base,
       {', '.join(f"{fixed(over(f'{k} * {e}', 'base'), 3)} AS {name}" for name, (e, k) in RATES.items())}
FROM totals"""

SQL = {
    "earned_value": EARNED_VALUE,
    "variance_trend": VARIANCE_TREND,
    "risk_flags": RISK_FLAGS,
    "watch_list": WATCH_LIST,
    "program_summary": PROGRAM_SUMMARY,
    "composite_scorecard": COMPOSITE_SCORECARD,
    "quality_scores": QUALITY_SCORES,
    "staffing_quartiles": STAFFING_QUARTILES,
    "trajectory_segments": TRAJECTORY_SEGMENTS,
    "multi_year_rates": MULTI_YEAR_RATES,
    "proportional_allocation": PROPORTIONAL_ALLOCATION,
    "provider_density": PROVIDER_DENSITY,
    "disparity_gap": DISPARITY_GAP,
    "benchmark_excess": BENCHMARK_EXCESS,
    "parent_excess": PARENT_EXCESS,
    "primary_driver": PRIMARY_DRIVER,
    "small_base_flag": SMALL_BASE_FLAG,
    "rate_rank": RATE_RANK,
    "region_contrast": REGION_CONTRAST,
    "flag_register": FLAG_REGISTER,
    "workstream_status": WORKSTREAM_STATUS,
    "declining_streak": DECLINING_STREAK,
    "program_scorecard": PROGRAM_SCORECARD,
    "delay_cascade": DELAY_CASCADE,
    "risk_stratification": RISK_STRATIFICATION,
    "claims_reimbursement": CLAIMS_REIMBURSEMENT,
    "source_reconciliation": SOURCE_RECONCILIATION,
    "extract_reconciliation": EXTRACT_RECONCILIATION,
    "clean_normalize": CLEAN_NORMALIZE,
    "predictive_features": PREDICTIVE_FEATURES,
    "above_peer_mean": ABOVE_PEER_MEAN,
    "area_rollup": AREA_ROLLUP,
}
