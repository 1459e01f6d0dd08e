"""Every registered report against DuckDB, and the shape of the plans."""

from __future__ import annotations

import importlib.util
import re
from pathlib import Path

import pytest
from oracle_check import differences, duck
from plan_text import exchanges, executed_plan, scans

from scorecraft.plans.registry import REPORTS

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"
if not Path(FOLDER).exists():
    pytest.skip("no test tables", allow_module_level=True)

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

KIND = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
        "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    return duck(FOLDER)


def test_every_report_has_an_oracle():
    assert set(REPORTS) <= set(entry.oracle_sql()) and set(REPORTS) <= set(entry.queries())


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql()[name]
    theirs = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: KIND.get(f.dataType.simpleString()) for f in df.schema.fields} == theirs
    assert differences(df, db, sql) == []


def test_flagship(spark):
    assert entry.entry(spark).count() == 2898


@pytest.fixture(params=["broadcasting", "shuffling"])
def joins(request, spark):
    """Plans with and without sides small enough to broadcast by size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1" if request.param == "shuffling" else "10485760")
    yield request.param
    spark.conf.set(key, before)


READS = {  # report: table, times it may be read
    "variance_trend": [("lineitem", 1)],
    "program_summary": [("lineitem", 1)],
    "composite_scorecard": [("lineitem", 1), ("orders", 1)],
    "quality_scores": [("lineitem", 2)],  # measures, and one column for the newest quarter
    "staffing_quartiles": [("lineitem", 2)],
    "proportional_allocation": [("lineitem", 1), ("orders", 1)],
    "benchmark_excess": [("lineitem", 1), ("orders", 1)],
    "parent_excess": [("lineitem", 1), ("orders", 1)],
    "disparity_gap": [("lineitem", 1), ("orders", 1)],
    "region_contrast": [("lineitem", 1), ("orders", 1)],
    "risk_stratification": [("orders", 1)],
    "area_rollup": [("lineitem", 1), ("orders", 1)],
    "claims_reimbursement": [("lineitem", 1)],
}


@pytest.mark.parametrize("name", READS)
def test_facts_are_read_once_and_no_cross_joins(spark, joins, name):
    plan = executed_plan(entry.queries()[name](spark, FOLDER))
    assert {t: scans(plan, t) for t, _ in READS[name]} == dict(READS[name])
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_shuffled_joins_give_the_same_rows(spark, db, joins):
    for name in ("composite_scorecard", "quality_scores", "claims_reimbursement"):
        assert differences(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["disparity_gap", "primary_driver", "parent_excess", "area_rollup"])
def test_areas_are_read_with_their_rates(spark, name):
    """Once for the areas and once, where density is a metric, for the population."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = executed_plan(entry.queries()[name](spark, FOLDER))
    finally:
        spark.conf.set(key, before)
    assert scans(plan, "customer") == (2 if name in ("disparity_gap", "primary_driver") else 1)


def test_quartiles_are_one_plan(spark):
    plan = executed_plan(entry.queries()["staffing_quartiles"](spark, FOLDER))
    assert "ExistingRDD" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = executed_plan(entry.queries()["trajectory_segments"](spark, FOLDER))
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    newest = executed_plan(entry.queries()["quality_scores"](spark, FOLDER))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(l_shipdate,ScalarSubquery", newest)


def test_every_quarter_is_read(spark):
    from scorecraft.sources import adapters
    from scorecraft.sources.tables import StarSchema

    measures = adapters.quality_measures(StarSchema(spark, FOLDER))
    assert measures.agg({"report_quarter": "min"}).first()[0] == "1995Q1"


def test_areas_and_members_without_events_stay(spark):
    """One customer without orders, and one whose parent is in no table of areas."""
    from scorecraft.plans.registry import REPORTS
    from scorecraft.sources.tables import StarSchema

    class Extra(StarSchema):
        def table(self, name):
            df = super().table(name)
            if name == "customer":
                more = [(-1, "new", 1, 0.0, "BUILDING"), (-2, "far", 999, 0.0, "BUILDING")]
                df = df.unionByName(self.spark.createDataFrame(more, df.schema))
            return df

    db = Extra(spark, FOLDER)
    rows = db.table("customer").count()
    small = REPORTS["small_base_flag"](db).where("area_id < 0").collect()
    assert [(r.base, r.maternal_mortality_rate, r.small_base) for r in small] == [(0, None, True)] * 2
    assert REPORTS["multi_year_rates"](db).count() == rows
    allocated = REPORTS["proportional_allocation"](db)
    assert allocated.count() == rows
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in executed_plan(REPORTS["proportional_allocation"](db))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tiers = REPORTS["risk_stratification"](db).collect()
    assert sum(r.members for r in tiers) == rows


def test_trend_windows_share_an_exchange(spark):
    """Two windows of the input and the trend add nothing to the input's own exchanges."""
    from scorecraft.plans.performance import earned_value, variance_trend
    from scorecraft.sources import adapters
    from scorecraft.sources.tables import StarSchema

    base = StarSchema(spark, FOLDER)
    stored = adapters.weekly_performance(base)
    streams = adapters.workstreams(base)
    hashes = [exchanges(executed_plan(df), "hashpartitioning(workstream_id")
              for df in (stored, variance_trend(earned_value(stored, streams)))]
    assert hashes[0] == hashes[1] > 0


def test_named_views(spark):
    from scorecraft.sources import views
    from scorecraft.sources.tables import StarSchema

    order = views.register(StarSchema(spark, FOLDER))
    assert sorted(order) == sorted(v.name for v in views.VIEWS)
    for view in views.VIEWS:
        assert all(order.index(n) < order.index(view.name) for n in view.needs)
    counts = {name: spark.table(name).count() for name in (
        "vw_earned_value", "vw_variance_trend", "vw_risk_flags", "vw_quality_scores",
        "vw_5yr_aggregate")}
    assert counts == {"vw_earned_value": 2898, "vw_variance_trend": 2898, "vw_risk_flags": 10,
                      "vw_quality_scores": 10, "vw_5yr_aggregate": 150}
    worst = spark.sql("SELECT min(cpi) AS c FROM vw_risk_flags").first()
    assert worst.c is not None


def test_views_are_stacked_by_their_needs(spark):
    from scorecraft.sources.tables import StarSchema
    from scorecraft.sources.views import View, register

    base = StarSchema(spark, FOLDER)
    stack = [
        View("top", ("middle", "numbers"), "SELECT count(*) AS n FROM middle JOIN numbers USING (id)"),
        View("middle", ("numbers",), lambda numbers: numbers.where("id > 2")),
        View("numbers", (), lambda db: db.spark.range(5)),
        View("other", ("absent",), "SELECT 1"),
        View("a", ("b",), "SELECT 1"),
        View("b", ("a",), "SELECT 1"),
    ]
    assert register(base, "top", views=stack) == ["numbers", "middle", "top"]
    assert spark.table("top").first().n == 2
    register(base, "top", views=stack, numbers=spark.range(9))
    assert spark.table("top").first().n == 6
    with pytest.raises(ValueError, match="no view 'absent'"):
        register(base, "other", views=stack)
    with pytest.raises(ValueError, match="need each other"):
        register(base, "a", views=stack)


def test_report_is_written(spark, tmp_path):
    from scorecraft.sources.tables import write_report

    df = entry.queries()["provider_density"](spark, FOLDER)
    write_report(df, str(tmp_path / "density"))
    assert spark.read.parquet(str(tmp_path / "density")).count() == 25


def test_missing_input_columns_are_named(spark):
    from scorecraft.plans.performance import earned_value

    with pytest.raises(ValueError, match="actual_cost"):
        earned_value(spark.range(1), spark.range(1))
