"""Periods of a stored report are replaced one by one, whatever write fails."""

from __future__ import annotations

import datetime

import pytest

from scorecraft.sources.reports import ReportStore

SCHEMA = "week date, name string, cpi double"
WEEKS = [datetime.date(2024, 1, d) for d in (1, 8, 15)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shown(store):
    return sorted((str(r.week), r.name, r.cpi) for r in store.read(SCHEMA).collect())


@pytest.fixture
def store(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "report"), "week")
    store.write(frame(spark, [(w, n, 1.0) for w in WEEKS[:2] for n in "ab"] + [(None, "a", 0.5)]))
    return store


BEFORE = [("2024-01-01", "a", 1.0), ("2024-01-01", "b", 1.0), ("2024-01-08", "a", 1.0), ("2024-01-08", "b", 1.0), ("None", "a", 0.5)]


def test_a_repeated_write_replaces_its_week_only(spark, store):
    assert shown(store) == BEFORE
    untouched = store.manifest().where("in_period <> '=2024-01-08'").collect()
    for _ in range(2):  # the second run of one week leaves one copy
        store.write(frame(spark, [(WEEKS[1], "a", 2.0), (WEEKS[2], "c", 3.0)]))
    assert shown(store) == [*BEFORE[:2], ("2024-01-08", "a", 2.0), ("2024-01-15", "c", 3.0), BEFORE[4]]
    assert set(untouched) <= set(store.manifest().collect())
    assert store.tidy() == 3 and store.tidy() == 0
    assert len(shown(store)) == 5 and store.damaged(SCHEMA).count() == 0


def test_a_write_that_fails_changes_nothing(spark, store, monkeypatch):
    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(ReportStore, "_list", fail)  # all rows are written, the list is not
        with pytest.raises(RuntimeError, match="lost"):
            store.write(frame(spark, [(WEEKS[0], "x", 9.0)]))
    assert shown(store) == BEFORE
    bad = frame(spark, [(WEEKS[0], "x", 9.0)]).selectExpr("week", "name", "IF(cpi > 1, raise_error('half way'), cpi) AS cpi")
    with pytest.raises(Exception, match="half way"):
        store.write(bad)
    assert shown(store) == BEFORE
    store.write(frame(spark, [(WEEKS[0], "x", 9.0)]))
    assert shown(store) == [("2024-01-01", "x", 9.0), *BEFORE[2:]]


def test_rows_lost_from_a_period_show(spark, store, tmp_path):
    (week,) = [p for p in (tmp_path / "report/data").iterdir() if "2024-01-01" in p.name]
    sorted(week.rglob("*.parquet"))[0].unlink()
    assert [r.in_period for r in store.damaged(SCHEMA).collect()] == ["=2024-01-01"]


def test_only_listed_folders_are_read(spark, store):
    store.write(frame(spark, [(WEEKS[1], "a", 2.0)]))
    text = store.read(SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "dynamicpruning" in text
