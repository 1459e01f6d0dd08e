"""Cleaning, rejects and reconciliation."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from plan_text import shuffled_rows
from pyspark.sql import functions as F

from scorecraft.operators import validation
from scorecraft.operators.validation import clean_records, reconcile, reject_duplicates
from scorecraft.plans import portfolio


def test_clean_records(spark):
    raw = spark.createDataFrame(
        [("1", "  Open ", " 5 ", "2024-02-30"), ("2", "OPEN", "5.5", "2024-02-01"),
         ("3", "open", "x", "2024-02-01"), ("4", "gone", "7", "2024-02-01"),
         ("5", "open", "-1", "2024-02-01"), ("6", None, "3", "2024-02-01")],
        "id string, status string, amount string, day string")
    df = clean_records(
        raw, texts=["status"], types={"amount": "decimal(9,2)", "day": "date"},
        checks={"amount_out_of_range": F.col("amount") >= 0,
                "unknown_status": F.col("status") == "open"})
    got = {r.id: (r.status, r.reject_reason) for r in df.collect()}
    assert got == {
        "1": ("open", "bad_day"), "2": ("open", None), "3": ("open", "bad_amount"),
        "4": ("gone", "unknown_status"), "5": ("open", "amount_out_of_range"),
        "6": (None, "unknown_status")}


def test_duplicates_keep_the_greatest_valid_record(spark):
    df = spark.createDataFrame(
        [(1, "k", 5, None), (2, "k", 7, None), (3, "k", 9, "bad"), (4, "k", 7, None),
         (5, "m", 1, None), (6, None, 1, None), (7, None, 2, None)],
        "id int, key string, amount int, reject_reason string")
    got = {r.id: r.reject_reason for r in
           reject_duplicates(df, ["key"], "id", F.col("amount") * 100 + F.col("id")).collect()}
    assert got == {1: "duplicate", 2: "duplicate", 3: "bad", 4: None, 5: None,
                   6: "duplicate", 7: None}


def test_hot_key_loses_no_record(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"),
        F.lit(None).cast("string").alias("reject_reason"))
    marked = reject_duplicates(df, ["key"], "id", F.col("id"))
    counts = {r.reject_reason: r["count"] for r in marked.groupBy("reject_reason").count().collect()}
    assert counts == {None: 2001, "duplicate": 999}


def test_reconcile(spark):
    left = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "k int, v int")
    right = spark.createDataFrame([(2, 101), (3, 150), (4, 1)], "k int, v int")
    got = {r.k: (r.difference, r.status) for r in
           reconcile(left, right, "k", "v", tolerance=F.lit(10)).collect()}
    assert got == {1: (None, "missing_right"), 2: (-1, "match"), 3: (-50, "mismatch"),
                   4: (None, "missing_left")}


def sides(spark, tmp_path, changed):
    """5000 keys on both sides, of which the right one lacks, adds and changes some."""
    left = spark.range(5000).selectExpr("id AS k", "CAST(id % 97 AS decimal(9,2)) AS v")
    right = left.where(f"k >= {changed}").unionByName(
        spark.range(9000, 9000 + changed).selectExpr("id AS k", "CAST(1 AS decimal(9,2)) AS v")
    ).withColumn("v", F.when(F.col("k") >= 5000 - changed, F.col("v") + 1).otherwise(F.col("v")))
    for name, df in (("left", left), ("right", right.repartition(3))):
        df.write.parquet(str(tmp_path / name))
    return [spark.read.parquet(str(tmp_path / name)) for name in ("left", "right")]


@pytest.mark.parametrize("changed", [0, 1, 40, 5000])
def test_digests_do_not_change_the_reconciliation(spark, tmp_path, changed):
    left, right = sides(spark, tmp_path, changed)
    nulls = spark.createDataFrame([(None, None), (None, None)], left.schema)
    pair = left.unionByName(nulls), right.unionByName(nulls.limit(1))
    plain, quick = (
        reconcile(*pair, "k", "v", F.lit(0), mostly_equal=quick) for quick in (False, True)
    )
    assert quick.columns == plain.columns
    assert quick.exceptAll(plain).count() == plain.exceptAll(quick).count() == 0


def test_equal_sources_shuffle_digests_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(validation, "BUCKETS", 64)
    left, right = sides(spark, tmp_path, 0)
    rows = reconcile(left, right, "k", "v", F.lit(0), mostly_equal=True)
    assert sum(shuffled_rows(rows)) <= 2 * 64 * left.rdd.getNumPartitions() * 3
    assert rows.where("status <> 'match'").count() == 0 and rows.count() == 5000
    one = right.withColumn("v", F.when(F.col("k") == 7, F.lit(0)).otherwise(F.col("v")))
    assert validation.differing_buckets(left, one, "k", "v").count() == 1
    assert [r.k for r in reconcile(left, one, "k", "v", F.lit(0), mostly_equal=True).where("status <> 'match'").collect()] == [7]


def test_claims_having_rank_and_rollup(spark):
    def lines(code, payer, paid):
        return [(code, payer, 100, p, p == 0) for p in paid]

    df = spark.createDataFrame(
        lines("x", "one", [80, 0]) + lines("x", "two", [90, 90, 90]) + lines("y", "one", [50]),
        "code_group string, payer string, billed bigint, paid bigint, denied boolean")
    got = {(r.grouping_level, r.code_group, r.payer):
           (r.claims, float(r.paid_pct), float(r.denial_pct), r.denial_rank)
           for r in portfolio.claims_reimbursement(df, min_claims=2).collect()}
    assert got == {
        (0, "x", "one"): (2, 40.0, 50.0, 1),
        (0, "x", "two"): (3, 90.0, 0.0, 2),
        (1, "x", None): (5, 70.0, 20.0, None),
        (3, None, None): (6, 66.67, 16.67, None)}


def test_risk_stratification(spark):
    df = spark.createDataFrame(
        [(1, "s", Decimal(10), 100.0, 100.0, 1.0, 0.0), (2, "s", Decimal(30), 0.0, 0.0, 9.0, 50.0)],
        "member_id int, segment string, cost decimal(12,2), emergency_pct double, "
        "unresolved_pct double, visit_count double, income_proxy double")
    got = {(r.risk_tier, r.segment): (r.members, float(r.mean_score), float(r.mean_cost))
           for r in portfolio.risk_stratification(df).collect()}
    assert got == {("Critical", "s"): (1, 100.0, 10.0), ("Low", "s"): (1, 0.0, 30.0)}


def test_clean_orders_types(spark):
    raw = spark.createDataFrame(
        [("1", " F ", "1", "Urgent", "2000.50", "2024-01-01", "7")],
        "record_id string, status string, priority_code string, priority_name string, "
        "amount string, order_date string, customer_id string")
    row = portfolio.clean_orders(raw).first()
    assert (row.status, row.priority_code, row.priority_name) == ("f", 1, "urgent")
    assert row.amount == Decimal("2000.50")
    assert row.order_date == datetime.date(2024, 1, 1)
    assert row.reject_reason is None


def test_area_rollup(spark):
    from scorecraft.operators.rates import Rate

    df = spark.createDataFrame(
        [("IL", "Cook", 1, 100, 10), ("IL", "Cook", 2, 50, 0), ("IL", "White", 3, 50, 10),
         ("WI", "Dane", 4, 0, 0)],
        "state string, county string, zip int, base bigint, events bigint")
    got = {(r.grouping_level, r.state, r.county, r.zip):
           (r.areas, r.base, None if r.rate is None else float(r.rate))
           for r in portfolio.area_rollup(df, ["state", "county", "zip"],
                                          (Rate("rate", "events", 100),)).collect()}
    assert got == {
        (0, "IL", "Cook", 1): (1, 100, 10.0), (0, "IL", "Cook", 2): (1, 50, 0.0),
        (0, "IL", "White", 3): (1, 50, 20.0), (0, "WI", "Dane", 4): (1, 0, None),
        (1, "IL", "Cook", None): (2, 150, 6.667), (1, "IL", "White", None): (1, 50, 20.0),
        (1, "WI", "Dane", None): (1, 0, None),
        (3, "IL", None, None): (3, 200, 10.0), (3, "WI", None, None): (1, 0, None),
        (7, None, None, None): (4, 200, 10.0)}
