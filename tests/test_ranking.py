"""Distributed ranks and n-tiles against the plain one-task windows."""

from __future__ import annotations

import random

import pytest
from plan_text import exchanges, executed_plan, scans
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorecraft.operators import ranking
from scorecraft.operators.joins import BROADCAST_ROWS
from scorecraft.operators.ranking import (
    _ranged,
    ntile,
    number_rows,
    rank_descending,
    rank_overall_and_within,
    rank_unbounded,
)


@pytest.fixture(scope="module")
def scores(spark):
    """1003 rows; a third share one score and one group, some scores and groups are NULL."""
    chance = random.Random(7)
    rows = []
    for key in range(1003):
        hot = key % 3 == 0
        score = 42.0 if hot else chance.choice([None, *[chance.randrange(300) / 10] * 9])
        group = "hot" if hot else chance.choice([None, "a", "b", "c"])
        rows.append((key, group, score))
    chance.shuffle(rows)
    return spark.createDataFrame(rows, "key int, grp string, score double").repartition(5).cache()


def disagreements(df, *pairs):
    return df.where(" OR ".join(f"NOT ({a} <=> {b})" for a, b in pairs)).count()


def descending():
    return F.desc_nulls_last("score")


def test_rank_equals_window(scores):
    plain = scores.withColumn("plain", F.rank().over(W.orderBy(descending())))
    bounded = rank_descending(plain, "score", "mine", max_distinct=1000)
    assert bounded.count() == 1003
    assert disagreements(bounded, ("plain", "mine")) == 0
    # past the bound the same function takes the way without a broadcast histogram
    unbounded = rank_descending(plain, "score", "mine", max_distinct=BROADCAST_ROWS + 1)
    assert unbounded.count() == 1003
    assert disagreements(unbounded, ("plain", "mine")) == 0


def test_rank_unbounded_over_distinct_scores(spark):
    df = spark.range(5000).select(F.hash("id").cast("double").alias("score"))
    plain = df.withColumn("plain", F.rank().over(W.orderBy(descending())))
    assert disagreements(rank_unbounded(plain, "score", "mine"), ("plain", "mine")) == 0


@pytest.mark.parametrize("max_distinct", [1000, BROADCAST_ROWS + 1])
def test_both_ranks_equal_windows(scores, max_distinct):
    plain = scores.withColumn("overall", F.rank().over(W.orderBy(descending()))).withColumn(
        "inside", F.rank().over(W.partitionBy("grp").orderBy(descending()))
    )
    mine = rank_overall_and_within(
        plain, "score", "grp", "my_overall", "my_inside", max_distinct=max_distinct
    )
    assert mine.count() == 1003
    assert disagreements(mine, ("overall", "my_overall"), ("inside", "my_inside")) == 0


ORDER = ("score", "key")


def ascending():
    return [F.asc_nulls_first("score"), F.asc("key")]


def test_row_numbers_equal_window(scores):
    plain = scores.withColumn("plain", F.row_number().over(W.orderBy(*ascending())))
    mine = number_rows(plain, *ORDER, name="mine")
    assert mine.count() == 1003
    assert disagreements(mine, ("plain", "mine")) == 0


@pytest.mark.parametrize("rows", [0, 1, 3, 4, 5, 1003])
@pytest.mark.parametrize("buckets", [4, 7])
def test_ntile_equals_window(scores, rows, buckets):
    some = scores.where(F.col("key") < rows)
    plain = some.withColumn("plain", F.ntile(buckets).over(W.orderBy(*ascending())))
    mine = ntile(plain, buckets, *ORDER, name="mine")
    assert mine.count() == rows
    assert disagreements(mine, ("plain", "mine")) == 0


def test_hot_value_spreads_over_ranges(spark, monkeypatch):
    """The unique last order column splits a value that every row has."""
    same = spark.range(40_000).select("id", F.lit(1.0).alias("score"))
    sizes = [r["count"] for r in _ranged(same, ["score", "id"], "r").groupBy("r").count().collect()]
    assert len(sizes) > 900 and max(sizes) < 200
    monkeypatch.setattr(ranking, "SAMPLE", 50)  # fewer sampled rows than ranges
    assert number_rows(same, "score", "id", name="n").where("n <> id + 1").count() == 0


def test_ranges_follow_the_order(spark):
    chance = random.Random(3)
    values = [None, float("nan"), -0.0, 0.0, *[chance.gauss(0, 1) * 10 ** chance.randint(-9, 9) for _ in range(5000)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(7)
    plain = df.withColumn("plain", F.row_number().over(W.orderBy(F.asc_nulls_first("v"), "id")))
    assert disagreements(number_rows(plain, "v", "id", name="mine"), ("plain", "mine")) == 0
    ranked = df.withColumn("plain", F.rank().over(W.orderBy(F.desc_nulls_last("v"))))
    assert disagreements(rank_unbounded(ranked, "v", "mine"), ("plain", "mine")) == 0


def test_numbers_are_one_plan_over_shared_exchanges(spark, tmp_path):
    spark.range(5000).selectExpr("id % 900 AS k", "id * 0.37 AS v", "id AS w").write.parquet(str(tmp_path / "facts.parquet"))
    facts = spark.read.parquet(str(tmp_path / "facts.parquet"))
    grouped = facts.groupBy("k").agg(F.max("v").alias("v"), F.max("w").alias("w"))
    for df in (number_rows(grouped, "v", "k"), rank_unbounded(grouped, "v", "r")):
        plan = executed_plan(df)
        assert scans(plan, "facts") <= (1 if "row_number" in df.columns else 2)
        assert "ExistingRDD" not in plan and "CartesianProduct" not in plan


def test_rank_never_gathers_rows(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("score"))
    plan = executed_plan(rank_descending(rows, "score", "mine", max_distinct=1000))
    assert exchanges(plan, "SinglePartition") == 1  # the histogram, already grouped
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
