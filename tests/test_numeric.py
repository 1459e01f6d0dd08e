"""Exact sums, rounding and bands."""

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.functions.banding import Bands
from scorecraft.functions.numeric import exact_sum, hundredths, presentable, ratio, rounded


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(units=st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=8))
def test_exact_sum_past_bigint(spark, units):
    df = spark.createDataFrame([(u,) for u in units], "u bigint")
    assert df.agg(exact_sum(F.col("u"), "0.01").alias("s")).first().s == sum(units) * Decimal("0.01")


def test_exact_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "u bigint")
    assert df.agg(exact_sum(F.col("u"), "1").alias("s")).first().s is None


def test_hundredths_of_two_decimal_doubles(spark):
    df = spark.range(0, 2_000_000, 7).select((F.col("id") / 100).alias("x"), "id")
    assert df.where(hundredths(F.col("x")) != F.col("id")).count() == 0
    assert df.where(hundredths(-F.col("x")) != -F.col("id")).count() == 0


@pytest.mark.parametrize("value", [0.125, 1e-7, 12345678.901, -0.005])
def test_hundredths_refuse_more_decimals(spark, value):
    df = spark.createDataFrame([(0.25,), (None,), (value,)], "x double")
    with pytest.raises(Exception, match="more than two decimals"):
        df.select(hundredths(F.col("x"))).collect()


def test_hundredths_of_large_amounts(spark):
    cents = [10**15 + 7, 9_007_199_254_740_991, -(10**13) - 1]
    df = spark.createDataFrame([(c / 100,) for c in cents], "x double")
    assert [r[0] for r in df.select(hundredths(F.col("x"))).collect()] == [round(c / 100 * 100) for c in cents]


@pytest.mark.parametrize(
    "value, places, expected",
    [(0.8496, 3, "0.850"), (0.8495, 3, "0.850"), (1.005, 2, "1.01"), (0.285, 2, "0.29"),
     (-1.005, 2, "-1.01"), (2.5, 0, "3")],
)
def test_half_up(spark, value, places, expected):
    row = spark.range(1).select(rounded(F.lit(value), places).alias("r")).first()
    assert row.r == Decimal(expected)


def test_ratio_guards_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (None, 2), (1, 2)], "a int, b int")
    assert [r.r for r in df.select(ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [
        None, None, None, 0.5]


def test_first_band_wins_and_null_falls_through(spark):
    bands = Bands((("<", "1", "low"), ("<", "2", "mid"), (">", "9", "high")), "rest")
    df = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (9.5,), (None,)], "x double")
    got = [r.b for r in df.select(bands.label(F.col("x")).alias("b")).collect()]
    assert got == ["low", "mid", "rest", "high", "rest"]


def test_presentable_types(spark):
    df = presentable(spark.createDataFrame([(1, Decimal("1.50"), "x")], "a int, b decimal(5,2), c string"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string"]
