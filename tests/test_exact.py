"""Exact means against rational arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.functions.exact import exact_means


def means(spark, groups, parts=3):
    rows = [(k, x, float(i)) for i, (k, xs) in enumerate(groups.items()) for x in xs]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(parts)
    return {r.k: (r.x, r.n) for r in exact_means(df, ["k"], ["x", "y"], {"n": F.lit(1)}).collect()}


def exact(xs):
    known = [Fraction(x) for x in xs if x is not None]
    return float(sum(known)) / len(known) if known else None


def test_any_magnitude_sign_and_cancellation(spark):
    chance = random.Random(1)
    groups = {
        "below a millionth": [1e-7, 3e-9, 2.5e-300, 5e-324, 1e-7],
        "ties": [0.125, 0.375, 2**53 + 2.0, 1.0, -1.0],
        "half a unit": [2.0**53, 1.0, 5e-324],  # just above the middle of two doubles
        "cancel": [1e300, 1.0, -1e300, 1e-20],
        "nothing": [None, None],
        "zero": [0.0, -0.0, 1.5, -1.5],
        "negative": [-x for x in (1e-320, 7.0, 1e18, 0.1)],
        "borders": [2.0**k for k in range(-1074, 1020, 31)] + [math.nextafter(2.0**k, 0) for k in range(-960, 960, 32)],
        "mixed": [chance.uniform(-1, 1) * 10.0 ** chance.randint(-200, 200) for _ in range(500)],
        "tenths": [0.1] * 999,
        "some": [None, 2.0, 3.0],
    }
    got = means(spark, groups)
    assert {k: v[0] for k, v in got.items()} == {k: exact(xs) for k, xs in groups.items()}
    assert {k: v[1] for k, v in got.items()} == {k: len(xs) for k, xs in groups.items()}


def test_what_is_not_finite_shows(spark):
    inf, nan = math.inf, math.nan
    got = means(spark, {"inf": [inf, 1.0], "both": [inf, -inf], "nan": [nan, 2.0], "plain": [2.0]})
    assert got["inf"][0] == inf and math.isnan(got["both"][0]) and math.isnan(got["nan"][0])
    assert got["plain"][0] == 2.0


@pytest.mark.parametrize("parts", [1, 2, 17])
def test_partitions_do_not_matter(spark, parts):
    chance = random.Random(2)
    groups = {"a": [chance.gauss(0, 1) * 100 / 7 for _ in range(3000)]}
    assert means(spark, groups, parts)["a"][0] == exact(groups["a"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e290, max_value=1e290), min_size=1, max_size=30))
def test_any_doubles(spark, xs):
    assert means(spark, {"a": xs})["a"][0] == exact(xs)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert exact_means(empty, ["k"], ["x"]).count() == 0
