"""Sums and means of doubles that no order of the rows changes, exact and rounded once.

A double is an integer of 53 bits times a power of two.  Its bits are read as digits to the
base 2^16 at fixed places, and digits are summed as bigints, which is exact in any order.
Values are grouped by ranges of 32 exponents first, so that six digits hold any of them; a
column's values fall into one or two such ranges as a rule.  Once a group, the digit sums of
its ranges are added, carried, and turned into the nearest double.

The columns are turned into rows first, so the expressions, and with them the time of planning
and compiling, do not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit, exponents of a range, and digits that hold any value of a range.
BITS, SPAN, DIGITS = 16, 32, 6
BASE = 1 << BITS


def _power(exponent: str, value: str) -> str:
    """``value * 2 ** exponent``, in two steps so that neither factor overflows."""
    first = f"floor(({exponent}) / 2)"
    return f"(({value}) * pow(2d, {first}) * pow(2d, ({exponent}) - {first}))"


#: The range of a value's exponent; 0 for zero, and for what is no finite number.  A logarithm
#: rounded across a border gives the range beside it, whose digits have room for that.
_RANGE = f"""cast(if(abs(exact_x) > 0 AND abs(exact_x) < double('infinity'),
                     floor(log2(abs(exact_x)) / {SPAN}), 0) AS int)"""
_FINITE = "NOT isnan(exact_x) AND abs(exact_x) < double('infinity')"
_SCALED = f"CASE WHEN {_FINITE} THEN {_power(f'-{SPAN} * exact_range', 'abs(exact_x)')} END"


def _digit(i: int) -> str:
    """Digit ``i`` of a value, of weight ``BASE ** (2 * range + 1 - i)``, with its sign."""
    shifted = f"exact_scaled * {2.0 ** (BITS * (i - 1))!r}D"
    return f"cast(floor({shifted} % {float(BASE)!r}D) * signum(exact_x) AS bigint)"


def _totals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``exact_total``: the double nearest to the sum of ``exact_entries``, structs
    of a range and digit sums; NULL where there are none.

    Nothing is rounded before the last addition, of 48 bits and the 48 that follow; what
    comes after those only marks that the sum is not exactly there.
    """

    def carried(values: str) -> str:
        return f"""aggregate({values},
            named_struct('carry', 0L, 'digits', cast(array() AS array<bigint>)),
            (state, value) -> named_struct(
                'carry', shiftright(state.carry + value, {BITS}),
                'digits', array_append(state.digits, (state.carry + value) & {BASE - 1}L)))"""

    lead = f"""aggregate(reverse(exact_carried.digits),
        named_struct('n', 0, 'high', 0L, 'low', 0L),
        (state, digit) -> named_struct(
            'n', if(state.n = 0 AND digit = 0, state.n, state.n + 1),
            'high', if(state.n < 3, state.high * {BASE}L + digit, state.high),
            'low', CASE WHEN state.n < 3 THEN state.low
                        WHEN state.n < 6 THEN state.low * {BASE}L + digit
                        ELSE state.low | if(digit > 0, 1L, 0L) END))"""
    second = "least(greatest(exact_lead.n - 3, 0), 3)"
    both = f"(double(exact_lead.high) * pow(2d, {BITS} * {second}) + exact_lead.low)"
    places = f"{BITS} * (greatest(exact_lead.n - 6, 0) + exact_lowest)"
    return (
        rows.withColumns(
            {
                "exact_lowest": F.expr(
                    f"array_min(transform(exact_entries, e -> 2 * e.range + {2 - DIGITS}))"
                ),
                "exact_highest": F.expr("array_max(transform(exact_entries, e -> 2 * e.range + 1))"),
            }
        )
        # carries of bigint sums fill three more digits and a sign
        .withColumn(
            "exact_sums",
            F.expr(
                f"""transform(sequence(exact_lowest, exact_highest + 4), place ->
                        aggregate(exact_entries, 0L, (so_far, e) -> so_far + if(
                            2 * e.range + 1 - place BETWEEN 0 AND {DIGITS - 1},
                            get(e.digits, 2 * e.range + 1 - place), 0L)))"""
            ),
        )
        .withColumn("exact_sign", F.expr(f"if({carried('exact_sums')}.carry < 0, -1L, 1L)"))
        .withColumn(
            "exact_carried", F.expr(carried("transform(exact_sums, x -> x * exact_sign)"))
        )
        .withColumn("exact_lead", F.expr(lead))
        .withColumn("exact_total", F.expr(f"{_power(places, both)} * exact_sign"))
    )


def exact_means(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Keys, and of each group the mean of every one of ``columns`` (doubles, NULLs skipped)
    and the sums of the exact (bigint or decimal) expressions ``sums``.

    The mean is the nearest double to the exact sum, divided once.  A group with values that
    are not finite has their plain sum as its mean, which has no order either.  The first step
    combines map-side; the others see a row for each column and combination of ranges in a group.
    """
    sums = sums or {}
    values = F.array(*[F.col(name).cast("double") for name in columns])
    by_range = (
        df.select(
            *keys,
            *[x.alias(name) for name, x in sums.items()],
            F.posexplode(values).alias("exact_column", "exact_x"),
        )
        .withColumn("exact_range", F.expr(_RANGE))
        .withColumn("exact_scaled", F.expr(_SCALED))
        .groupBy(*keys, "exact_column", "exact_range")
        .agg(
            F.array(*[F.sum(F.expr(_digit(i))) for i in range(DIGITS)]).alias("digits"),
            F.count("exact_x").alias("exact_n"),
            F.expr(f"sum(CASE WHEN NOT ({_FINITE}) THEN exact_x END)").alias("exact_odd"),
            # a row stands once for each column; its sums are those of the first
            *[F.sum(F.when(F.col("exact_column") == 0, F.col(name))).alias(name) for name in sums],
        )
    )
    # dealt by group once, for both groupings that follow
    by_column = (by_range.repartition(*keys) if keys else by_range).groupBy(
        *keys, "exact_column"
    ).agg(
        F.expr(
            """collect_list(CASE WHEN get(digits, 0) IS NOT NULL
                   THEN named_struct('range', exact_range, 'digits', digits) END)"""
        ).alias("exact_entries"),
        F.sum("exact_n").alias("exact_n"),
        F.sum("exact_odd").alias("exact_odd"),
        *[F.sum(name).alias(name) for name in sums],
    )
    mean = F.expr("coalesce(exact_odd, CASE WHEN exact_n > 0 THEN exact_total / exact_n END)")
    of = [F.max(F.when(F.col("exact_column") == i, F.col("exact_mean"))) for i in range(len(columns))]
    return (
        _totals(by_column)
        .withColumn("exact_mean", mean)
        .groupBy(*keys)
        .agg(
            *[x.alias(name) for x, name in zip(of, columns)],
            *[F.sum(name).alias(name) for name in sums],
        )
    )
