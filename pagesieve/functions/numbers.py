"""Sums and roundings that do not depend on the order or the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.text import bound


def compensated_sum(values: Column) -> Column:
    """Sum of an array of doubles that carries the rounding error along, as Python's ``sum`` does.

    Scores are compared with thresholds, so 0.1 ten times must give 1.0.
    """

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + x
        large, small = F.greatest(F.abs(acc["total"]), F.abs(x)), F.least(F.abs(acc["total"]), F.abs(x))
        # weights and scores are never negative
        return F.struct(total.alias("total"), (acc["lost"] + ((large - total) + small)).alias("lost"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))
    return F.aggregate(values, start, step, lambda acc: acc["total"] + acc["lost"])


# A double is taken apart into slices of SLICE bits, three of which make a limb: all bits of values below 2**120 in size and,
# of those, all above 2**-180; what is smaller than that does not count. Sums of slices are whole numbers that fit for 2**43 rows.
SLICE, LIMB, HIGHEST, LOWEST = 20, 60, 1, 3


def _slice_sum(value: Column, shift: int) -> Column:
    """Aggregate: sum of the bits from 2**shift on, with the signs of the values; scaling by powers of two is exact."""
    own = F.floor(F.pmod(F.abs(value) * 2.0**-shift, F.lit(2.0**SLICE)))
    return F.sum(F.when(value < 0, -own).otherwise(own)).cast("decimal(20,0)")


def _limb_sum(value: Column, place: int) -> Column:
    low, middle, high = (_slice_sum(value, LIMB * place + SLICE * i) for i in range(3))
    return (low + middle * (1 << SLICE) + high * (1 << 2 * SLICE)).cast("decimal(38,0)")


def _rounded(limbs: Column) -> Column:
    """The double nearest to a number given by its limbs, lowest first; ties go to the even one.

    After carrying, the two highest limbs in use hold all bits of a double, and any lower bit only breaks a tie.
    """
    base = F.lit(1 << LIMB).cast("decimal(20,0)")

    def carried(sign: Column) -> Column:
        # limb by limb: what stays, and what goes to the next one
        start = F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.array().cast("array<decimal(38,0)>").alias("out"))

        def step(acc: Column, limb: Column) -> Column:
            total = (acc["carry"] + limb * sign).cast("decimal(38,0)")
            stays = F.pmod(total, base).cast("decimal(38,0)")
            carry = ((total - stays) / base).cast("decimal(38,0)")
            return F.struct(carry.alias("carry"), F.concat(acc["out"], F.array(stays)).alias("out"))

        return F.aggregate(limbs, start, step, lambda acc: F.concat(acc["out"], F.array(acc["carry"])))

    plus = F.lit(1).cast("decimal(1,0)")
    sign = F.when(F.element_at(carried(plus), -1) < 0, -plus).otherwise(plus)

    def nearest(parts: Column) -> Column:
        at = F.greatest(F.array_max(F.transform(parts, lambda x, i: F.when(x > 0, i).otherwise(0))), F.lit(1))
        low = F.exists(F.slice(parts, F.lit(1), at - 1), lambda x: x > 0).cast("decimal(1,0)")
        top = (F.get(parts, at) * base + F.get(parts, at - 1)).cast("decimal(37,0)") * 2 + low
        return top.cast("double") * F.pow(F.lit(2.0), (LIMB * (at - 1 - LOWEST) - 1).cast("double"))

    return sign.cast("double") * bound(carried(sign), nearest)


def exact_sum(value: Column) -> Column:
    """Aggregate: sum of doubles without any rounding but that of the result, so the same whatever the order of the rows."""
    sums = {place: _limb_sum(value, place) for place in range(-LOWEST, HIGHEST + 1)}
    # Scores and the like have bits in two limbs only, whose number needs no carrying.
    zero, large = F.lit(0).cast("decimal(38,0)"), F.lit(1 << LIMB).cast("decimal(20,0)")
    plain = F.abs(sums[0]) < large
    for place in sums:
        plain = plain & (sums[place] == zero) if place not in (0, -1) else plain
    both = (sums[0].cast("decimal(19,0)") * large).cast("decimal(38,0)") + sums[-1]
    near = both.cast("decimal(38,0)").cast("double") * 2.0**-LIMB
    return F.when(F.count(value) == 0, F.lit(None)).when(plain, near).otherwise(_rounded(F.array(*sums.values())))


def mean(value: Column) -> Column:
    """Aggregate: mean of doubles, the exact sum divided by the number of rows, as Python's ``sum`` and ``len`` give it."""
    return F.try_divide(exact_sum(value), F.count(value))


def fixed(value: Column, decimals: int) -> Column:
    """Decimal text rounded half-even on the exact binary value, without digit grouping.

    Of all ties at one and three decimals below 1, only 0.0005 comes out otherwise (0.000).
    """
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def round_even(value: Column, decimals: int) -> Column:
    return fixed(value, decimals).cast("double")
