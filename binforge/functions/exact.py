"""Sums of doubles that don't depend on the order of rows, partitions or retries.

A double is cut into whole numbers of ``BITS`` bits, limbs, at fixed exponents from ``TOP`` down, towards 0. Limbs are
summed as longs, which is exact and associative, so partial sums of any kind can be merged; the limbs' sums are joined
to one double at the end. Bits below the last exponent (2^-80) are cut off, for each row alike.

Values of 2^60 or more, infinite ones and NaN are summed as doubles besides: they spoil their own sum only, in the
order-dependent way of plain sums where they are finite. A limb's sum holds 2^43 rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 20
TOP, LIMBS = 40, 7
EXPONENTS = [TOP - BITS * i for i in range(LIMBS)]
_LARGE = 2.0 ** (TOP + BITS)

#: Spark's type of a sum.
SUM = "struct<limbs: array<bigint>, rest: double>"


def limbs(x: Column) -> list[Column]:
    """The limbs of a double, with its sign; 0 for what is summed besides. Scaling and remainders of doubles are exact."""
    fine = F.when(F.abs(x) < _LARGE, x).when(x.isNotNull(), 0.0)  # NaN isn't smaller: Spark sorts it above all numbers
    return [((fine * 2.0**-e) % F.lit(2.0**BITS)).cast("long") for e in EXPONENTS]


def exact_sum(x: Column) -> Column:
    """An aggregate: the sum of ``x`` as limbs, all null if there is no value."""
    return F.struct(F.array(*map(F.sum, limbs(x))).alias("limbs"), F.sum(F.when((F.abs(x) >= _LARGE) | F.isnan(x), x)).alias("rest"))


def merged(total: str) -> Column:
    """An aggregate: the sum of sums, in a column of structs."""
    return F.struct(F.array(*[F.sum(F.get(f"{total}.limbs", i)) for i in range(LIMBS)]).alias("limbs"), F.sum(f"{total}.rest").alias("rest"))


def _carried(parts: Column) -> Column:
    """The same sum as ``digits`` from 0 to 2^BITS, and ``carry``, what is left above the first."""
    zero = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(a: Column, c: Column) -> Column:
        whole = a["carry"] + c
        digit = whole.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
        return F.struct(F.shiftright(whole, BITS).alias("carry"), F.concat(F.array(digit), a["digits"]).alias("digits"))

    return F.aggregate(F.reverse(parts), zero, step)


def value(total: Column) -> Column:
    """The exact sum, rounded once to a double (half to even)."""
    sign = F.when(_carried(total["limbs"])["carry"] < 0, -1).otherwise(1)
    whole = _carried(F.transform(total["limbs"], lambda c: c * sign))  # of the positive number, so that nothing cancels out
    digits = F.transform(F.array(whole), lambda w: F.concat(F.array(w["carry"]), w["digits"]))

    def rounded(d: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(d, lambda x: x != 0), F.lit(True)), F.lit(1)).cast("int")  # from 1
        at = lambda i: F.coalesce(F.get(d, first - 1 + i), F.lit(0)).cast("double")
        # Two exact numbers of 43 and 42 bits. What follows the first four digits only matters as being there at all.
        rest = F.when(F.exists(F.slice(d, first + 4, LIMBS + 1), lambda x: x != 0), 0.25).otherwise(0.0)
        unit = F.pow(F.lit(2.0), TOP + BITS * (1 - first))
        return ((at(0) * 2.0**BITS + at(1)) + (at(2) * 2.0**BITS + at(3) + rest) * 2.0 ** (-2 * BITS)) * unit

    exactly = F.when(F.get(total["limbs"], 0).isNotNull(), F.get(F.transform(digits, rounded), 0) * sign)
    return F.when(total["rest"].isNotNull(), total["rest"] + F.coalesce(exactly, F.lit(0.0))).otherwise(exactly)
