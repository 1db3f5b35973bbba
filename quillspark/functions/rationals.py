"""Exact fractions as struct<num: bigint, den: bigint>, reduced, with a positive denominator; never a double. Sums beyond 64 bits raise."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Denominators below this are reduced by a table, without Euclid's algorithm.
SMALL = 32


def _of_small(a: Column, small: Column) -> Column:
    """gcd of a and of a number from 1 to SMALL - 1, looked up."""
    table = F.split(F.lit(",".join(str(math.gcd(b, r)) for b in range(SMALL) for r in range(SMALL))), ",").cast("array<bigint>")  # a constant to Spark
    return F.get(table, (small * SMALL + F.pmod(a, small)).cast("int"))


def gcd(a: Column, b: Column) -> Column:
    """By a table where the smaller number is small; else by Euclid's algorithm, which takes at most five steps a digit of the smaller number (Lamé), and one where the smaller comes first."""
    zero = F.lit(0).cast("long")
    x, y = F.abs(a).cast("long"), F.abs(b).cast("long")
    low, high = F.least(x, y), F.greatest(x, y)
    start = F.struct(x.alias("a"), y.alias("b"))
    step = lambda g, _: F.when(g["b"] == 0, g).otherwise(F.struct(g["b"].alias("a"), F.coalesce(F.try_mod(g["a"], g["b"]), zero).alias("b")))
    steps = 5 * F.length(low.cast("string")) + 1
    # least and greatest leave nulls out
    euclid = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda g: g["a"])
    return F.when(a.isNull() | b.isNull(), euclid).when(low == 0, high).when(low < SMALL, _of_small(high, low)).otherwise(euclid)


def fraction(num: Column, den: Column) -> Column:
    """num / den, reduced; null where den is 0 or either is null. Denominators from 1 to SMALL - 1 take a look into a table, not a step of any lambda function."""
    one = F.lit(1).cast("long")
    made = lambda num, den: F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))
    shared = _of_small(num, den)
    small = made(F.call_function("div", num, shared), F.call_function("div", den, shared))
    named = F.transform(F.array(F.struct(num.cast("long").alias("n"), den.cast("long").alias("d"))), lambda x: F.struct(x["n"].alias("n"), x["d"].alias("d"), F.greatest(gcd(x["n"], x["d"]), one).alias("g")))
    sign = lambda x: F.when(x["d"] < 0, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))
    large = F.transform(named, lambda x: made(F.call_function("div", sign(x) * x["n"], x["g"]), F.call_function("div", F.abs(x["d"]), x["g"])))
    known = num.isNotNull()
    return F.when((den == 1) & known, made(num, one)).when((den > 0) & (den < SMALL) & known, small).when((den != 0) & known, F.element_at(large, 1))


def parsed(c: Column) -> Column:
    """A fraction written as `3/8`, `-2` or `0`; null for anything else, as decimals or a zero denominator."""
    ok = c.rlike(r"^-?\d{1,18}(/\d{1,18})?$")
    num, den = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
    return F.when(ok, fraction(num.try_cast("long"), F.when(den == "", 1).otherwise(den.try_cast("long"))))


def plus(a: Column, b: Column) -> Column:
    return fraction(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def minus(a: Column, b: Column) -> Column:
    """a - b, of reduced fractions; over the least common denominator, and with nothing to reduce where one of them is whole."""
    div, made = lambda a, b: F.call_function("div", a, b), lambda num, den: F.struct(num.alias("num"), den.alias("den"))
    # lambda functions, so that the rare case is no code to be compiled for each stage
    named = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), F.greatest(gcd(a["den"], b["den"]), F.lit(1).cast("long")).alias("g"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), div(x["b"]["den"], x["g"]).alias("x"), div(x["a"]["den"], x["g"]).alias("y")))
    over = F.transform(named, lambda x: made(x["a"]["num"] * x["x"] - x["b"]["num"] * x["y"], x["a"]["den"] * x["x"]))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both & (b["den"] == 1), made(a["num"] - b["num"] * a["den"], a["den"])).when(both & (a["den"] == 1), made(a["num"] * b["den"] - b["num"], b["den"])).when(both, F.element_at(F.transform(over, lambda x: fraction(x["num"], x["den"])), 1))


#: Numbers that ranks() gives.
RANKS = 4


def ranks(c: Column) -> list[Column]:
    """Long numbers by which fractions are in order, and equal where these are: the floor, then 186 binary digits behind the point, 62 at a time.

    Two fractions of 64 bits differ by more than 2 ** -126, if at all. Whole numbers have no digits there; denominators below 2 ** 31 take two steps of long division for each 62 digits, larger ones decimals."""
    num, den = c["num"], c["den"]
    div = lambda a, b: F.call_function("div", a, b)
    wide_den, near, far = den.cast("decimal(19,0)"), F.pmod(num, den), F.pmod(num, den)
    out = [div(num, den) - F.when(num % den < 0, 1).otherwise(0)]
    for _ in range(RANKS - 1):
        first = F.shiftleft(near, 31)
        second = F.shiftleft(first % den, 31)
        wide = far.cast("decimal(19,0)") * F.lit(Decimal(1 << 62))
        out.append(F.when(den == 1, F.lit(0).cast("long")).when(den < 1 << 31, F.shiftleft(div(first, den), 31) + div(second, den)).otherwise(div(wide, wide_den)))
        near, far = second % den, (wide % wide_den).cast("long")
    return out


def written(c: Column) -> Column:
    return F.when(c["den"] == 1, c["num"].cast("string")).otherwise(F.concat(c["num"].cast("string"), F.lit("/"), c["den"].cast("string")))
