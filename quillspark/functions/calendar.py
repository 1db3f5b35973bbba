"""Calendar arithmetic on columns: Easter, Advent, seasons, cycles. Integers and dates only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def easter(year: str) -> Column:
    """The Gregorian Easter of a year column, by the anonymous computus in integer arithmetic."""
    y = year
    h = f"((19 * ({y} % 19) + {y} div 100 - ({y} div 100) div 4 - ({y} div 100 - ({y} div 100 + 8) div 25 + 1) div 3 + 15) % 30)"
    l = f"((32 + 2 * (({y} div 100) % 4) + 2 * (({y} % 100) div 4) - {h} - ({y} % 100) % 4) % 7)"
    m = f"((({y} % 19) + 11 * {h} + 22 * {l}) div 451)"
    n = f"({h} + {l} - 7 * {m} + 114)"
    return F.expr(f"make_date(cast({y} as int), cast({n} div 31 as int), cast({n} % 31 + 1 as int))")


def advent_start(year: Column) -> Column:
    """The Sunday on or after 27 November: the fourth before Christmas."""
    return F.next_day(F.make_date(year, F.lit(11), F.lit(26)), "Sun")


def season(date: Column, easter_date: Column, advent: Column) -> Column:
    off = F.datediff(date, easter_date)
    return (
        F.when(date >= advent, F.when((F.month(date) == 12) & (F.dayofmonth(date) >= 25), "christmas").otherwise("advent"))
        .when((F.month(date) == 1) & (F.dayofmonth(date) <= 13), "christmas")
        .when((off >= -63) & (off < -46), "septuagesima")
        .when((off >= -46) & (off < 0), "lent")
        .when((off >= 0) & (off < 56), "easter")
        .when(off >= 56, "pentecost")
        .otherwise("epiphany")
    )


def cycle(date: Column, advent: Column) -> Column:
    """A, B or C: the year that begins with Advent, by its number modulo 3."""
    year = F.year(date) + F.when(date >= advent, 1).otherwise(0)
    return F.element_at(F.array(F.lit("C"), F.lit("A"), F.lit("B")), (year % 3 + 1).cast("int"))
