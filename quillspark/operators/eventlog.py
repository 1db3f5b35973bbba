"""Event logs of notes: ties merged with exact durations, and events placed in measures, by windows of a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rationals as q


def merge_ties(notes: DataFrame, part: list[str], order: list[str], pitch: str, duration: str, tied: str) -> DataFrame:
    """A note with `tied` set goes on in the next note of its part, if that has the same pitch: both are one event, with the exact sum of their durations (fractions).

    Returned: part, first (the order columns of the first note), pitch, total, notes, and dangling, where the last note is tied to no note of its pitch."""
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.lag(F.struct(pitch, tied)).over(w)
    goes_on = F.coalesce(before[tied] & (before[pitch] == F.col(pitch)), F.lit(False))
    numbered = notes.withColumn("_event", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the notes of one event, in order: a tie is a few notes long
    held = numbered.groupBy(*part, "_event").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(pitch).alias("_pitch"), F.col(duration).alias("_length"), F.col(tied).alias("_tied")))).alias("_notes"))
    first, last = F.element_at("_notes", 1), F.element_at("_notes", -1)
    # most events are one note: nothing is added up
    total = F.aggregate(F.transform(F.slice("_notes", F.lit(2), F.size("_notes")), lambda x: x["_length"]), first["_length"], q.plus)
    return held.select(*part, F.struct(*(first[c].alias(c) for c in order)).alias("first"), first["_pitch"].alias(pitch), total.alias("total"), F.size("_notes").alias("notes"), last["_tied"].alias("dangling"))


def in_measures(events: DataFrame, part: list[str], lines: DataFrame, onset: str, line: str, number: str) -> DataFrame:
    """events with the measure they begin in and the place within it: the last measure line at or before the onset (both fractions). An event before the first line has none.

    Fractions are put in order by whole numbers (rationals.ranks), so no double decides, and each side is shuffled once."""
    ranks = lambda c: [x.alias(f"_r{i}") for i, x in enumerate(q.ranks(F.col(c)))]
    e = events.select(*part, *ranks(onset), F.lit(1).alias("_side"), F.struct(*(c for c in events.columns if c not in part)).alias("_e"))
    m = lines.select(*part, *ranks(line), F.lit(0).alias("_side"), F.struct(F.col(number).alias("n"), F.col(line).alias("at")).alias("_m"))
    both = e.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy(*(f"_r{i}" for i in range(q.RANKS)), "_side").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).filter("_side = 1")
    return placed.select(*part, "_e.*", F.col("_m.n").alias(number), q.minus(F.col("_e")[onset], F.col("_m.at")).alias("place"))
