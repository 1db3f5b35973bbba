"""Ordered analytics: spans, islands, as-of values, running totals. Every order ends in a unique key, given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(part: list[str], *order: str | Column) -> Window:
    return Window.partitionBy(*part).orderBy(*order)


def span_lead(df: DataFrame, part: list[str], start: str, tie: list[str], end: str = "span_end") -> DataFrame:
    """A row runs to the start of the next one of its parent; the last has no end."""
    return df.withColumn(end, F.lead(start).over(by(part, start, *tie)))


def next_distinct(df: DataFrame, part: list[str], start: str, end: str = "span_end") -> DataFrame:
    """As span_lead, but rows with the same start share one end: the next greater start."""
    starts = df.select(*part, start).distinct().withColumn(end, F.lead(start).over(by(part, start)))
    return df.join(starts, [*part, start])


def span_assign(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Each point with the span [start, end) of its key that holds it, null for no end. Spans of a key don't overlap, so the one that holds a point is the last to begin
    at or before it: one union and one running window, no pair of spans and points. Spans without a length hold nothing."""
    of = lambda df: F.struct(*(c for c in df.columns if c != key))
    s = spans.select(key, F.col(start).alias("_at"), F.lit(0).alias("_side"), of(spans).alias("_s"), F.lit(None).cast(points.select(of(points)).schema[0].dataType).alias("_p"))
    p = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(spans.select(of(spans)).schema[0].dataType).alias("_s"), of(points).alias("_p"))
    w = by([key], "_at", "_side", F.col(f"_s.{end}").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    owned = s.unionByName(p).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_side = 1 and _s is not null")
    return owned.filter(F.col(f"_s.{end}").isNull() | (F.col("_at") < F.col(f"_s.{end}"))).select(key, "_p.*", "_s.*")


def count_between(spans: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, out: str) -> DataFrame:
    """spans with the number of points of their key strictly between low and high, by running counts over a union; spans with a null bound have none."""
    bound = F.explode(F.array(F.struct(F.col(low).alias("_at"), F.lit(2).alias("_side"), F.lit(-1).alias("_sign")), F.struct(F.col(high).alias("_at"), F.lit(0).alias("_side"), F.lit(1).alias("_sign"))))
    wanted = [c for c in spans.columns if c != key]
    marks = spans.filter(F.col(low) < F.col(high)).select(key, F.struct(*wanted).alias("_row"), bound.alias("_b")).select(key, "_row", "_b.*")
    rows = points.select(key, F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(0).alias("_sign"))
    w = by([key], "_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.when(F.col("_side") == 1, 1)).over(w)
    return marks.unionByName(rows).withColumn("_n", n * F.col("_sign")).filter("_side <> 1").groupBy(key, "_row").agg(F.sum("_n").alias(out)).select(key, "_row.*", out)


def as_of_backward(left: DataFrame, right: DataFrame, part: list[str], at: str, value: str, out: str) -> DataFrame:
    """left with the last value of right at or before each row: one union and one running window, no range join. Of rows of right with one time the greatest value counts."""
    cols = left.columns
    r = right.groupBy(*part, at).agg(F.max(value).alias("_v"))
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    frame = by(part, at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(frame)).filter("_side = 1").select(*cols, out)


def as_of_forward(left: DataFrame, right: DataFrame, part: list[str], at: str, value: str, out: str) -> DataFrame:
    """left with the first value of right at or after each row; of rows of right with one time the least value counts."""
    cols = left.columns
    r = right.groupBy(*part, at).agg(F.min(value).alias("_v"))
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0)).unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    frame = by(part, at, "_side").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(out, F.first("_v", ignorenulls=True).over(frame)).filter("_side = 0").select(*cols, out)


def islands(df: DataFrame, part: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """Numbers runs of equal adjacent values within each partition, from 1."""
    w = by(part, *order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn(out, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def sessions(df: DataFrame, part: list[str], at: str, tie: list[str], gap_seconds: int, out: str = "session") -> DataFrame:
    """Numbers sessions: a row more than gap_seconds after the one before begins a new one."""
    w = by(part, at, *tie)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return df.withColumn("_g", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)).withColumn(out, F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """The k first rows of each partition."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(out) <= k)


def running_budget(df: DataFrame, part: list[str], order: list[str], size: str, most: float) -> DataFrame:
    """The longest prefix of each partition whose running size fits, and at least its first row."""
    w = by(part, *order)
    return df.withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w)).filter((F.col("running") <= most) | (F.col("_n") == 1)).drop("_n")


def number_repeats(df: DataFrame, part: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """1st, 2nd … of a kind in order, null where the kind occurs once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return df.withColumn(out, F.when(n > 1, F.row_number().over(by(part, *order))))


def range_gaps(df: DataFrame, part: list[str], first: str, last: str) -> DataFrame:
    """Missing integer ranges between ordered segments of each partition, covering overlaps by the running end."""
    before = F.max(last).over(by(part, first, last).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_e", before).filter(F.col(first) > F.col("_e") + 1).select(*part, (F.col("_e") + 1).alias("gap_first"), (F.col(first) - 1).alias("gap_last"))
