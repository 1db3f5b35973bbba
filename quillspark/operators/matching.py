"""Joins with a preference: ranges, nearest rows, tiers, alignment, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, part: list[str], *order: Column | str) -> DataFrame:
    """The first row of each partition in an order that ends in a unique key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter("_n = 1").drop("_n")


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Points and the ranges [lo, hi] of integers that hold them, by an equi-join on cells of `width`: each range is copied to the cells it touches."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    keyed = points.withColumn("_cell", F.floor(F.col(at) / width))
    return keyed.join(cells, [*(on or []), "_cell"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_cell")


def tiered(tiers: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first tier that has any for a key; the tier's place from 1 is added."""
    union = None
    for i, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(i))
        union = t if union is None else union.unionByName(t)
    return union.withColumn("_t", F.min("tier").over(Window.partitionBy(*key))).filter("tier = _t").drop("_t")


def near_best(df: DataFrame, part: list[str], score: str, within: float, *order: Column | str) -> DataFrame:
    """Of the rows whose score is within a margin of their partition's best, the first in order."""
    best = F.max(score).over(Window.partitionBy(*part))
    return first_of(df.withColumn("_b", best).filter(F.col(score) >= F.col("_b") - within).drop("_b"), part, *order)


def unique_or_queue(candidates: DataFrame, key: list[str]) -> DataFrame:
    """n_candidates for each row, and accepted where it is the only one of its key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return candidates.withColumn("n_candidates", n).withColumn("accepted", n == 1)


def aligned(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Full-outer alignment: missing, extra, changed or equal for each key, with the fields that differ."""
    a, b = left.select(*key, F.struct(*fields).alias("_a")), right.select(*key, F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.size(differ) > 0, "changed").otherwise("equal")
    return both.select(*key, state.alias("state"), F.when(state == "changed", F.array_join(differ, ",")).otherwise("").alias("fields"))


def reconciled(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two sources of one value: agree, disagree, left only or right only."""
    a, b = left.select(*key, F.col(value).alias("left_value")), right.select(*key, F.col(value).alias("right_value"))
    status = F.when(F.col("left_value").isNull(), "right").when(F.col("right_value").isNull(), "left").when(F.col("left_value") == F.col("right_value"), "agree").otherwise("disagree")
    return a.join(b, key, "full_outer").withColumn("status", status)


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field whose value changed between two tables: key, field, was, now (as strings)."""
    a, b = before.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields)), after.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("was"), F.col(f"b_{f}").alias("now")) for f in fields)))
    return a.join(b, key).select(key, rows.alias("r")).select(key, "r.*").filter(~F.col("was").eqNullSafe(F.col("now")))
