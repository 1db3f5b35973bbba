"""Overlays on base tables: compare-and-set corrections, upserts, replaced partitions, write plans. Every overlay row names the value that it replaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_overlay(base: DataFrame, overlay: DataFrame, key: str, field: str) -> DataFrame:
    """base with `field` replaced where an overlay row (key, was, value) still sees the base's value; state tells what happened to each key."""
    o = overlay.select(key, F.col("was").alias("_was"), F.col("value").alias("_value"), F.lit(True).alias("_has"))
    j = base.join(o, key, "left")
    fits = F.col("_has") & F.col("_was").eqNullSafe(F.col(field))
    state = F.when(F.col("_has").isNull(), "untouched").when(~fits, "stale").when(F.col("_value").eqNullSafe(F.col(field)), "noop").otherwise("applied")
    return j.withColumn("state", state).withColumn(field, F.when(fits, F.col("_value")).otherwise(F.col(field))).select(*base.columns, "state")


def upsert(base: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """Rows of update replace those of base with the same key; the rest of base stays."""
    return base.join(update.select(*key).distinct(), key, "left_anti").select(*base.columns).unionByName(update.select(*base.columns))


def insert_absent(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key base lacks."""
    return new.join(base.select(*key).distinct(), key, "left_anti")


def carry_over(new: DataFrame, old: DataFrame, key: str, column: str) -> DataFrame:
    """new with a column of the old table where its own is null."""
    return new.join(old.select(key, F.col(column).alias("_old")), key, "left").withColumn(column, F.coalesce(column, "_old")).drop("_old")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 of the columns' canonical text: null is told from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit("n")) for c in columns)), 256)


def constraints(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks: key, rule."""
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def three_way(ours: Column, base: Column, theirs: Column) -> Column:
    """unchanged, ours, theirs, same or conflict."""
    return F.when(ours.eqNullSafe(base) & theirs.eqNullSafe(base), "unchanged").when(theirs.eqNullSafe(base), "ours").when(ours.eqNullSafe(base), "theirs").when(ours.eqNullSafe(theirs), "same").otherwise("conflict")


def first_rows(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
