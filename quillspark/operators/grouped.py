"""Aggregations with a rule: zero-filled counts, votes, coverage, worst status, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(dim: DataFrame, facts: DataFrame, key: str, out: str = "n") -> DataFrame:
    """A count for every row of a dimension, zero where facts have none; facts are counted before they are joined."""
    return dim.join(facts.groupBy(key).agg(F.count(F.lit(1)).alias(out)), key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def mode_vote(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the least), its votes, its share and the number that disagree."""
    n = df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("votes"))
    g = n.groupBy(*part).agg(F.max(F.struct("votes", (-F.col(value)).alias("_v"))).alias("_m"), F.sum("votes").alias("total"))
    return g.select(*part, (-F.col("_m._v")).alias(value), F.col("_m.votes").alias("votes"), (F.col("_m.votes") / F.col("total")).alias("share"), (F.col("total") - F.col("_m.votes")).alias("disagree"))


def duplicates(df: DataFrame, key: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > 1)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the least order value of each key, as an aggregate that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_r")
    return df.groupBy(*key).agg(ranked).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def worst_status(df: DataFrame, part: list[str], status: str, order: list[str], out: str = "worst") -> DataFrame:
    """The first status of an ordered list that a group has."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return df.groupBy(*part).agg(F.min(F.when(at > 0, at)).alias("_p")).select(*part, F.element_at(F.array(*map(F.lit, order)), F.col("_p").cast("int")).alias(out))


def percentiles(df: DataFrame, part: str, value: str, wanted: dict[str, float], cells: int = 256) -> DataFrame:
    """Exact nearest-rank percentiles of each group; rows with a null value don't count. Values are counted in cells first, whose bounds are estimated quantiles of the group, so
    that cells have about as many rows each, however values are spread; only the cells that the ranks fall into are ranked value by value."""
    rows = df.filter(F.col(value).isNotNull())
    cuts = F.array(*(F.lit(k / cells) for k in range(1, cells)))
    ends = rows.groupBy(part).agg(F.percentile_approx(value, cuts, F.lit(4 * cells)).alias("_bounds"), F.count(F.lit(1)).alias("_total"))  # a row a group
    cell = F.size(F.filter("_bounds", lambda b: b < F.col(value))).alias("_cell")
    counts = rows.groupBy(part, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.join(ends, counts[part].eqNullSafe(ends[part])).select(counts[part], value, "_n", "_total", cell)
    order = Window.partitionBy(part).orderBy("_cell")
    sums = placed.groupBy(part, "_cell").agg(F.sum("_n").alias("_in"), F.first("_total").alias("_total"))  # at most `cells` rows a group
    sums = sums.withColumn("_before", F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"))
    rank = lambda q: F.ceil(F.col("_total") * q)
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), rank(q).alias("_rank")) for name, q in wanted.items())))
    asked = sums.select(part, "_cell", "_before", "_in", ranks.alias("_r")).select(F.col(part).alias("_part"), F.col("_cell").alias("_at"), "_before", "_in", "_r.*").filter("_rank > _before and _rank <= _before + _in")
    within = placed.join(asked, placed[part].eqNullSafe(asked["_part"]) & (placed["_cell"] == asked["_at"]))
    upto = F.sum("_n").over(Window.partitionBy(part, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    found = within.withColumn("_upto", upto).filter("_upto >= _rank")
    return found.groupBy(part).agg(*(F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in wanted))


def strata_sample(df: DataFrame, stratum: str, key: Column, per_stratum: int) -> DataFrame:
    """Hash-ordered rows, so many of each stratum: the same rows on every run."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(key.cast("string"), 256), key)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= per_stratum)


def inverted(df: DataFrame, items: Column, row: Column, out: str = "key") -> DataFrame:
    """For each item of an array column the sorted distinct rows that hold it, and how many."""
    exploded = df.select(F.explode(F.array_distinct(items)).alias(out), row.alias("_r"))
    return exploded.groupBy(out).agg(F.array_sort(F.collect_set("_r")).alias("rows"), F.count(F.lit(1)).alias("n"))
