"""Keys bound to ledger entries in stages, approvals bound to the digest of what they approved, and borrowed parts put in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A lender of more parts than HOT is met in SPREAD places.
HOT, SPREAD = 1_000_000, 32


def bind(wanted: DataFrame, entries: DataFrame, stages: list[str]) -> DataFrame:
    """wanted (key and a column a stage) with id (of entries: id and the same columns), stage and error. Each stage binds what the stages before left, to entries that are left, by one column.

    Within a stage, a value that several entries have is `ambiguous`, and one that several wanted rows have is `claimed twice`: neither is bound, then or later. A row that no stage binds has
    no id and no error: it is new."""
    rows, free, done = wanted, entries, None
    for stage in stages:
        side = free.filter(F.col(stage).isNotNull()).groupBy(stage).agg(F.count(F.lit(1)).alias("_entries"), F.min("id").alias("_id"))
        j = rows.join(side, stage, "left")
        rivals = F.count(F.lit(1)).over(Window.partitionBy(stage))
        error = F.when(F.col("_id").isNull(), None).when(F.col("_entries") > 1, "ambiguous").when(rivals > 1, "claimed twice")
        j = j.withColumn("_error", error)
        found = j.filter("_id is not null").select(*wanted.columns, F.when(F.col("_error").isNull(), F.col("_id")).alias("id"), F.lit(stage).alias("stage"), F.col("_error").alias("error"))
        done = found if done is None else done.unionByName(found)
        rows = j.filter("_id is null").select(*wanted.columns)
        free = free.join(found.filter("id is not null").select("id"), "id", "left_anti")
    return done.unionByName(rows, allowMissingColumns=True)


def approval_states(items: DataFrame, approvals: DataFrame, key: str) -> DataFrame:
    """items (key, digest) with state and by. approvals: key, digest, at, by, verdict (approved, revoked). The last word on a key's present digest decides: approved is `current`, revoked is
    `revoked`. Without one, an approval of an equal digest under another key carries over (`carried`); else one of an earlier digest has `lapsed`; else `open`."""
    last = approvals.groupBy(key, "digest").agg(F.max(F.struct("at", "verdict", "by")).alias("last"))
    own = last.select(key, "digest", F.col("last.verdict").alias("verdict"), F.col("last.by").alias("by"))
    same = last.filter("last.verdict = 'approved'").groupBy("digest").agg(F.min(F.struct("last.at", "last.by")).alias("other"))
    before = approvals.filter("verdict = 'approved'").groupBy(key).agg(F.lit(True).alias("earlier"))
    j = items.join(own, [key, "digest"], "left").join(same, "digest", "left").join(before, key, "left")
    state = F.when(F.col("verdict") == "approved", "current").when(F.col("verdict") == "revoked", "revoked").when(F.col("other").isNotNull(), "carried").when(F.col("earlier"), "lapsed").otherwise("open")
    return j.select(key, state.alias("state"), F.when(state == "current", F.col("by")).when(state == "carried", F.col("other.by")).alias("by"))


def with_borrowed(parts: DataFrame, slices: DataFrame, key: str, order: list[str], lender: str) -> DataFrame:
    """parts of a key in order, those with a lender replaced by the lender's slices (slices: key, at, value), numbered anew; a part whose lender has no slices stays as it is and is marked
    `unresolved`. Returned: key, place (from 1), value, source (own, borrowed or unresolved). parts have a `value`.

    Parts without a lender meet nothing. Lenders of more than HOT parts, which are few, are met in SPREAD places each, so that none of them is one task."""
    lends, wanted = F.col(lender), parts.filter(F.col(lender).isNotNull())
    hot = F.broadcast(wanted.groupBy(lender).agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") > HOT).select(lender, F.lit(True).alias("_hot")))
    spread = lambda df: df.join(hot, lender, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    n = slices.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(lender)).agg(F.count(F.lit(1)).alias("_n"))
    salted = wanted.join(hot, lender, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(key, *order), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("_hot")
    p = salted.join(spread(n), [lender, "_salt"], "left").unionByName(parts.filter(lends.isNull()), allowMissingColumns=True).withColumn("_size", F.coalesce("_n", F.lit(1)))
    w = Window.partitionBy(key).orderBy(*order)
    p = p.withColumn("_before", F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = p.filter("_n is null").select(key, (F.col("_before") + 1).alias("place"), "value", F.when(lends.isNull(), "own").otherwise("unresolved").alias("source"))
    lent = slices.select(F.col(key).alias(lender), F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("_i"), F.col("value").alias("_lent"))
    borrowed = p.filter("_n is not null").join(spread(lent), [lender, "_salt"]).select(key, (F.col("_before") + F.col("_i")).alias("place"), F.col("_lent").alias("value"), F.lit("borrowed").alias("source"))
    return own.unionByName(borrowed)
