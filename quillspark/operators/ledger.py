"""A ledger of permanent ids: every key gets an id once, ids move to other places or retire with their history, and none is given twice.

A ledger has the columns id, kind, seed (what the id was made from), place (where it is now), state (active or retired) and history, an array of
struct<field, was, now, reason>. Every function gives the next ledger and the requests that are refused, with the reason; a refused request changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHANGE = "struct<field: string, was: string, now: string, reason: string>"
SCHEMA = f"id string, kind string, seed string, place string, state string, history array<{CHANGE}>"


def fresh_id(kind: str = "kind", seed: str = "seed"):
    """The id of a kind and seed: the same on every run and engine."""
    return F.concat(F.substring(kind, 1, 3), F.lit("_"), F.substring(F.sha2(F.concat_ws("\x00", kind, seed), 256), 1, 20))


def _with(history, field: str, was, now, reason):
    return F.concat(history, F.array(F.struct(F.lit(field).alias("field"), was.cast("string").alias("was"), now.cast("string").alias("now"), reason.alias("reason"))))


def _refused(df: DataFrame, why) -> DataFrame:
    return df.select("kind", "seed", why.alias("refused"))


def allocate(ledger: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An id for each (kind, seed, place) that has none. Refused: a seed wanted at several places, one whose id is retired, one whose place an active id holds,
    and places that several new seeds want."""
    w = wanted.groupBy("kind", "seed").agg(F.min("place").alias("place"), F.count_distinct("place").alias("_places"))
    known = ledger.select("kind", "seed", F.col("state").alias("_state"))
    held = ledger.filter("state = 'active'").select("kind", "place").distinct().withColumn("_held", F.lit(True))
    judged = w.join(known, ["kind", "seed"], "left").join(held, ["kind", "place"], "left")
    new = F.col("_state").isNull()
    rivals = F.count(F.when(new & (F.col("_places") == 1), 1)).over(Window.partitionBy("kind", "place"))
    why = F.when(F.col("_places") > 1, "several places").when(F.col("_state") == "retired", "retired").when(new & F.col("_held"), "place is taken").when(new & (rivals > 1), "place is wanted twice")
    judged = judged.withColumn("_why", why)
    made = judged.filter(new & F.col("_why").isNull()).select(fresh_id().alias("id"), "kind", "seed", "place", F.lit("active").alias("state"), F.array().cast(f"array<{CHANGE}>").alias("history"))
    return ledger.unionByName(made), _refused(judged.filter("_why is not null"), F.col("_why"))


def rebind(ledger: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active ids go to other places: moves (kind, seed, to, reason), all at once, so two ids may change places. Refused: no reason, unknown or retired ids, several moves of
    one id, and places that would then be held twice (all moves to such a place are refused, also those to one that an id keeps)."""
    asked = moves.groupBy("kind", "seed").agg(F.min("to").alias("to"), F.min("reason").alias("reason"), F.count(F.lit(1)).alias("_asked"))
    j = asked.join(ledger.select("kind", "seed", "place", "state"), ["kind", "seed"], "left")
    why = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason").when(F.col("state").isNull(), "unknown").when(F.col("state") != "active", "retired").when(F.col("_asked") > 1, "asked for twice")
    j = j.withColumn("_why", why)
    fine = j.filter("_why is null")
    left = ledger.filter("state = 'active'").join(fine.select("kind", "seed"), ["kind", "seed"], "left_anti").select("kind", "place").distinct().withColumn("_kept", F.lit(True))
    rivals = F.count(F.lit(1)).over(Window.partitionBy("kind", "to"))
    fine = fine.withColumn("_rivals", rivals).join(left.withColumnRenamed("place", "to"), ["kind", "to"], "left")
    clash = F.coalesce("_kept", F.lit(False)) | (F.col("_rivals") > 1)
    good = fine.filter(~clash).select("kind", "seed", F.col("to").alias("_to"), F.col("reason").alias("_reason"))
    moved = ledger.join(good, ["kind", "seed"], "left").select(
        "id", "kind", "seed", F.coalesce("_to", "place").alias("place"), "state", F.when(F.col("_to").isNotNull() & ~F.col("_to").eqNullSafe(F.col("place")), _with(F.col("history"), "place", F.col("place"), F.col("_to"), F.col("_reason"))).otherwise(F.col("history")).alias("history")
    )
    return moved, _refused(j.filter("_why is not null"), F.col("_why")).unionByName(_refused(fine.filter(clash), F.lit("place is taken")))


def retire(ledger: DataFrame, gone: DataFrame, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Active ids become tombstones: gone (kind, seed, reason). owners (id, owner) are ids that active ids hang on. Refused: no reason, unknown or retired ids, and owners of
    ids that stay active."""
    asked = gone.groupBy("kind", "seed").agg(F.min("reason").alias("reason"))
    j = asked.join(ledger.select("id", "kind", "seed", "state"), ["kind", "seed"], "left")
    if owners is not None:
        staying = ledger.filter("state = 'active'").join(asked, ["kind", "seed"], "left_anti").select("id")
        owned = owners.join(staying, "id", "left_semi").select(F.col("owner").alias("id")).distinct().withColumn("_owns", F.lit(True))
        j = j.join(owned, "id", "left")
    else:
        j = j.withColumn("_owns", F.lit(None).cast("boolean"))
    why = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason").when(F.col("state").isNull(), "unknown").when(F.col("state") != "active", "retired").when(F.col("_owns"), "owns active ids")
    j = j.withColumn("_why", why)
    good = j.filter("_why is null").select("kind", "seed", F.col("reason").alias("_reason"))
    done = ledger.join(good, ["kind", "seed"], "left").select(
        "id", "kind", "seed", "place", F.when(F.col("_reason").isNotNull(), "retired").otherwise(F.col("state")).alias("state"), F.when(F.col("_reason").isNotNull(), _with(F.col("history"), "state", F.lit("active"), F.lit("retired"), F.col("_reason"))).otherwise(F.col("history")).alias("history")
    )
    return done, _refused(j.filter("_why is not null"), F.col("_why"))
