"""Corrections in layers: runs of systems first, in file order, then lists, then single values; each is checked against what its predecessors left, and all problems are told.

A volume's systems are numbered from 1 and each belongs to one piece or none; parts start on systems. A correction of a piece's run gives it the systems from a to b: those it had
outside go free, and neighbours lose what it takes. Such corrections depend on one another in file order, but only where they touch: each touches the systems that it asks
for, the piece that it is about, and the pieces that have any of those systems. In a round, every correction that is the first of all pending ones at everything it touches is decided,
so a round decides all that don't wait for another, in any number of volumes, and the rounds are as many as the longest row of corrections that wait for one another. What a round
leaves is a table, so each check is a join, and the outcome is that of going through the file line by line.

Rounds move every system several times, so they are for volumes of more than MOST_HELD systems and corrections. All others are dealt out by volume once, and gone through line by line.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .graph import _cut, _drop
from .state import fold_rows, same

#: Systems and corrections of a volume that a task holds.
MOST_HELD = 50_000

#: The problems of a run, in the order in which they are looked for.
NO_RUN, STALE, LEAVES, WHOLE, SPLITS, TAKES = "no run of systems", "stale", "leaves a part outside", "takes all of another", "splits another", "takes a part of another"


def _touched(pending: DataFrame, owner: DataFrame) -> DataFrame:
    """seq, volume, target, a, b, system, piece: every system that a pending correction asks for, with the piece that has it."""
    return pending.select("*", F.explode(F.sequence("a", "b")).alias("system")).join(owner, ["volume", "system"], "left")


def _ready(pending: DataFrame, touched: DataFrame) -> DataFrame:
    """The corrections that are the first at everything they touch."""
    token = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("token")
    tokens = touched.select("volume", "seq", token("s", "system")).unionByName(touched.filter("piece IS NOT NULL").select("volume", "seq", token("p", "piece"))).unionByName(pending.select("volume", "seq", token("p", "target"))).distinct()
    first = F.min("seq").over(Window.partitionBy("volume", "token")) == F.col("seq")
    ready = tokens.withColumn("first", first).groupBy("volume", "seq").agg(F.bool_and("first").alias("ready")).filter("ready")
    return pending.join(ready.select("volume", "seq"), ["volume", "seq"], "left_semi")


def _judged(ready: DataFrame, touched: DataFrame, owner: DataFrame, parts: DataFrame) -> DataFrame:
    """ready with problem, null where a correction can land."""
    runs = owner.filter("piece IS NOT NULL").groupBy("volume", "piece").agg(F.min("system").alias("now_a"), F.max("system").alias("now_b"), F.count(F.lit(1)).alias("n"))
    own = ready.join(runs.withColumnRenamed("piece", "target"), ["volume", "target"], "left")
    stale = ~(F.col("was_a").eqNullSafe(F.col("now_a")) & F.col("was_b").eqNullSafe(F.col("now_b")))
    starts = owner.join(parts.select("volume", "system").distinct(), ["volume", "system"], "left_semi").select("volume", F.col("piece").alias("target"), "system")
    left = ready.join(starts, ["volume", "target"]).filter(~F.col("system").between(F.col("a"), F.col("b"))).select("volume", "seq").distinct().withColumn("leaves", F.lit(True))
    lost = touched.join(ready.select("volume", "seq"), ["volume", "seq"], "left_semi").filter(F.col("piece") != F.col("target")).join(parts.select("volume", "system", F.lit(1).alias("starts")).distinct(), ["volume", "system"], "left")
    lost = lost.groupBy("volume", "seq", "piece").agg(F.count(F.lit(1)).alias("lost"), F.min("system").alias("lost_a"), F.max("system").alias("lost_b"), F.max("starts").alias("starts")).join(runs, ["volume", "piece"])
    whole = F.col("lost") == F.col("n")
    splits = ~whole & (F.col("lost_a") != F.col("now_a")) & (F.col("lost_b") != F.col("now_b"))
    others = lost.groupBy("volume", "seq").agg(F.max(whole).alias("whole"), F.max(splits).alias("splits"), F.max("starts").alias("takes"))
    j = own.withColumn("stale", stale).join(left, ["volume", "seq"], "left").join(others, ["volume", "seq"], "left")
    problem = F.when(F.col("stale"), STALE).when(F.col("leaves"), LEAVES).when(F.col("whole"), WHOLE).when(F.col("splits"), SPLITS).when(F.col("takes").isNotNull(), TAKES)
    return j.select(*ready.columns, problem.alias("problem"))


def _line_by_line(has: dict, starts: set, entries: list[tuple]) -> list[tuple]:
    """seq and problem of one volume's corrections (seq, target, a, b, was_a, was_b), in file order; has (piece by system) is as they leave it."""
    size, of, told = max((s for s in has if s is not None), default=0), {}, []
    for s, p in has.items():
        if p is not None:
            of.setdefault(p, set()).add(s)
    for seq, target, a, b, *was in entries:
        if a is None or b is None or not 1 <= a <= b <= size:
            told.append((seq, NO_RUN))
            continue
        own, lost, problem = of.get(target, set()), {}, None
        for s in range(a, b + 1):
            p = has.get(s)
            if p is not None and target is not None and p != target:
                lost.setdefault(p, []).append(s)
        if was != ([min(own), max(own)] if own else [None, None]):
            problem = STALE
        elif any(s in starts and not a <= s <= b for s in own):
            problem = LEAVES
        elif any(len(x) == len(of[p]) for p, x in lost.items()):
            problem = WHOLE
        elif any(x[0] != min(of[p]) and x[-1] != max(of[p]) for p, x in lost.items()):
            problem = SPLITS
        elif any(s in starts for x in lost.values() for s in x):
            problem = TAKES
        elif target is not None:
            for p, x in lost.items():
                of[p].difference_update(x)
            has.update(dict.fromkeys(own))
            of[target] = {s for s in range(a, b + 1) if s in has}
            has.update(dict.fromkeys(of[target], target))
        told.append((seq, problem))
    return told


def _by_volume(owner: DataFrame, parts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """apply_runs where a task can hold any volume."""
    kind = lambda n: F.lit(n).cast("byte").alias("kind")
    rows = owner.select("volume", kind(0), F.col("system").alias("at"), "piece").unionByName(parts.select("volume", kind(1), F.col("system").alias("at")).distinct(), allowMissingColumns=True)
    rows = rows.unionByName(entries.select("volume", kind(2), F.col("seq").alias("at"), F.col("target").alias("piece"), "a", "b", "was_a", "was_b"), allowMissingColumns=True)
    out = rows.select("volume", F.col("at").alias("system"), "piece", F.col("at").alias("seq"), F.lit("").alias("problem"), F.lit(False).alias("told")).schema
    out = StructType([StructField(f.name, f.dataType) for f in out])  # each is null in some rows
    arrow = to_arrow_schema(out)

    def run(batches):
        volume, has, starts, entries, made = object(), {}, set(), [], []

        def end():
            if entries and volume is None:  # no volume, no run
                told = [(seq, NO_RUN) for seq, *_ in entries]
            else:
                told = _line_by_line(has, starts, entries)
            made.extend((volume, s, p, None, None, False) for s, p in has.items())
            made.extend((None, None, None, seq, problem, True) for seq, problem in told)

        def given():
            table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
            made.clear()
            return table

        for batch in batches:
            for v, k, at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not same(v, volume):
                    end()
                    volume, has, starts, entries = v, {}, set(), []
                if k == 0:
                    has[at] = row[0]
                elif k == 1:
                    starts.add(at)
                else:
                    entries.append((at, *row))
            if len(made) > 20_000:
                yield given()
        end()
        if made:
            yield given()

    done = _cut(rows.repartition("volume").sortWithinPartitions("volume", "kind", "at").mapInArrow(run, out))
    return done.filter("NOT told").select(*owner.columns), done.filter("told").select("seq", "problem")


def apply_runs(owner: DataFrame, parts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owner (volume, system, piece) after the corrections of runs, and each correction's seq with its problem (null: it has landed).

    parts: volume, system of each part's start. entries: seq (unique, in file order), volume, target, a, b, was_a, was_b."""
    size = owner.select("volume").unionByName(entries.select("volume")).groupBy("volume").count()
    large = _cut(size.filter(F.col("count") > MOST_HELD).select(F.col("volume").alias("_v")))
    if large.isEmpty():
        return _by_volume(owner, parts, entries)
    where = lambda df, how: df.join(large, F.col("volume").eqNullSafe(F.col("_v")), how)
    few, many = (fit(*(where(df, how) for df in (owner, parts, entries))) for fit, how in ((_by_volume, "left_anti"), (_by_rounds, "left_semi")))
    return few[0].unionByName(many[0]), few[1].unionByName(many[1])


def _by_rounds(owner: DataFrame, parts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """apply_runs for volumes of any size."""
    sizes = owner.groupBy("volume").agg(F.max("system").alias("size"))
    columns = ["volume", "seq", "target", "a", "b", "was_a", "was_b"]
    formed = entries.select(*columns).join(sizes, "volume", "left").withColumn("ok", F.coalesce((F.col("a") >= 1) & (F.col("a") <= F.col("b")) & (F.col("b") <= F.col("size")), F.lit(False)))
    formed = _cut(formed)
    decided = [formed.filter("NOT ok").select("seq", F.lit(NO_RUN).alias("problem"))]
    pending = _cut(formed.filter("ok").select(*columns))
    waits = pending.select("volume").distinct()
    still, moving = [_cut(owner.join(waits, "volume", "left_anti"))], _cut(owner.join(waits, "volume", "left_semi"))
    while not pending.isEmpty():
        touched = _cut(_touched(pending, moving))
        judged = _cut(_judged(_ready(pending, touched), touched, moving, parts))
        decided.append(judged.select("seq", "problem"))
        landed = judged.filter("problem IS NULL")
        taken = landed.select("volume", F.explode(F.sequence("a", "b")).alias("system"), F.col("target").alias("to"))
        freed = landed.select("volume", F.col("target").alias("piece"), F.lit(True).alias("freed"))
        after = moving.join(taken, ["volume", "system"], "left").join(freed, ["volume", "piece"], "left").select("volume", "system", F.coalesce("to", F.when(F.col("freed").isNull(), F.col("piece"))).alias("piece"))
        before, pending = pending, _cut(pending.join(judged, ["volume", "seq"], "left_anti"))
        # volumes without anything pending are done
        waits = pending.select("volume").distinct()
        still.append(_cut(after.join(waits, "volume", "left_anti")))
        old, moving = moving, _cut(after.join(waits, "volume", "left_semi"))
        for df in (touched, before, old):
            _drop(df)
    return reduce(DataFrame.unionByName, still), reduce(DataFrame.unionByName, decided)


# ---- lists ----

LIST = "array<struct<part: string, at: long>>"


def apply_lists(owner: DataFrame, lists: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lists (piece, list of part and at, in printed order) after the corrections of whole lists, and each correction's seq with its problem.

    entries: seq, target, was, value (lists). They count from the runs as corrected: every start is a system of the piece, and starts rise. Each is checked against the list that
    the one before it left."""
    runs = owner.filter("piece IS NOT NULL").groupBy(F.col("piece").alias("target")).agg(F.min("system").alias("first"), F.max("system").alias("last"))
    now = lists.select(F.col("piece").alias("target"), F.col("list").alias("now"), F.lit(True).alias("known"))
    rows = entries.join(now, "target", "left").join(runs, "target", "left").select("target", "seq", "was", "value", "now", F.coalesce("known", F.lit(False)).alias("known"), "first", "last")

    def step(state, row):
        was, value, now, known, first, last = row
        has = now if state is None else state[0]
        plain = lambda x: None if x is None else [(p["part"], p["at"]) for p in x]
        if not known:
            return state, "unknown target"
        if plain(was) != plain(has):
            return state, STALE
        places = [p["at"] for p in value or ()]
        if first is None or any(p is None or not first <= p <= last for p in places):
            return state, "a part starts outside"
        if any(p >= q for p, q in zip(places, places[1:], strict=False)):
            return state, "parts out of order"
        return (value,), None

    told = _cut(fold_rows(rows, "target", ["seq"], ["was", "value", "now", "known", "first", "last"], ["target", "seq", "value"], "problem", "string", lambda: None, step))
    last = told.filter("problem IS NULL").groupBy(F.col("target").alias("piece")).agg(F.max_by(F.struct("value"), "seq").alias("new"))
    after = lists.join(last, "piece", "left").select("piece", F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col("list")).alias("list"))
    return after, told.select("seq", "problem")


# ---- single values ----


def judge_values(fields: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (seq, id, target, field, was, value) with problem, against fields (target, field, value) as the layers before left them. Of several for one value the first counts, the
    others are problems even if it is one itself."""
    w = Window.partitionBy("target", "field")
    first = F.min_by("id", "seq").over(w)
    known = fields.select("target", "field", F.col("value").alias("now"), F.lit(True).alias("known"))
    problem = F.when(F.min("seq").over(w) != F.col("seq"), F.concat(F.lit("corrected already by "), first)).when(F.col("known").isNull(), "unknown target").when(~F.col("was").eqNullSafe(F.col("now")), STALE)
    return entries.join(known, ["target", "field"], "left").select(*entries.columns, problem.alias("problem"))


def put_values(fields: DataFrame, judged: DataFrame) -> DataFrame:
    new = judged.filter("problem IS NULL").select("target", "field", F.struct("value").alias("new"))
    return fields.join(new, ["target", "field"], "left").select("target", "field", F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col("value")).alias("value"))


def order_problems(lists: DataFrame, moves: DataFrame) -> DataFrame:
    """seq, problem: for each piece (piece, list after all moves) whose parts don't start in printed order, its last move (seq, piece)."""
    rises = F.forall(F.sequence(F.lit(1), F.size("list")), lambda i: (i == F.size("list")) | (F.element_at("list", i)["at"] < F.element_at("list", F.least(i + 1, F.size("list")))["at"]))
    wrong = lists.filter((F.size("list") > 1) & ~rises).select("piece")
    return moves.join(wrong, "piece").groupBy("piece").agg(F.max("seq").alias("seq")).select("seq", F.lit("parts out of order").alias("problem"))


# ---- all layers ----


def apply_layers(owner: DataFrame, lists: DataFrame, fields: DataFrame, links: DataFrame, runs: DataFrame, whole_lists: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(problems, owner, lists, fields, links): every correction applied, or, where any has a problem, the tables as they were, with all problems (seq, problem).

    runs as for apply_runs, but target is enough (its volume is the one that it stands in); whole_lists as for apply_lists; values as for judge_values, where the field `start` of
    the target `piece/part` moves a part. links (borrower, target like `piece/part`) are resolved last, against what all layers left: with volume and system of the lender, null where it is gone.
    A seq is a line of the file: no two corrections share one."""
    parts = lists.select("piece", F.explode("list").alias("p")).select("piece", "p.part", "p.at")
    volumes = owner.filter("piece IS NOT NULL").select("piece", "volume").distinct()
    starts = parts.join(volumes, "piece").select("volume", F.col("at").alias("system"))
    placed = runs.join(volumes.withColumnRenamed("piece", "target"), "target", "left")
    unknown = placed.filter("volume IS NULL").select("seq", F.lit("unknown target").alias("problem"))
    layer, told = apply_runs(owner, starts, placed.filter("volume IS NOT NULL"))
    layer = _cut(layer)
    listed, told_lists = apply_lists(layer, lists, whole_lists)
    listed = _cut(listed)
    # a part's start is a value like others, of the list as it is now
    now = listed.select("piece", F.explode("list").alias("p")).select("piece", F.concat("piece", F.lit("/"), "p.part").alias("target"), F.lit("start").alias("field"), F.col("p.at").cast("string").alias("value"))
    judged = _cut(judge_values(fields.unionByName(now.drop("piece")), values))
    ends = layer.filter("piece IS NOT NULL").groupBy("piece").agg(F.min("system").alias("first"), F.max("system").alias("last"))
    moved = judged.filter("field = 'start' AND problem IS NULL").join(now.select("target", "piece"), "target").join(ends, "piece", "left").withColumn("to", F.col("value").try_cast("long"))
    outside = moved.filter(~F.coalesce(F.col("to").between(F.col("first"), F.col("last")), F.lit(False))).select("seq", F.lit("a part starts outside").alias("problem"))
    moves = moved.join(outside.select("seq"), "seq", "left_anti")
    to = moves.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct(F.substring_index("target", "/", -1).alias("part"), "to"))).alias("to"))
    final = listed.join(to, "piece", "left").select("piece", F.transform("list", lambda p: F.struct(p["part"].alias("part"), F.coalesce(F.element_at("to", p["part"]), p["at"]).alias("at"))).alias("list"))
    disorder = order_problems(final, moves.select("seq", "piece"))
    problems = _cut(reduce(DataFrame.unionByName, [unknown, *(df.filter("problem IS NOT NULL").select("seq", "problem") for df in (told, told_lists, judged)), outside, disorder]).distinct())
    if not problems.isEmpty():
        return problems, owner, lists, fields, resolved(links, owner, lists)
    return problems, layer, final, put_values(fields, judged.filter("field <> 'start'")), resolved(links, layer, final)


def resolved(links: DataFrame, owner: DataFrame, lists: DataFrame) -> DataFrame:
    """links with volume and system of their targets."""
    volumes = owner.filter("piece IS NOT NULL").select("piece", "volume").distinct()
    at = lists.select("piece", F.explode("list").alias("p")).join(volumes, "piece").select(F.concat("piece", F.lit("/"), "p.part").alias("target"), "volume", F.col("p.at").alias("system"))
    return links.select("borrower", "target").join(at, "target", "left").select("borrower", "target", "volume", "system")
