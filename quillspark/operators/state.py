"""Order-dependent rules: rate limits by landed rows, leases, status moves, greedy fills, automata, placements, monotone fits.

A fold reads the rows of its keys in order, as Arrow batches of partitions that are dealt out by key and sorted, and carries a small state from row to row and
batch to batch: no group is gathered anywhere, and a hot key costs its task time, not memory. A null key is a key of its own. Rules with few states (status moves, automata) are
parallel scans instead, where a hot key has many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graph import _cut



def same(a: object, b: object) -> bool:
    """Whether two keys are one: nulls are, and so are NaNs."""
    return a is b or a == b or (a != a and b != b)


#: What a fold says of a row, or of a key at its end.
Step = Callable[[object, tuple], tuple[object, object]]


def in_order(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """df dealt out by key, and sorted by key and order within partitions."""
    return df.select(*columns).repartition(key).sortWithinPartitions(key, *order)


def fold_rows(df: DataFrame, key: str, order: list[str], inputs: list[str], keep: list[str], out: str, kind: str, new: Callable[[], object], step: Step) -> DataFrame:
    """The columns `keep` of each row, and `out`: step(state, inputs) gives the next state and the row's value; new() is the state that a key begins with."""
    columns = list(dict.fromkeys([key, *order, *inputs, *keep]))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out}` {kind}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        last, state = object(), None
        for batch in batches:
            values = []
            for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if not same(k, last):
                    last, state = k, new()
                state, value = step(state, tuple(row))
                values.append(value)
            made = pa.array(values, arrow.field(out).type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, out])

    return in_order(df, key, order, columns).mapInArrow(run, schema)


def fold_keys(df: DataFrame, key: str, order: list[str], inputs: list[str], outs: str, new: Callable[[], object], step: Callable[[object, tuple], object], end: Callable[[object], list[tuple]]) -> DataFrame:
    """For each key the rows end(state) with the columns `outs`, after step has read the key's rows in order."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, {outs}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        none = object()
        last, state, rows = none, None, []

        def given():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if not same(k, last):
                    if last is not none:
                        rows += [(last, *r) for r in end(state)]
                    last, state = k, new()
                state = step(state, tuple(row))
            if len(rows) > 10_000:
                yield given()
        if last is not none:
            rows += [(last, *r) for r in end(state)]
        if rows:
            yield given()

    return in_order(df, key, order, list(dict.fromkeys([key, *order, *inputs]))).mapInArrow(run, schema)


def rate_limit(df: DataFrame, key: str, at: str, tie: str, most: int, seconds: int) -> DataFrame:
    """accepted: whether fewer than `most` accepted rows of the key lie in the `seconds` before; a refused row doesn't count. State: at most `most` times."""

    def step(landed: deque, row: tuple):
        (t,) = row
        while landed and landed[0] < t - seconds:
            landed.popleft()
        ok = len(landed) < most
        if ok:
            landed.append(t)
        return landed, ok

    return fold_rows(df, key, [at, tie], [at], [tie, key], "accepted", "boolean", deque, step)


def leases(df: DataFrame, key: str, at: str, tie: str, hold: int) -> DataFrame:
    """granted: whether no earlier granted lease of the key, `hold` seconds long, is open at the row's time."""

    def step(until: int | None, row: tuple):
        (t,) = row
        ok = until is None or t >= until
        return (t + hold if ok else until), ok

    return fold_rows(df, key, [at, tie], [at], [tie, key], "granted", "boolean", lambda: None, step)


def lease_decisions(df: DataFrame, key: str, at: str, tie: str, hold: int, most: int, window: int) -> DataFrame:
    """outcome of each row: granted, active (an earlier grant of the key, `hold` seconds long, is open) or rate (`most` grants lie less than `window` seconds back). State: the end of the
    lease and at most `most` times."""

    def step(state: tuple[int | None, deque], row: tuple):
        (t,), (until, grants) = row, state
        while grants and grants[0] <= t - window:
            grants.popleft()
        if until is not None and t < until:
            return state, "active"
        if len(grants) >= most:
            return state, "rate"
        grants.append(t)
        return (t + hold, grants), "granted"

    return fold_rows(df, key, [at, tie], [at], [tie, key], "outcome", "string", lambda: (None, deque()), step)


def status_moves(df: DataFrame, key: str, order: list[str], move: str, moves: dict[str, tuple[str, str]], first: str) -> DataFrame:
    """The last status of each key and how many moves landed: a move (name: expected, next) lands only from its expected status. A finite scan, so a hot key has many tasks."""
    scanned = finite_scan(df, key, order, move, {(expected, name): then for name, (expected, then) in moves.items()}, first)
    return scanned.groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("status"), F.count_if("landed").alias("landed"))


def greedy_fill(df: DataFrame, key: str, order: list[str], size: str, room: float) -> DataFrame:
    """page: rows fill a page in order until the next doesn't fit; a row larger than a page has one of its own."""

    def step(state: tuple[int, float], row: tuple):
        page, used = state
        if used and used + row[0] > room:
            page, used = page + 1, 0.0
        return (page, used + row[0]), page

    return fold_rows(df, key, order, [size], list(dict.fromkeys([key, *order, size])), "page", "long", lambda: (1, 0.0), step)


def automaton(df: DataFrame, key: str, order: list[str], symbol: str, table: dict[tuple[str, str], str], first: str) -> DataFrame:
    """state after each row, by a transition table; a pair that the table lacks stays. A finite scan, so a hot key has many tasks."""
    return finite_scan(df, key, order, symbol, table, first).select(*dict.fromkeys([key, *order, symbol]), "state")


def finite_scan(df: DataFrame, key: str, order: list[str], symbol: str, table: dict[tuple[str, str], str], first: str) -> DataFrame:
    """key, order and symbol of each row with state, after the row, and landed, whether the table (state, symbol: next) has a move for it. Every key begins in `first`.

    A parallel prefix scan: rows are dealt out by ranges of key and order, so a key may go over many partitions. What a key was before its partition began is not known there, so the rows of
    a partition's first key are followed from every state at once, until all of them have come to the same one. A partition tells what its first key becomes from each
    state, and what its last key is; these few rows, two a partition, are put together from the left, and then each row's state is looked up. Rows with equal keys and order may
    come in any order."""
    states = sorted({first, *(s for s, _ in table), *table.values()})
    columns = list(dict.fromkeys([key, *order, symbol]))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", _chunk int, _kind int, state string, landed boolean, _states array<string>, _landed array<boolean>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    at = columns.index(key)

    def run(batches):
        chunk, none = TaskContext.get().partitionId(), object()
        begun = last = none
        now, state = None, None  # the first key's states, by the state that it began in; None once they are one
        ends = None

        def told(kind, k, state, ends):
            row = {c: None for c in columns} | {key: k, "_chunk": chunk, "_kind": kind, "state": state, "landed": None, "_states": ends, "_landed": None}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            out = []
            for k, x in zip(batch.column(at).to_pylist(), batch.column(columns.index(symbol)).to_pylist(), strict=True):
                if begun is none:
                    begun, now = k, list(states)
                elif not same(k, last):
                    if ends is None:
                        ends = now or [state] * len(states)
                    now, state = None, first
                last = k
                if now:
                    landed = [(s, x) in table for s in now]
                    now = [table.get((s, x), s) for s in now]
                    if len(set(now)) == 1 and len(set(landed)) == 1:
                        now, state = None, now[0]
                        out.append((state, landed[0], None, None))
                    else:
                        out.append((None, None, now, landed))
                else:
                    landed = (state, x) in table
                    state = table.get((state, x), state)
                    out.append((state, landed, None, None))
            n = batch.num_rows
            made = [pa.array([r[i] for r in out], arrow.field(len(columns) + 2 + i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([chunk] * n, pa.int32()), pa.array([0] * n, pa.int32()), *made], schema=arrow)
        if begun is not none:
            whole = ends is None
            yield told(1, begun, None, (now or [state] * len(states)) if whole else ends)
            if not whole:
                yield told(2, last, state, None)

    dealt = df.select(*columns).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = _cut(dealt.mapInArrow(run, schema))
    starts, key_now, state_now = [], object(), None
    for r in rows.filter("_kind > 0").orderBy("_chunk", "_kind").collect():  # two rows a partition at most
        if r["_kind"] == 1:
            begin = state_now if same(r[key], key_now) else first
            starts.append((r["_chunk"], states.index(begin) + 1))
            key_now, state_now = r[key], r["_states"][states.index(begin)]
        else:
            key_now, state_now = r[key], r["state"]
    begins = F.broadcast(df.sparkSession.createDataFrame(starts, "_chunk int, _begin int"))  # a row a partition
    j = rows.filter("_kind = 0").join(begins, "_chunk")
    return j.select(*columns, F.coalesce("state", F.element_at("_states", F.col("_begin"))).alias("state"), F.coalesce("landed", F.element_at("_landed", F.col("_begin"))).alias("landed"))


def ordered_placement(df: DataFrame, key: str, order: list[str], score: dict[str, str], least: int) -> DataFrame:
    """Places named parts in order along the rows of a group: each goes to the first row, at least `least` after the one before, where its score column is highest
    among the rows left; a part without a score over 0 there has no place. Windows of one key only: one shuffle, whatever the number of parts."""
    whole = Window.partitionBy(key)
    rows = df.select(key, *order, *dict.fromkeys(score.values())).withColumn("_place", F.row_number().over(whole.orderBy(*order)).cast("long") - 1).withColumn("_at", F.lit(0).cast("long"))
    found = []
    for i, (name, column) in enumerate(score.items()):
        best = F.max(F.when(F.col("_place") >= F.col("_at"), F.struct(F.col(column).alias("score"), (-F.col("_place")).alias("back")))).over(whole)
        rows = rows.withColumn(f"_best{i}", best)
        place = F.when(F.col(f"_best{i}.score") > 0, -F.col(f"_best{i}.back"))
        rows = rows.withColumn("_at", F.coalesce(place + least, F.col("_at")))
        found.append(F.when(place.isNotNull(), F.struct(F.lit(name).alias("part"), place.alias("place"))))
    return rows.filter("_place = 0").select(key, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(key, "_f.*")


def monotone_fit(df: DataFrame, key: str, entry: str, page: str, score: str) -> DataFrame:
    """The best increasing assignment of entries to pages by dynamic programming over their scores; entries and pages may be skipped. Of equal totals the one
    found first, by entry and page, stays. A key's front of best totals by last page is kept in order, so a row costs a binary search; what is held is a link a row that improved it."""
    kinds = dict(df.dtypes)

    class Front:
        def __init__(self):
            self.pages, self.totals, self.links = [], [], []  # totals rise with pages
            self.entry, self.waiting = None, []

        def settle(self):
            """What the rows of one entry found takes effect when the entry is over, so that no entry is used twice."""
            for p, total, link in self.waiting:
                i = bisect_right(self.pages, p)
                if i and self.totals[i - 1] >= total:
                    continue
                i = bisect_left(self.pages, p)
                j = i
                while j < len(self.pages) and self.totals[j] <= total:
                    j += 1
                self.pages[i:j], self.totals[i:j], self.links[i:j] = [p], [total], [link]
            self.waiting = []

    def step(front: Front, row: tuple):
        e, p, s = row
        if s is None or p is None:
            return front
        if e != front.entry:
            front.settle()
            front.entry = e
        i = bisect_left(front.pages, p)
        total, link = (front.totals[i - 1], front.links[i - 1]) if i else (0.0, None)
        if s > 0:
            front.waiting.append((p, total + s, (e, p, link)))
        return front

    def end(front: Front) -> list[tuple]:
        front.settle()
        link, out = front.links[-1] if front.links else None, []
        while link:
            out.append(link[:2])
            link = link[2]
        return out[::-1]

    return fold_keys(df, key, [entry, page], [entry, page, score], f"`{entry}` {kinds[entry]}, `{page}` {kinds[page]}", Front, step, end)
