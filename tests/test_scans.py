"""Parallel scans and jump pointers against the row-by-row rules: one key over many partitions, many keys, nulls and NaNs."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import pages, state

TABLE = {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("b", "y"): "a", ("c", "r"): "a", ("a", "r"): "a", ("b", "r"): "a"}


@pytest.mark.parametrize("keys", [1, 3, 40])
def test_finite_scan_over_many_partitions(spark, keys):
    rnd = random.Random(keys)
    rows = [(float("nan") if keys == 3 and k == 1 else None if k == 2 else float(k), i, rnd.choice("xxxyz") if rnd.random() > 0.01 else "r") for k in range(keys) for i in range(600 // keys)]
    df = spark.createDataFrame(rows, "k double, i int, s string").repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for c, v in zip(before, ("9", "false", "20"), strict=True):
            spark.conf.set(c, v)
        got = {(str(r["k"]), r["i"]): (r["state"], r["landed"]) for r in state.finite_scan(df, "k", ["i"], "s", TABLE, "a").collect()}
        moves = {(str(r["k"]), r["status"], r["landed"]) for r in state.status_moves(df, "k", ["i"], "s", {"x": ("a", "b"), "y": ("b", "a"), "z": ("b", "c")}, "a").collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want, now, landed = {}, {}, {}
    step = {("a", "x"): "b", ("b", "y"): "a", ("b", "z"): "c"}
    last = {}
    for k, i, s in rows:
        was = now.get(str(k), "a")
        now[str(k)] = TABLE.get((was, s), was)
        want[str(k), i] = (now[str(k)], (was, s) in TABLE)
        w = last.get(str(k), "a")
        landed[str(k)] = landed.get(str(k), 0) + ((w, s) in step)
        last[str(k)] = step.get((w, s), w)
    assert got == want
    assert moves == {(k, last[k], landed[k]) for k in last}


def test_finite_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k long, i int, s string")
    assert state.finite_scan(df, "k", ["i"], "s", TABLE, "a").count() == 0 and state.automaton(df, "k", ["i"], "s", TABLE, "a").columns == ["k", "i", "s", "state"]


def filled(heights, room, first, gap, cap, forced):
    """The rule, row by row: pages, or the first row that is too tall."""
    out, page, used, n, limit = [], 1, 0, 0, first
    for i, h in enumerate(heights):
        if n and (cap is not None and n >= cap or used + gap + h > limit or forced[i]):
            page, used, n, limit = page + 1, 0, 0, room
        if n == 0 and h > limit:
            return None, i
        used, n = (h if n == 0 else used + gap + h), n + 1
        out.append(page)
    return out, None


@pytest.mark.parametrize("case", [(10.0, None, 0.0, None), (10.0, 4.0, 0.5, 3), (8.0, 20.0, 0.25, None)])
def test_pages_by_pointers(spark, case):
    room, first, gap, cap = case
    rnd = random.Random(int(room * 10 + gap * 100))
    groups = {k: [rnd.choice([0.0, 0.5, 1.25, 3.0, 4.0]) for _ in range(n)] for k, n in (("one", 1), ("many", 250), (None, 30), ("tall", 12), ("first", 3))}
    groups["tall"][7], groups["first"][0] = 11.0, 9.0
    forced = {k: [rnd.random() < 0.07 for _ in v] for k, v in groups.items()}
    rows = [(k, i, h if h or i % 2 else None, forced[k][i]) for k, v in groups.items() for i, h in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, i int, h double, f boolean")
    got = {}
    for r in pages.paginate(df, "k", ["i"], "h", room, first, gap, cap, "f").collect():
        got.setdefault(r["k"], {})[r["i"]] = (r["page"], r["too_tall"])
    for k, v in groups.items():
        want, tall = filled(v, room, room if first is None else first, gap, cap, forced[k])
        assert [got[k][i] for i in range(len(v))] == [((want or [None] * len(v))[i], tall) for i in range(len(v))], k
    assert pages.paginate(df.limit(0), "k", ["i"], "h", room).count() == 0
    plain = pages.paginate(df.filter("k = 'many'"), "k", ["i"], "h", room).agg(F.max("page")).first()[0]
    assert plain == filled(groups["many"], room, room, 0, None, [False] * 250)[0][-1]
