"""Layered corrections against going through the file line by line, and the golden cases of each layer."""

import random

import pytest

from quillspark.operators import layers as ly


def one_by_one(owner, parts, entries):
    """owner: {volume: [piece or None, ...]}; parts: {(volume, system)}; entries in file order. The owners afterwards, and each problem."""
    owner, told = {v: list(o) for v, o in owner.items()}, {}
    for seq, v, t, a, b, was in entries:
        o = owner.get(v)
        if o is None or a is None or b is None or not 1 <= a <= b <= len(o):
            told[seq] = ly.NO_RUN
            continue
        own = [i + 1 for i, p in enumerate(o) if p == t]
        now = (own[0], own[-1]) if own else (None, None)
        runs = {p: [i + 1 for i, q in enumerate(o) if q == p] for p in set(o) - {None, t}}
        lost = {p: [s for s in r if a <= s <= b] for p, r in runs.items()}
        lost = {p: x for p, x in lost.items() if x}
        if was != now:
            told[seq] = ly.STALE
        elif any((v, s) in parts and not a <= s <= b for s in own):
            told[seq] = ly.LEAVES
        elif any(len(x) == len(runs[p]) for p, x in lost.items()):
            told[seq] = ly.WHOLE
        elif any(x[0] != runs[p][0] and x[-1] != runs[p][-1] for p, x in lost.items()):
            told[seq] = ly.SPLITS
        elif any((v, s) in parts for x in lost.values() for s in x):
            told[seq] = ly.TAKES
        else:
            told[seq] = None
            owner[v] = [t if a <= i + 1 <= b else None if p == t else p for i, p in enumerate(o)]
    return owner, told


RUNS = "seq long, volume string, target string, a long, b long, was_a long, was_b long"


def frames(spark, owner, parts, entries):
    o = spark.createDataFrame([(v, i + 1, p) for v, ps in owner.items() for i, p in enumerate(ps)], "volume string, system long, piece string")
    return o, spark.createDataFrame(list(parts), "volume string, system long"), spark.createDataFrame([(s, v, t, a, b, *was) for s, v, t, a, b, was in entries], RUNS)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_those_of_the_file_line_by_line(spark, seed):
    rnd = random.Random(seed)
    owner, parts, entries = {}, set(), []
    for v in "xyz":
        pieces = [f"{v}{k}" for k in range(5)]
        owner[v] = [p for p in pieces for _ in range(rnd.randint(1, 5))] + [None]
        parts |= {(v, i + 1) for i, p in enumerate(owner[v]) if i and owner[v][i - 1] == p and rnd.random() < 0.15}
    now = owner
    for seq in range(40):
        v = rnd.choice("xyz")
        t = rnd.choice(now[v]) or f"{v}0"
        own = [i + 1 for i, p in enumerate(now[v]) if p == t] or [1]
        a, b = own[0] + rnd.choice([-2, -1, 0, 0, 1]), own[-1] + rnd.choice([-1, 0, 0, 1, 2, 5])
        entries.append((seq, v, t, a, b, (own[0], own[-1]) if rnd.random() < 0.85 else (1, 1)))
        if rnd.random() < 0.7:  # the writer sees what the corrections before have done, or not
            now = one_by_one(owner, parts, entries)[0]
    entries += [(99, "nowhere", "x1", 1, 2, (1, 2)), (100, "x", "x1", None, 2, (1, 2)), (101, "x", "stranger", 1, 1, (None, None))]
    want_owner, want = one_by_one(owner, parts, entries)
    after, told = ly.apply_runs(*frames(spark, owner, parts, entries))
    assert {r["seq"]: r["problem"] for r in told.collect()} == want and len(set(want.values())) >= 4
    assert {(r["volume"], r["system"]): r["piece"] for r in after.collect()} == {(v, i + 1): p for v, o in want_owner.items() for i, p in enumerate(o)}


BASE = {"vol": ["a", "a", "a", "b", "b", "b", "c", "c"]}


def base(spark):
    owner, _, _ = frames(spark, BASE, set(), [])
    lists = spark.createDataFrame([("a", [("introit", 1), ("gradual", 2)]), ("b", [("introit", 4), ("gradual", 5)]), ("c", [("introit", 7)])], f"piece string, list {ly.LIST}")
    fields = spark.createDataFrame([("a", "title", "Advent"), ("a", "mode", None), ("b", "title", "Lent"), ("c", "title", "Easter")], "target string, field string, value string")
    links = spark.createDataFrame([("z", "b/gradual"), ("y", "c/introit"), ("x", "q/introit")], "borrower string, target string")
    return owner, lists, fields, links


def apply(spark, runs=(), lists=(), values=(), given=None):
    r = spark.createDataFrame([(s, t, a, b, *was) for s, t, a, b, was in runs], RUNS.replace("volume string, ", ""))
    w = spark.createDataFrame(list(lists), f"seq long, target string, was {ly.LIST}, value {ly.LIST}")
    v = spark.createDataFrame(list(values), "seq long, id string, target string, field string, was string, value string")
    problems, owner, out, fields, links = ly.apply_layers(*(given or base(spark)), r, w, v)
    told = sorted((p["seq"], p["problem"]) for p in problems.collect())
    by = {(o["volume"], o["system"]): o["piece"] for o in owner.collect()}
    return told, "".join(by["vol", i + 1] or "-" for i in range(8)), {x["piece"]: [tuple(p) for p in x["list"]] for x in out.collect()}, {(f["target"], f["field"]): f["value"] for f in fields.collect()}, {x["borrower"]: (x["volume"], x["system"]) for x in links.collect()}


def test_layers_each_count_from_the_one_before(spark):
    """A boundary moves twice, a list is replaced on the system gained, then one of its parts moves; the borrower follows."""
    told, owner, lists, fields, links = apply(
        spark,
        runs=[(1, "b", 3, 6, (4, 6)), (2, "a", 1, 2, (1, 2))],
        lists=[(3, "b", [("introit", 4), ("gradual", 5)], [("introit", 3), ("gradual", 5)])],
        values=[(4, "e4", "b/gradual", "start", "5", "6"), (5, "e5", "a", "title", "Advent", "Advent I"), (6, "e6", "a", "mode", None, "VIII")],
    )
    assert told == [] and owner == "aabbbbcc" and lists["b"] == [("introit", 3), ("gradual", 6)]
    assert fields == {("a", "title"): "Advent I", ("a", "mode"): "VIII", ("b", "title"): "Lent", ("c", "title"): "Easter"}
    assert links == {"z": ("vol", 6), "y": ("vol", 7), "x": (None, None)}


def test_all_problems_are_told_and_nothing_is_applied(spark):
    told, owner, lists, fields, links = apply(
        spark,
        runs=[(1, "a", 1, 4, (1, 3)), (2, "b", 4, 8, (4, 6)), (3, "c", 5, 8, (7, 8)), (4, "a", 3, 3, (1, 3)), (5, "a", 1, 2, (1, 2)), (6, "q", 1, 2, (1, 2)), (7, "b", 9, 12, (4, 6))],
        lists=[(8, "a", [], [("introit", 1)]), (9, "c", [("introit", 7)], [("introit", 8), ("gradual", 8)]), (10, "c", [("introit", 7)], [("introit", 2)]), (11, "q", [], [])],
        values=[(12, "e12", "a", "title", "Lent", "x"), (13, "e13", "a", "title", "Advent", "y"), (14, "e14", "a", "colour", None, "red"), (15, "e15", "b/gradual", "start", "5", "4"), (16, "e16", "c/introit", "start", "7", "1")],
    )
    assert told == [
        (1, ly.TAKES), (2, ly.WHOLE), (3, ly.TAKES), (4, ly.LEAVES), (5, ly.STALE), (6, "unknown target"), (7, ly.NO_RUN),
        (8, ly.STALE), (9, "parts out of order"), (10, "a part starts outside"), (11, "unknown target"),
        (12, ly.STALE), (13, "corrected already by e12"), (14, "unknown target"), (15, "parts out of order"), (16, "a part starts outside"),
    ]
    assert owner == "aaabbbcc" and lists["b"] == [("introit", 4), ("gradual", 5)] and fields["a", "title"] == "Advent" and links["z"] == ("vol", 5)


def test_parts_move_past_each_other_and_chains_see_their_predecessors(spark):
    """Two parts that change places are judged on the result; a stale link in a chain of lists stops what counts on it only."""
    told, _, lists, _, _ = apply(spark, values=[(1, "e1", "b/introit", "start", "4", "5"), (2, "e2", "b/gradual", "start", "5", "6")])
    assert told == [] and lists["b"] == [("introit", 5), ("gradual", 6)]
    first, second = [("introit", 1)], [("introit", 1), ("gradual", 3)]
    told, *_ = apply(spark, lists=[(1, "a", [("introit", 1), ("gradual", 2)], first), (2, "a", first, second), (3, "a", first, [])])
    assert told == [(3, ly.STALE)]
    told, *_ = apply(spark)
    assert told == []


def test_splitting_a_neighbour_is_refused(spark):
    owner, parts, entries = frames(spark, {"v": ["a", "b", "b", "b", "c"]}, set(), [(1, "v", "a", 3, 3, (1, 1)), (2, "v", "c", 4, 5, (5, 5)), (3, "v", "b", 2, 4, (2, 3))])
    after, told = ly.apply_runs(owner, parts, entries)
    assert {r["seq"]: r["problem"] for r in told.collect()} == {1: ly.SPLITS, 2: None, 3: None}
    assert [r["piece"] for r in after.orderBy("system").collect()] == ["a", "b", "b", "b", "c"]
