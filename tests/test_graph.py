"""Chains, spliced sections, components and build orders against plain Python, on deep, repeated and cyclic graphs."""

import random

import pytest

from quillspark.operators import graph


def test_chains_of_any_length_and_loops(spark):
    rnd = random.Random(1)
    links = {i: i + 1 for i in range(300)} | {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {2000: 1003, 2001: 2000, 5: 6, 77: 78, 3000: 3000}
    links |= {4000 + i: 4000 + rnd.randrange(60) for i in range(0, 60, 2)}

    def walk(n):
        at, k = links[n], 1
        while at in links and k <= len(links):
            at, k = links[at], k + 1
        return (None, None, "loop") if at in links else (at, k, "end")

    df = spark.createDataFrame(list(links.items()), "src long, dst long")
    got = {r["node"]: (r["end"], r["n"], r["state"]) for r in graph.chains(df).collect()}
    assert got == {n: walk(n) for n in links} and got[0] == (300, 300, "end") and got[2001][2] == "loop"
    assert graph.chains(df.limit(0)).count() == 0


def spliced(lines):
    """section: its lines spliced, or the problem."""
    by = {}
    for s, n, text, target in sorted(lines, key=lambda r: (r[0], r[1])):
        by.setdefault(s, []).append((n, text, target))

    def reached(s, seen):
        for _, _, t in by.get(s, ()):
            if t is not None and t not in seen:
                seen.add(t)
                reached(t, seen)
        return seen

    def problem(s):
        r = reached(s, set())
        return "loop" if any(t in reached(t, set()) for t in r) else "missing" if any(t not in by for t in r) else None

    def out(s):
        return [x for n, text, t in by[s] for x in ([(s, n, text)] if t is None else out(t))]

    return {s: problem(s) or out(s) for s in by}


@pytest.mark.parametrize("seed", [1, 2])
def test_sections_spliced_in_printed_order(spark, seed):
    rnd = random.Random(seed)
    lines = [(f"deep{i}", n, f"d{i}.{n}", f"deep{i + 1}" if n == 1 and i < 40 else None) for i in range(41) for n in range(3)]
    lines += [(s, n, f"{s}{n}", rnd.choice([None, None, rnd.choice("abcdefgh"), "nowhere" if rnd.random() < 0.1 else None])) for s in "abcdefgh" for n in range(4)]
    lines += [(f"t{i}", n, f"t{i}.{n}", None if i == 0 else f"t{i - 1}" if n < 2 else None) for i in range(6) for n in range(3)]  # repeated includes
    lines += [("self", 0, None, "self"), ("x", 0, "x", None), ("x", 1, None, "y"), ("y", 0, None, "x"), ("to", 0, "t", "x"), ("gone", 5, "g", "nowhere")]
    want = spliced(lines)
    body, problems = graph.expand(spark.createDataFrame(lines, "section string, n long, text string, target string"))
    got = {}
    for r in sorted(body.collect(), key=lambda r: (r["section"], r["place"])):
        assert r["place"] == len(got.setdefault(r["section"], []))
        got[r["section"]].append((r["source"], r["n"], r["text"]))
    got |= {r["section"]: r["problem"] for r in problems.collect()}
    assert got == want and want["to"] == "loop" and want["gone"] == "missing" and len(want["deep0"]) == 83 and len(want["t5"]) == 32 * 3 + 31


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_build_order(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(20)} | {(200, 201), (201, 202), (202, 200), (202, 100), (300, 300)}
    nodes = {x for e in edges for x in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}

    def reached(n):
        seen, stack = set(), [n]
        while stack:
            for m in to[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        return seen

    r = {n: reached(n) for n in nodes}
    part = {n: min([n, *(m for m in r[n] if n in r[m])]) for n in nodes}
    layer = dict.fromkeys(set(part.values()), 0)
    for _ in nodes:
        for a, b in edges:
            if part[a] != part[b]:
                layer[part[b]] = max(layer[part[b]], layer[part[a]] + 1)
    got = {x["node"]: (x["component"], x["layer"]) for x in graph.build_order(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
    assert got == {n: (part[n], layer[part[n]]) for n in nodes} and got[120][1] >= 21


def test_reach_over_many_rounds(spark):
    """Longer than the tables that are read together, with a hub and a cycle."""
    edges = [(i, i + 1) for i in range(200)] + [(5, 900 + i) for i in range(50)] + [(200, 0), (930, 150)]
    df, start = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (0,)], "node long")
    hop, level = {0: 0}, [0]
    while level:
        level = [b for a, b in edges if a in level and b not in hop and not hop.update({b: hop[a] + 1})]
    assert {r["node"]: r["hop"] for r in graph.reach(df, start).collect()} == hop
    assert {r["node"]: r["hop"] for r in graph.reach(df, start, hops=20).collect()} == {n: h for n, h in hop.items() if h <= 20}
