"""Order-dependent folds against plain Python."""

import random

from pyspark.sql import functions as F

from quillspark.operators import graph, overlay, state


def test_rate_limit(spark):
    rnd = random.Random(1)
    rows = [(u, i, rnd.randrange(200)) for u in range(5) for i in range(u * 100, u * 100 + 30)]
    got = {r["i"]: r["accepted"] for r in state.rate_limit(spark.createDataFrame(rows, "u long, i long, t long"), "u", "t", "i", 3, 20).collect()}
    for u in range(5):
        landed = []
        for _, i, t in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            ok = sum(x >= t - 20 for x in landed) < 3
            assert got[i] == ok
            if ok:
                landed.append(t)


def test_monotone_fit(spark):
    rows = [("a", 1, 10, 1.0), ("a", 1, 30, 5.0), ("a", 2, 20, 4.0), ("a", 2, 40, 3.0), ("a", 3, 40, 2.0)]
    got = state.monotone_fit(spark.createDataFrame(rows, "k string, e long, p long, s double"), "k", "e", "p", "s").collect()
    assert sorted((r["e"], r["p"]) for r in got) == [(1, 30), (2, 40)]


def test_reach_with_cycle_and_no_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["hop"]) for r in graph.reach(e, start).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graph.reach(e.limit(0), start).count() == 1


def test_overlay_nulls(spark):
    base = spark.createDataFrame([(1, None), (2, "a")], "k long, v string")
    over = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "k long, was string, value string")
    got = {r["k"]: (r["v"], r["state"]) for r in overlay.apply_overlay(base, over, "k", "v").collect()}
    assert got == {1: ("x", "applied"), 2: ("a", "stale")}


def test_roman(spark):
    from quillspark.functions.text import roman_value, to_roman

    d = spark.range(1, 4000).withColumn("r", to_roman(F.col("id"))).withColumn("n", roman_value(F.col("r")))
    assert d.filter("n <> id").count() == 0 and d.filter("id = 1994").first()["r"] == "MCMXCIV"
