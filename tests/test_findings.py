"""Results that a review found wrong, and steps that it found to grow faster than their input."""

import pytest

from quillspark.llm import url_filter
from quillspark.operators import vocabulary
from quillspark.plans import registry

from .compare import SF, duck, rows


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables and gives their folder."""

    def put(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def agrees(spark, name, folder):
    got, want = registry.queries()[name](spark, folder).toPandas(), duck(registry.oracles()[name], folder)
    assert len(got) and rows(got) == rows(want)
    return got


def test_url_rules_are_those_of_the_contract(spark):
    """Each rule's word, spelled out here, on urls that only it decides."""
    want = {"https://x.com/en/": ("com/en/", "block"), "https://www.example.com/en/7": ("example.com/en/7", "allow"), "https://x.net/de/1": ("net/de/", "allow"), "https://example.net/de/8": ("example.net/de/8", "block"), "https://example.net/de/9": ("net/de/", "allow"), "https://a.org/es/": ("org/es/", "block"), "https://a.org/en/": (None, "allow")}
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(want)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == list(want.values())


def test_keys_longer_than_their_places(spark, tables):
    orders = spark.createDataFrame([(1, 2), (123456, 99999), (1234567, 100001), (-3, -4), (None, 5), (6, None)], "o_orderkey long, o_custkey long")
    agrees(spark, "format_key", tables(orders=orders))


def test_scores_below_the_threshold_are_told(spark):
    got = agrees(spark, "udf_surface", SF)
    low = got[got["n_nationkey"].isna()]
    assert len(low) and low["score"].notna().all()
    strings = lambda *s: spark.createDataFrame([(x,) for x in s], "s string")
    pairs = vocabulary.called_pairs(strings("a", "b"), strings("ab", "xa", "cccc"), lambda a, b: float(a in b) / len(b))
    assert {tuple(r) for r in pairs.collect()} == {("a", "ab", 0.5), ("a", "xa", 0.5), ("b", "ab", 0.5)}


def test_nearest_on_odd_tables(spark, tables):
    """Ties, equal values, nations without suppliers, and balances that are null on either side."""
    customer = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 1, -1.0), (4, 1, 9.0), (5, 2, 1.0), (6, 1, None), (7, 3, 1.0), (8, 3, None), (9, 1, 6.5)], "c_custkey long, c_nationkey int, c_acctbal double")
    supplier = spark.createDataFrame([(9, 1, 5.0), (3, 1, 8.0), (4, 1, 8.0), (2, 1, None), (8, 3, None), (7, 3, None), (1, 4, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    agrees(spark, "nearest_join", tables(customer=customer, supplier=supplier))


def test_nearest_looks_at_each_row_once(spark, tables, capfd):
    """No window runs to the end of its group from every row: that is quadratic."""
    customer = spark.createDataFrame([(1, 1, 5.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    supplier = spark.createDataFrame([(9, 1, 5.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    plan = registry.queries()["nearest_join"](spark, tables(customer=customer, supplier=supplier))._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan.replace(" ", "").lower().replace(",", ", ")


def test_reach_sends_few_nodes_to_the_edges(spark, monkeypatch):
    """Levels, known nodes in many parts, and levels too large for every task."""
    from quillspark.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i, i * 2) for i in range(60)] + [(5, 5), (700, 701)], "src long, dst long")
    start = spark.createDataFrame([(0,), (7,)], "node long")
    hop, level = {0: 0, 7: 0}, [0, 7]
    while level:
        level = [x for s in level if s < 60 for x in (s + 1, s * 2) if hop.setdefault(x, hop[s] + 1) == hop[s] + 1]
    for most, parts in ((100_000, 16), (0, 1), (2, 2)):
        monkeypatch.setattr(graph, "MOST_BROADCAST", most)
        monkeypatch.setattr(graph, "MOST_PARTS", parts)
        assert {(r["node"], r["hop"]) for r in graph.reach(edges, start).collect()} == set(hop.items())
    assert {(r["node"], r["hop"]) for r in graph.reach(edges, start, hops=3).collect()} == {(n, h) for n, h in hop.items() if h <= 3}


def test_parts_of_hot_and_missing_lenders(spark, monkeypatch):
    from quillspark.operators import binding

    data = [(k, t, f"{k}.{t}", [None, 1, 2, -5][(k * t) % 4]) for k in range(1, 30) for t in range(1, 5)]
    parts = spark.createDataFrame(data, "k long, at long, value string, lender long")
    slices = parts.filter("lender is null").select("k", "at", "value")
    run = lambda: sorted(map(tuple, binding.with_borrowed(parts, slices, "k", ["at"], "lender").collect()))
    plain = run()
    monkeypatch.setattr(binding, "HOT", 3)
    assert run() == plain and len({r[3] for r in plain}) == 3


def test_gcd_of_long_numbers(spark):
    import math

    from pyspark.sql import functions as F

    from quillspark.functions import rationals

    fib = [1, 1]
    while fib[-1] < 1 << 61:
        fib.append(fib[-1] + fib[-2])
    pairs = list(zip(fib, fib[1:], strict=False)) + list(zip(fib[1:], fib, strict=False)) + [(0, 0), (0, 7), (7, 0), (-12, 18), (12, -18), (10**18, 6 * 10**17), (99, 100), (6, 4), (4, 6)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", rationals.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r["g"] == math.gcd(r["a"], r["b"]) for r in got) and len(got) == len(pairs)


def test_inheritance_stops_where_a_parent_is_missing(spark, tables):
    part = spark.createDataFrame([(1, 3, "A"), (2, 4, "B"), (4, 4, "C"), (9, 3, "D"), (19, 1, "E"), (20, 1, "F"), (40, 1, "G"), (0, 1, "H"), (None, 1, "I"), (-4, 1, "J")], "p_partkey long, p_size int, p_brand string")
    agrees(spark, "inherit_chain", tables(part=part))


def test_tree_diff_of_repeated_and_null_keys(spark):
    from quillspark.operators import trees

    schema = "k long, doc string"
    a = spark.createDataFrame([(1, '{"a": 1}'), (1, '{"a": 2}'), (2, '{"a": 1, "b": [1]}'), (None, "1"), (3, "{bad"), (4, None)], schema)
    b = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"b": [1], "a": 1}'), (None, "1"), (3, "{bad"), (4, "5")], schema)
    got = sorted(map(str, map(tuple, trees.tree_diff(a, b, "k", "doc").collect())))
    assert got == sorted(map(str, [(1, "/a", "changed", "2", "1"), (None, "", "removed", "1", None), (None, "", "added", None, "1"), (4, "", "added", None, "5")]))


def test_bands_are_counted_by_height(spark):
    """Words across columns, several of one height, against a running count of a whole page; no window of words has the page alone as its group."""
    from pyspark.sql import functions as F

    from quillspark.operators import alignment

    words = [(p, x, x + (60 if (x * y + (p or 0)) % 5 == 0 else 8), y, y + 1, f"w{(x * 7 + y) % 13}") for p in (1, 2, None) for y in (0, 1, 1, 4, 5, 9) for x in (3, 30, 55, 70)]
    d = spark.createDataFrame([(p, *map(float, r[:4]), r[4]) for p, *r in words], "page long, x0 double, x1 double, y0 double, y1 double, text string")
    rows = alignment.table_rows(d, "page", 2, F.lit(100.0), 1.5, F.col("column") == -1)
    got = [(r["page"], r["row"], r["column"], r["section"], r["text"]) for r in rows.collect() if r["page"] is not None]
    want, section = [], None
    for page in (1, 2):
        column = lambda r: -1 if r[2] - r[1] > 50 else min(int((r[1] + r[2]) / 2 / 100 * 2), 1)
        band, cells = 0, {}
        for r in sorted((r for r in words if r[0] == page), key=lambda r: (r[3], column(r) != -1, r[1], r[5])):
            band += column(r) == -1
            cells.setdefault((band, column(r)), []).append(r)
        row = 0
        for (_, c), group in sorted(cells.items()):
            lines, last = [], None
            for r in sorted(group, key=lambda r: (r[3], r[1], r[5])):
                if last is None or r[3] - last > 1.5:
                    lines.append([])
                lines[-1].append(r)
                last = r[3]
            for line in lines:
                row += 1
                text = " ".join(r[5] for r in sorted(line, key=lambda r: (r[1], r[5])))
                if c == -1:
                    section = text
                else:
                    want.append((page, row, c, section, text))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_each_heading_is_matched_once(spark, tables):
    """Parts that share a heading share its entry; no row is lost, and headings are read for distinct ones only."""
    from pyspark.sql import functions as F

    from quillspark.sources.tables import load

    part = load(spark, SF, "part").limit(40)
    many = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 8000)).unionByName(part.limit(1).withColumn("p_name", F.lit(None).cast("string")).withColumn("p_partkey", F.lit(-8).cast("long")))
    q = registry.queries()["vocabulary_match"](spark, tables(part=many))
    got = {r["p_partkey"]: (r["key"], r["score"]) for r in q.collect()}
    assert len(got) == 81 and all(got[k] == got[k + 8000] for k in got if 0 <= k < 8000) and got[-8] == (None, None)
    assert "transform(" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_pages_row_by_row_are_those_by_pointers(spark, monkeypatch):
    import random

    from quillspark.operators import pages

    rnd = random.Random(5)
    data = [(k, i, rnd.choice([0.0, 3.5, 7.25, None, 11.0, 40.0]), rnd.random() < 0.1) for k in ["a", "b", None, *map(str, range(30))] for i in range(rnd.randint(1, 60))]
    d = spark.createDataFrame(data, "k string, i long, h double, f boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for how in ((40.0, 20.0, 1.5, 6, "f"), (25.0, None, 0.0, None, None), (40.0, 41.0, 0.5, 3, "f")):
            want = sorted(map(str, map(tuple, pages._by_pointers(d, "k", ["i"], "h", *how).collect())))
            for held in (10_000, 20):
                monkeypatch.setattr(pages, "MOST_HELD", held)
                assert sorted(map(str, map(tuple, pages.paginate(d, "k", ["i"], "h", *how).collect()))) == want
        low = d.withColumn("h", registry.stateful.F.when(registry.stateful.F.col("i") == 3, -4.0).otherwise(registry.stateful.F.col("h")))
        assert sorted(map(str, map(tuple, pages.paginate(low, "k", ["i"], "h", *how).collect()))) == sorted(map(str, map(tuple, pages._by_pointers(low, "k", ["i"], "h", *how).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("held", [50_000, 12, 0])
def test_runs_by_volume_are_those_by_rounds(spark, monkeypatch, held):
    import random

    from quillspark.operators import layers

    rnd = random.Random(9)
    owner, entries = [], []
    for v in ("x", "y", "z", None):
        at = 0
        for piece in (f"{v}{k}" for k in range(4)):
            n = rnd.randint(1, 4)
            owner += [(v, at + i + 1, piece) for i in range(n)]
            entries += [(len(entries) * 10, v, piece, at + 1 + rnd.choice([-1, 0, 0, 1]), at + n + rnd.choice([0, 1, 1]), at + 1, at + n)]
            at += n
        owner.append((v, at + 1, None))
    entries += [(1, "no", "p", 1, 1, 1, 1), (2, "x", None, 1, 2, None, None), (3, "x", "new", at, at, None, None), (4, "y", "y1", 1, None, 1, 1)]
    o = spark.createDataFrame(owner, "volume string, system long, piece string")
    e = spark.createDataFrame(entries, "seq long, volume string, target string, a long, b long, was_a long, was_b long")
    parts = o.filter("system = 3 or system = 3").select("volume", "system")
    want = [sorted(map(str, map(tuple, df.collect()))) for df in layers._by_rounds(o, parts, e)]
    monkeypatch.setattr(layers, "MOST_HELD", held)
    assert [sorted(map(str, map(tuple, df.collect()))) for df in layers.apply_runs(o, parts, e)] == want


def test_f15_measures_need_no_common_denominator(spark):
    """The places of brute force, also where a part's denominators have no common multiple in 64 bits, and where the part is null; no join, so each side is shuffled once."""
    import random
    from fractions import Fraction

    from quillspark.operators import eventlog

    rnd = random.Random(15)
    big = [(1 << 61) - 1, (1 << 31) - 1, 1 << 31, (1 << 31) + 11, 3, 1, 840]
    fractions = [Fraction(rnd.randint(-3 * d, 3 * d), d) for d in big for _ in range(12)]
    fractions += [Fraction(1, (1 << 61) - 1), Fraction(1, (1 << 61) - 2), Fraction(-1, (1 << 61) - 1), Fraction((1 << 61) - 2, (1 << 61) - 1), Fraction(0), Fraction(1)]
    lines = sorted({Fraction(k) for k in range(-2, 3)})
    kind = "struct<num: bigint, den: bigint>"
    given = lambda f: (f.numerator, f.denominator)
    e = spark.createDataFrame([(v, i, given(f)) for v in ("v", None) for i, f in enumerate(fractions)] + [("v", -1, None), ("alone", 0, (1, 2))], f"voice string, i int, onset {kind}")
    m = spark.createDataFrame([(v, n, given(f)) for v in ("v", None) for n, f in enumerate(lines)], f"voice string, n int, line {kind}")
    placed = eventlog.in_measures(e, ["voice"], m, "onset", "line", "n")
    got = {(r["voice"], r["i"]): (r["n"], r["place"] and Fraction(*r["place"])) for r in placed.collect()}
    want = {("v", -1): (None, None), ("alone", 0): (None, None)}
    for i, f in enumerate(fractions):
        n = max((k for k, x in enumerate(lines) if x <= f), default=None)
        want |= {(v, i): (n, None if n is None else f - lines[n]) for v in ("v", None)}
    assert got == want
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    # lines that are no whole numbers, the order of near ones
    near = [Fraction(k, d) for d in ((1 << 62) - 1, (1 << 62) - 3, (1 << 31) - 1, 7) for k in (1, 2, d // 2, d - 1)]
    from quillspark.functions import rationals

    rows = spark.createDataFrame([(i, given(f)) for i, f in enumerate(near)], f"i int, f {kind}")
    order = [r["i"] for r in rows.orderBy(*rationals.ranks(rows["f"])).collect()]
    assert order == sorted(range(len(near)), key=lambda i: near[i])
    pairs = spark.createDataFrame([((5, 6), (1, 4)), ((1, 3), (5, 6)), ((1, 2), (1, 2)), (None, (1, 1)), ((1, 2), None), ((2, 1), (1, 3))], f"a {kind}, b {kind}")
    assert [r["d"] and tuple(r["d"]) for r in pairs.select(rationals.minus(pairs["a"], pairs["b"]).alias("d")).collect()] == [(7, 12), (-1, 2), (0, 1), None, None, (5, 3)]


def test_f15_small_denominators_take_no_steps(spark, monkeypatch):
    """Fractions of brute force on both sides of the table's bound; within it, Euclid's algorithm is never asked."""
    import math
    from fractions import Fraction

    from pyspark.sql import functions as F

    from quillspark.functions import rationals

    nums = [None, 0, 1, -1, 6, -6, 12, 35, -840, 30030, (1 << 62) + 2, -(1 << 62)]
    d = spark.createDataFrame([(n, k) for n in nums for k in [*range(-35, 36), 840, 30030, None]], "n long, d long")
    want = {(n, k): None if n is None or not k else Fraction(n, k) for n, k in map(tuple, d.collect())}
    got = d.select("n", "d", rationals.fraction(F.col("n"), F.col("d")).alias("f")).collect()
    assert {(r["n"], r["d"]): r["f"] and Fraction(*r["f"]) for r in got} == want
    assert all(r["f"] is None or tuple(r["f"]) == want[r["n"], r["d"]].as_integer_ratio() for r in got)
    whole = d.filter("n is not null and d is not null")
    assert all(r["g"] == math.gcd(r["n"], r["d"]) for r in whole.select("n", "d", rationals.gcd(F.col("n"), F.col("d")).alias("g")).collect())
    monkeypatch.setattr(F, "aggregate", lambda *_: F.raise_error(F.lit("a step was taken")).cast("long"))
    few = d.filter("d between 0 and 31").select("n", "d", rationals.fraction(F.col("n"), F.col("d")).alias("f")).collect()
    assert len(few) == 32 * len(nums) and all((r["f"] and Fraction(*r["f"])) == want[r["n"], r["d"]] for r in few)


def test_f15_places_by_lines_that_are_no_whole_numbers(spark):
    """Places by lines that are no whole numbers, of denominators on both sides of the table's bound, are those of brute force, reduced."""
    import random
    from fractions import Fraction

    from quillspark.operators import eventlog

    rnd = random.Random(16)
    given = lambda f: (f.numerator, f.denominator)
    onsets = [Fraction(rnd.randint(-90, 400), rnd.choice([1, 2, 3, 7, 31, 32, 33, 840])) for _ in range(150)]
    lines = sorted({Fraction(rnd.randint(0, 300), rnd.choice([1, 4, 5, 64])) for _ in range(12)})
    kind = "struct<num: bigint, den: bigint>"
    e = spark.createDataFrame([("v", given(f), i) for i, f in enumerate(onsets)], f"voice string, onset {kind}, i int")
    m = spark.createDataFrame([("v", n, given(f)) for n, f in enumerate(lines)], f"voice string, n int, line {kind}")
    placed = eventlog.in_measures(e, ["voice"], m, "onset", "line", "n")
    assert placed.columns == ["voice", "onset", "i", "n", "place"]
    got = {r["i"]: (Fraction(*r["onset"]), r["n"], r["place"] and tuple(r["place"])) for r in placed.collect()}
    last = {i: max((k for k, x in enumerate(lines) if x <= f), default=None) for i, f in enumerate(onsets)}
    assert got == {i: (f, last[i], None if last[i] is None else given(f - lines[last[i]])) for i, f in enumerate(onsets)}
