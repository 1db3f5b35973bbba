"""Catalogue operators on small tables with the odd cases: nulls, ties, damage, cycles and conflicts."""

from fractions import Fraction

from pyspark.sql import functions as F

from quillspark.functions import folding, notation, rationals
from quillspark.functions import similarity as sim
from quillspark.operators import alignment, eventlog, ledger, state, trees, vocabulary
from quillspark.sources import files


def test_folding(spark):
    d = spark.createDataFrame([("Quadragesimæ Œcumenical ﬁn É²",), (None,), ("",)], "h string")
    assert [r[0] for r in d.select(folding.fold_nfkd(F.col("h"))).collect()] == ["quadragesimae oecumenical fin e2", None, ""]
    words = lambda *h: [list(r[0]) if r[0] is not None else None for r in spark.createDataFrame([(x,) for x in h], "h string").select(folding.heading_words(F.lower("h"))).collect()]
    assert words("Kyrie Ill. in festis", "Feria tertia", "lilac1 a b", "et de", None) == [["festis", "iii", "kyrie"], ["feria", "iii"], ["lilac"], [], None]


def test_trees(spark):
    a = [(1, '{"a/b": [1, {"c~": null}], "e": {}, "t": "é"}'), (2, "[]"), (3, None), (4, "{broken"), (5, "3")]
    d = spark.createDataFrame(a, "k long, doc string")
    got = {(r["k"], r["pointer"]): r["value"] for r in trees.leaves(d, "k", "doc").collect()}
    assert got == {(1, "/a~1b/0"): "1", (1, "/a~1b/1/c~0"): "null", (1, "/e"): "{}", (1, "/t"): '"é"', (2, ""): "[]", (4, "!"): '"{broken"', (5, ""): "3"}
    deep = "[" * 400 + "]" * 400
    assert trees.leaves(spark.createDataFrame([(1, deep)], "k long, doc string"), "k", "doc").first()["pointer"] == "/0" * 399
    b = spark.createDataFrame([(1, '{"a/b": [2], "e": {}, "t": "é"}'), (6, '"x"')], "k long, doc string")
    diff = {(r["k"], r["pointer"]): (r["state"], r["was"], r["now"]) for r in trees.tree_diff(d, b, "k", "doc").collect()}
    assert diff == {(1, "/a~1b/0"): ("changed", "1", "2"), (1, "/a~1b/1/c~0"): ("removed", "null", None), (2, ""): ("removed", "[]", None), (4, "!"): ("removed", '"{broken"', None), (5, ""): ("removed", "3", None), (6, ""): ("added", None, '"x"')}


def test_rationals(spark):
    d = spark.createDataFrame([("3/8",), ("-2",), ("4/-2",), ("1/0",), ("0.5",), ("0",), (None,), ("123456789012345678/2",)], "c string").select("c", rationals.parsed(F.col("c")).alias("q"))
    got = {r["c"]: (r["q"]["num"], r["q"]["den"]) if r["q"] else None for r in d.collect()}
    assert got == {"3/8": (3, 8), "-2": (-2, 1), "4/-2": None, "1/0": None, "0.5": None, "0": (0, 1), None: None, "123456789012345678/2": (61728394506172839, 1)}
    s = spark.createDataFrame([(1, 3, 1, 6), (1, 2, -1, 2), (-3, 4, -1, 4)], "a long, b long, c long, d long")
    sums = s.select("*", rationals.written(rationals.plus(rationals.fraction(F.col("a"), F.col("b")), rationals.fraction(F.col("c"), F.col("d")))).alias("s")).collect()
    assert [Fraction(r["s"]) for r in sums] == [Fraction(r["a"], r["b"]) + Fraction(r["c"], r["d"]) for r in sums]


def test_ties_and_measures(spark):
    rows = [("v", 1, 60, "1/3", True), ("v", 2, 60, "1/6", True), ("v", 3, 60, "1/2", False), ("v", 4, 60, "1", True), ("v", 5, 62, "1", True)]
    notes = spark.createDataFrame(rows, "voice string, at long, pitch long, length string, tied boolean").withColumn("length", rationals.parsed(F.col("length")))
    got = eventlog.merge_ties(notes, ["voice"], ["at"], "pitch", "length", "tied").orderBy("first.at").collect()
    assert [(r["first"]["at"], r["pitch"], r["total"]["num"], r["total"]["den"], r["notes"], r["dangling"]) for r in got] == [(1, 60, 1, 1, 3, False), (4, 60, 1, 1, 1, True), (5, 62, 1, 1, 1, True)]
    e = spark.createDataFrame([("v", "x", "-1/7"), ("v", "y", "7/3"), ("v", "z", "4")], "voice string, name string, onset string").withColumn("onset", rationals.parsed(F.col("onset")))
    m = spark.createDataFrame([("v", 1, "0"), ("v", 2, "2"), ("v", 3, "4")], "voice string, n long, line string").withColumn("line", rationals.parsed(F.col("line")))
    got = {r["name"]: (r["n"], r["place"] and Fraction(r["place"]["num"], r["place"]["den"])) for r in eventlog.in_measures(e, ["voice"], m, "onset", "line", "n").collect()}
    assert got == {"x": (None, None), "y": (2, Fraction(1, 3)), "z": (3, Fraction(0))}


def test_ledger(spark):
    wanted = lambda *rows: spark.createDataFrame(rows, "kind string, seed string, place string")
    none = spark.createDataFrame([], ledger.SCHEMA)
    book, refused = ledger.allocate(none, wanted(("item", "a", "p1"), ("item", "b", "p2"), ("item", "b", "p2"), ("item", "c", "p3"), ("item", "c", "p4"), ("item", "d", "p5"), ("item", "e", "p5")))
    ids = {r["seed"]: r["id"] for r in book.collect()}
    assert set(ids) == {"a", "b"} and len(set(ids.values())) == 2
    assert {(r["seed"], r["refused"]) for r in refused.collect()} == {("c", "several places"), ("d", "place is wanted twice"), ("e", "place is wanted twice")}
    again, refused = ledger.allocate(book, wanted(("item", "a", "p1"), ("item", "f", "p2")))
    assert {r["seed"]: r["id"] for r in again.collect()} == ids and {(r["seed"], r["refused"]) for r in refused.collect()} == {("f", "place is taken")}
    moves = spark.createDataFrame([("item", "a", "p2", "swap"), ("item", "b", "p1", "swap"), ("item", "x", "p9", "r"), ("item", "y", "p9", " ")], "kind string, seed string, to string, reason string")
    moved, refused = ledger.rebind(book, moves)
    assert {r["seed"]: (r["place"], [tuple(h) for h in r["history"]]) for r in moved.collect()} == {"a": ("p2", [("place", "p1", "p2", "swap")]), "b": ("p1", [("place", "p2", "p1", "swap")])}
    assert {(r["seed"], r["refused"]) for r in refused.collect()} == {("x", "unknown"), ("y", "no reason")}
    kept, refused = ledger.rebind(book, moves.filter("seed = 'a'"))
    assert {r["seed"]: r["place"] for r in kept.collect()} == {"a": "p1", "b": "p2"} and refused.first()["refused"] == "place is taken"
    owners = spark.createDataFrame([(ids["b"], ids["a"])], "id string, owner string")
    gone = spark.createDataFrame([("item", "a", "old")], "kind string, seed string, reason string")
    done, refused = ledger.retire(book, gone, owners)
    assert {r["state"] for r in done.collect()} == {"active"} and refused.first()["refused"] == "owns active ids"
    done, refused = ledger.retire(book, gone)
    assert {r["seed"]: r["state"] for r in done.collect()} == {"a": "retired", "b": "active"} and refused.count() == 0
    back, refused = ledger.allocate(done, wanted(("item", "a", "p1")))
    assert refused.first()["refused"] == "retired" and back.count() == 2


def test_alignment(spark):
    expected = spark.createDataFrame([("k", 1, "A"), ("k", 2, "b"), ("k", 3, "A"), ("k", 4, "c"), ("k", 5, "b"), ("m", 1, None)], "key string, n long, text string")
    printed = spark.createDataFrame([("k", 10, "b"), ("k", 20, "a"), ("k", 30, "A"), ("k", 40, "b"), ("k", 50, "x")], "key string, place long, text string")
    got = {(r["key"], r["n"]): (r["place"], r["how"]) for r in alignment.align(expected, printed, "key", "n", "text", "place", [lambda c: c, F.lower]).collect()}
    assert got == {("k", 1): (30, "0"), ("k", 2): (40, "0"), ("k", 3): (30, "again"), ("k", 4): (None, "missing"), ("k", 5): (40, "again"), ("m", 1): (None, "missing")}


def test_page_rows(spark):
    words = [(1, 5, 95, 0, "KYRIALE"), (1, 10, 20, 10, "one"), (1, 22, 30, 10.5, "two"), (1, 60, 70, 10, "right"), (1, 10, 20, 14, "three"), (2, 10, 20, 5, "carried"), (2, 5, 95, 9, "CREDO"), (2, 60, 70, 12, "last")]
    d = spark.createDataFrame([(p, float(a), float(b), float(y), float(y) + 1, t) for p, a, b, y, t in words], "page long, x0 double, x1 double, y0 double, y1 double, text string")
    got = [(r["page"], r["column"], r["section"], r["text"]) for r in alignment.table_rows(d, "page", 2, F.lit(100.0), 1.0, F.col("column") == -1).orderBy("page", "row").collect()]
    assert got == [(1, 0, "KYRIALE", "one two"), (1, 0, "KYRIALE", "three"), (1, 1, "KYRIALE", "right"), (2, 0, "KYRIALE", "carried"), (2, 1, "CREDO", "last")]


def test_notation():
    r = notation.read("name: x;\n%%\n(c4) Ky(h)ri(gfg)e(h_') <i>ij.</i>(::) e(jvv)")
    assert r == {"steps": [-2, -3, -4, -3, -2, 0, 0], "phrases": [0, 0, 0, 0, 0, 1, 1], "words": "Kyrie ij. e", "flags": []}
    assert notation.read("(f3) a(h)")["steps"] == [3] and notation.read("(cb4) a(ixh)")["flags"] == ["accidental"]
    assert notation.read("a(h)")["flags"] == ["no clef"] and notation.read("(c4) a(h){")["flags"] == ["text without notes"] and notation.read("(c4) a(hQ|)")["flags"] == ["unknown notation"]


def test_sequences(spark):
    d = spark.createDataFrame([([1, 2, 3, 5], [11, 12, 13, 15], "dominus vobiscum", "xx domunus vobiscum et"), ([1], [1, 2], "", "a"), (None, [1], None, "b")], "a array<int>, b array<int>, s string, t string")
    got = d.select(sim.sequence_share("a", "b"), sim.text_share("s", "t"), sim.lies_inside("s", "t")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.938, False), (0.0, None, False), (None, None, False)]
    near = spark.createDataFrame([("dominusvobiscum", "etdominusvobiscumx")], "s string, t string")
    assert near.select(sim.lies_inside("s", "t")).first()[0]


def test_index_entries(spark):
    docs = [("v", [("s1", "ok", [("Asperges me", 1, None), ("Asperges me", 2, "bad"), ("Asperges me", 2, None)]), ("s2", None, [("Asperges me", 1, None), ("Else", 9, None)])]), ("w", [])]
    d = spark.createDataFrame(docs, "volume string, sections array<struct<section: string, status: string, entries: array<struct<label: string, page: int, status: string>>>>")
    good, bad = files.index_entries(d, "sections", F.lower(F.replace("label", F.lit(" "), F.lit("-"))))
    assert {(r["section"], r["slug"], r["status"]) for r in good.collect()} == {("s1", "asperges-me", "ok"), ("s1", "asperges-me-p2", "bad"), ("s2", "asperges-me-p1", None), ("s2", "else", None)}
    assert [(r["page"], r["reason"]) for r in bad.collect()] == [(2, "slug is taken: asperges-me-p2")]


def test_folds_over_batches(spark):
    """One key over many batches, and null keys."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = spark.createDataFrame([(k, i, float(i % 5 + 1)) for k in (1, None) for i in range(60)], "k long, i long, s double")
        got = {(r["k"], r["i"]): r["page"] for r in state.greedy_fill(d, "k", ["i"], "s", 9.0).collect()}
        page, used = 1, 0.0
        for i in range(60):
            if used and used + i % 5 + 1 > 9:
                page, used = page + 1, 0.0
            used += i % 5 + 1
            assert got[1, i] == got[None, i] == page
        moves = state.status_moves(d.withColumn("m", F.lit("go")), "k", ["i"], "m", {"go": ("a", "b")}, "a")
        assert {(r["k"], r["status"], r["landed"]) for r in moves.collect()} == {(1, "b", 1), (None, "b", 1)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
