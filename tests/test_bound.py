"""Literals, scores, staged bindings, approvals and borrowed parts on their odd cases."""

import json

from quillspark.functions import literals
from quillspark.operators import binding, scores


def test_literals():
    given = {"{a: 1, 'b': [true, null, undefined,], \"c\": {}}": {"a": 1, "b": [True, None, None], "c": {}}, "[f(1, {x: 2}), -3.5e2]": [None, -350.0], "'it\\'s \"q\"'": 'it\'s "q"', "{1: a.b + 2, z: 3}": {"1": None, "z": 3}}
    for text, want in given.items():
        assert json.loads(literals.literal_json(text)) == want
    assert [literals.literal_json(x) for x in ("{a: 1", "{a 1}", "", "} {}", "[" * 5000)] == [None] * 5
    assert literals.blocks_of(r"a{b{c}d}e{f} % {g}" + "\n" + r"\{h\} {i% }" + "\n}{open") == ["b{c}d", "f", "i\n"]


def test_scores():
    note = '<note pname="c" oct="4" dur="4"/>'
    doc = lambda x: f'<mei><measure n="1"><layer n="1">{x}</layer></measure></mei>'
    assert scores.events_of(doc(note)) == [("1", "1", 0, "c4", 1, 4, 0, None)]
    assert scores.events_of(doc("<chord dur='2' dots='2'>" + note + "</chord><rest dur='x'/>")) == [("1", "1", 0, "chord", 7, 8, 2, None), ("1", "1", 1, "rest", None, None, 0, "no length")]
    nested = doc(f'<tuplet num="3" numbase="2"><beam><tuplet num="5" numbase="4">{note}</tuplet></beam></tuplet>')
    assert scores.events_of(nested)[0][4:6] == (2, 15)
    assert scores.events_of('<!DOCTYPE a [<!ENTITY b "c">]><a/>')[0][-1] == "declares entities" and scores.events_of("<a>")[0][-1].startswith("no XML") and scores.events_of("<a/>") == []


def test_bind(spark):
    w = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2"), (3, "b", "s3"), (4, None, "s4"), (5, "e", "s5"), (6, "f", None), (7, "g", "s7")], "key long, alias string, seed string")
    e = spark.createDataFrame([("i1", "a", "s9"), ("i2", "b", "s2"), ("i4", None, "s4"), ("i5", None, "s5"), ("i6", "f", "x"), ("i7", "f", "y"), ("i8", "zz", "s7"), ("i9", "zz", "s7")], "id string, alias string, seed string")
    got = {r["key"]: (r["id"], r["stage"], r["error"]) for r in binding.bind(w, e, ["alias", "seed"]).collect()}
    assert got == {1: ("i1", "alias", None), 2: (None, "alias", "claimed twice"), 3: (None, "alias", "claimed twice"), 4: ("i4", "seed", None), 5: ("i5", "seed", None), 6: (None, "alias", "ambiguous"), 7: (None, "seed", "ambiguous")}


def test_approvals(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "q"), (5, "z")], "k long, digest string")
    given = spark.createDataFrame([(1, "x", 1, "a", "approved"), (2, "y", 1, "a", "approved"), (2, "y", 2, "b", "revoked"), (4, "old", 1, "a", "approved")], "k long, digest string, at long, by string, verdict string")
    got = {r["k"]: (r["state"], r["by"]) for r in binding.approval_states(items, given, "k").collect()}
    assert got == {1: ("current", "a"), 2: ("revoked", None), 3: ("carried", "a"), 4: ("lapsed", None), 5: ("open", None)}


def test_borrowed(spark):
    parts = spark.createDataFrame([("p", 1, None, "own1"), ("p", 2, "q", "?"), ("p", 3, "none", "left"), ("p", 4, None, "own2")], "k string, at long, lender string, value string")
    slices = spark.createDataFrame([("q", 1, "q1"), ("q", 2, "q2")], "k string, at long, value string")
    got = sorted((r["place"], r["value"], r["source"]) for r in binding.with_borrowed(parts, slices, "k", ["at"], "lender").collect())
    assert got == [(1, "own1", "own"), (2, "q1", "borrowed"), (3, "q2", "borrowed"), (4, "left", "unresolved"), (5, "own2", "own")]
