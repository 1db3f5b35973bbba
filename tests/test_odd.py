"""Input that is damaged, hostile or lopsided has a defined result."""

import random

from pyspark.sql import functions as F

from quillspark.functions import notation
from quillspark.operators import grouped, scores, trees
from quillspark.sources import files


def test_links_stay_on_their_site(spark):
    """Host and port are compared whole, dot segments go, and attributes are found in any case and quotes."""
    page = "https://A.com:8443/x/y.html?q=1"
    hrefs = {
        'href="https://a.com:8443/p#top"': "/p", 'href="https://a.com/p"': None, 'href="https://a.com:8443.evil.org/p"': None, 'href="//a.com:8443/q"': "/q", 'href="//b.com/q"': None,
        'href="../up"': "/up", 'href="./z/../w"': "/x/w", "HREF='one'": "/x/one", 'href = "/a/./b/.."': "/a/", 'href="?page=2"': "/x/y.html?page=2", 'href="#here"': None, 'href="mailto:x@a.com"': None,
        'href="../../../root"': "/root", 'href=""': None, 'data-href="no"': "/x/no", 'href="d?x=../y"': "/x/d?x=../y",
    }
    rows = [(i, page, f"<a {h}>") for i, h in enumerate(hrefs)] + [(90, "https://a.com", '<a href="https://a.com.evil.org/p"><a href="b"><a href="https://a.com:443/c">'), (91, None, '<a href="x">'), (92, "no url", '<a href="x">'), (93, "http://h:80/d/", None)]
    got = {}
    for r in files.page_links(spark.createDataFrame(rows, "page_id long, url string, html string"), "html", "url").collect():
        got.setdefault(r["page_id"], set()).add(r["link"])
    want = {i: {f"https://a.com:8443{x}"} for i, x in enumerate(hrefs.values()) if x}
    assert got == want | {90: {"https://a.com/b", "https://a.com/c"}}


def test_scores_with_bad_numbers(spark):
    score = lambda note, tuplet="": f'<m><measure n="1"><layer n="1"><tuplet {tuplet}>{note}</tuplet><rest dur="4"/></layer></measure></m>'
    cases = {'<note dur="4" dots="x"/>': "bad dots", '<note dur="0"/>': "no length", '<note dur="-4"/>': "no length", '<note dur="²"/>': "no length", "<note/>": "no length", '<note dur="4" dots="999"/>': "bad dots"}
    for note, error in cases.items():
        got = scores.events_of(score(note, 'num="3" numbase="2"'))
        assert [e[7] for e in got] == [error, None], note
    for bad in ('num="0"', 'num="x"', 'numbase="-1"'):
        assert [e[7] for e in scores.events_of(score('<note dur="8"/>', bad))] == ["bad tuplet", None]
    df = spark.createDataFrame([(1, score('<note dur="4" dots="x"/>')), (2, None), (3, "<m"), (4, score('<note pname="c" oct="4" dur="4" dots="1"/>'))], "k long, x string")
    got = [(r["k"], r["num"], r["den"], r["error"] and r["error"].split(":")[0]) for r in scores.score_events(df, "k", "x").collect()]
    assert sorted(got, key=str) == [(1, 1, 4, None), (1, None, None, "bad dots"), (3, None, None, "no XML"), (4, 1, 4, None), (4, 1, 4, None)]


def test_trees_too_deep_to_parse(spark):
    deep = "[" * 200_000 + "]" * 200_000
    d = spark.createDataFrame([(1, deep), (2, '{"a": 1}')], "k long, doc string")
    assert {(r["k"], r["pointer"]) for r in trees.leaves(d, "k", "doc").select("k", "pointer").collect()} == {(1, "!"), (2, "/a")}


def test_percentiles_with_an_outlier(spark):
    """One value far off puts the others in no common cell."""
    rnd = random.Random(1)
    values = [rnd.randint(0, 5000) for _ in range(20_000)] + [10**15, None]
    rows = [("a", v) for v in values] + [("b", 7), ("c", None), (None, 3), (None, 1), (None, 2)]
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in grouped.percentiles(spark.createDataFrame(rows, "g string, v long"), "g", "v", {"low": 0.01, "mid": 0.5, "high": 1.0}).collect()}
    s = sorted(v for v in values if v is not None)
    at = lambda q: s[-(-len(s) * int(q * 100) // 100) - 1]
    assert got == {"a": (at(0.01), at(0.5), at(1.0)), "b": (7, 7, 7), None: (1, 2, 3)}


def test_notation_pieces():
    assert notation.read("(c4) a(h) (::) b(i) (f3) c(h)") == {"steps": [-2, -1, 3], "phrases": [0, 1, 1], "words": "a b c", "flags": []}
    assert notation.read("a(b(c)d)") == {"steps": [-7], "phrases": [0], "words": "b", "flags": ["no clef", "loose parentheses", "text without notes"]}
    assert notation.read("% c\n(c4) x(hvvv[lsr]i+jsss)")["steps"] == [-2] * 3 + [0] * 3
    assert notation.read("")["steps"] == [] and notation.read("(c4)(::)(::)y(j)")["phrases"] == [2]
