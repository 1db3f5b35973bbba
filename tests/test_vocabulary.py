"""The vocabulary joins against brute force over all pairs, on damaged titles of one and several words, at any size and with ties."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.operators import vocabulary as v

WORDS = ["septuagesima", "sexagesima", "quinquagesima", "dominica", "domini", "nativitas", "adventus", "pascha", "feria", "festo", "credo", "gloria", "martyris", "thomae", "ii", "iii", "iv", "x"]


def spoilt(rnd, s):
    s = list(s)
    for _ in range(rnd.randint(0, 3)):
        if s:
            i = rnd.randrange(len(s))
            s[i : i + 1] = rnd.choice([[], [s[i], rnd.choice("aeimnrst")], [rnd.choice("aeimnrst")]])
    return "".join(s)


def strings(spark, given, name="s"):
    return spark.createDataFrame([(x,) for x in given], f"{name} string")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.55, 0.75, 0.9])
def test_ratio_pairs_are_all_pairs_that_reach_it(spark, least):
    rnd = random.Random(int(least * 100))
    left = [spoilt(rnd, rnd.choice(WORDS)) for _ in range(60)] + ["", None, "a", "aaaaaaa", "日本語日本", "septuagesirna"]
    right = [spoilt(rnd, rnd.choice(WORDS)) for _ in range(60)] + ["", None, "a", "aaaa", "日本語", "septuagesima"]
    got = {(r["a"], r["b"]): (r["ratio"], r["back"]) for r in v.ratio_pairs(strings(spark, left), strings(spark, right), least, both_ways=True).collect()}
    want = {(a, b) for a in left for b in right if a and b and max(ratio(a, b), ratio(b, a)) >= least}
    assert set(got) == want and (("septuagesirna", "septuagesima") in want) == (least <= 0.88)
    assert all(x is None or abs(x - ratio(a, b)) < 1e-12 for (a, b), (x, _) in got.items())
    one_way = {(r["a"], r["b"]) for r in v.ratio_pairs(strings(spark, left), strings(spark, right), least).collect()}
    assert one_way == {(a, b) for a, b in want if ratio(a, b) >= least}


def title_score(a, b):
    """The rule over whole titles, word by word."""
    numeral = lambda w: all(c in "ivxlc" for c in w)
    na, nb = {w for w in a if numeral(w)}, {w for w in b if numeral(w)}
    wa, wb = sorted(set(a) - na), sorted(set(b) - nb)
    if not a or not b or not na <= nb:
        return 0.0
    free, total = list(wb), 0.0
    for w in wa:
        best = max(((ratio(w, x), -free.index(x)) for x in free), default=(0, 0))
        if best[0] >= 0.75:
            total += best[0]
            free.pop(-best[1])
    both = 2 * total / (len(wa) + len(wb)) if wa or wb else 1.0
    covers = [max([1.0 if len(w) >= 4 and x.startswith(w) else ratio(w, x) for x in wa], default=0.0) for w in wb]
    return max(both, 0.9 * sum(c for c in covers if c >= 0.75) / len(wb) if wb and nb <= na else 0.0)


def test_title_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(8)
    made = lambda: [spoilt(rnd, w) if len(w) > 4 and rnd.random() < 0.5 else w for w in rnd.sample(WORDS, rnd.randint(1, 4))]
    titles, entries = [made() for _ in range(70)] + [[], None, ["septuagesirna"], ["ii"], ["ii", "x"]], [made() for _ in range(70)] + [[], None, ["septuagesima"], ["ii", "iii"], ["thom"], ["x"]]
    df = lambda rows: spark.createDataFrame([(r,) for r in rows], "words array<string>")
    got = {(r["text"], r["entry"]): r["score"] for r in v.title_pairs(df(titles), df(entries), 0.6).collect()}
    want = {}
    for a in titles:
        for b in entries:
            s = title_score([w for w in a or [] if w], [w for w in b or [] if w])
            if a and b and s >= 0.6005:
                want[" ".join(sorted(set(a))), " ".join(sorted(set(b)))] = s
    assert set(want) <= set(got) and all(abs(got[k] - s) < 0.00051 for k, s in want.items())
    assert all(abs(got[k] - 0.6) < 0.001 for k in set(got) - set(want)) and len(want) > 40
    assert got["septuagesirna", "septuagesima"] == 0.88 and got["ii", "ii iii"] == 1.0 and ("ii x", "ii iii") not in got


def test_head_pairs_and_held_heads(spark):
    rnd = random.Random(2)
    names = ["properoftheseason", "kyriale", "commonofsaints", "credo", "creed", "antiphons"]
    heads = [spoilt(rnd, n) for n in names for _ in range(6)] + ["xxkyrialexx", "kyr", "season", "properofthe", "commonofsaintsandmore", "", None, "ab cd", "a b c"]
    got = {(r["text"], r["entry"]): r["score"] for r in v.head_pairs(strings(spark, heads), strings(spark, names)).collect()}
    want = {}
    for h in heads:
        for n in names:
            if h and len(h.replace(" ", "")) >= 4:
                s = max(ratio(h, n), 0.85 if min(len(h), len(n)) >= 6 and (h in n or n in h) else 0)
                if s >= 0.55:
                    want[h, n] = s
    assert set(got) == set(want) and all(abs(got[k] - s) < 0.00051 for k, s in want.items())
    assert got["xxkyrialexx", "kyriale"] == 0.85 and got["properofthe", "properoftheseason"] == 0.85 or got["properofthe", "properoftheseason"] > 0.7


def test_best_entries_ties_and_order(spark):
    vocabulary = spark.createDataFrame([(1, "dominica ii adventus"), (2, "adventus dominica iii"), (3, "domini nativitas"), (4, "domini nativitas"), (5, None)], "k long, name string")
    titles = spark.createDataFrame([("a", "advenlus dominica ii", None), ("b", "domini nativitas", 4), ("c", "domini nativitas", None), ("d", "else", None), ("e", None, None), ("f", "dominica iiii", None)], "id string, title string, after long")
    words = lambda df, c: df.select(F.split(c, " ").alias("words"))
    named = vocabulary.withColumn("name", F.array_join(F.array_sort(F.split("name", " ")), " "))
    pairs = v.title_pairs(words(titles, "title"), words(vocabulary, "name"), 0.6)
    got = {r["id"]: (r["k"], r["score"] is None) for r in v.best_entries(titles, named, "title", "k", "name", pairs, after="after").collect()}
    assert got == {"a": (1, False), "b": (4, False), "c": (3, False), "d": (None, True), "e": (None, True), "f": (None, True)}
    empty = v.title_pairs(words(titles, "title"), words(vocabulary.limit(0), "name"), 0.6)
    assert v.best_entries(titles, named.limit(0), "title", "k", "name", empty).filter("k is not null").count() == 0


def test_called_pairs_are_all_pairs(spark, monkeypatch):
    """Any function of two strings, over several blocks of names."""
    monkeypatch.setattr(v, "BLOCK", 3)
    left, right = ["a", "bb", "ccc", None], [x * k for x in "abc" for k in range(1, 6)] + [None]
    got = {(r["text"], r["entry"], r["score"]) for r in v.called_pairs(strings(spark, left), strings(spark, right), lambda a, b: float(a in b) / len(b), 0.3).collect()}
    assert got == {(a, b, 1 / len(b)) for a in left[:3] for b in right[:-1] if a in b and 1 / len(b) >= 0.3}
