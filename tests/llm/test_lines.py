"""Line dedup against brute force, its filters against multisets, and documents taken out again."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quillspark.llm import line_dedup
from quillspark.llm.common import scratch

from .data import frame, texts

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))
    return k if len(k) >= 10 else None


def brute(rows):
    """The result for rows of (doc_id, text), in their order; None comes after all ids."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: key(x) and len(holders[key(x)]) > 1 and min(holders[key(x)], key=lambda d: (d is None, d or 0)) != i
        kept = [x for x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def result(index, docs):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in index.dedupe(docs).collect())


def state(index):
    return {(bytes(r["key"]), r["refs"], r["first"]) for r in index.counts().collect()}


def given(seed, n=60):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice(["Alpha", "beta", "Äther", "日本語", "x"]) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    line = lambda: rnd.choice(["", " ", "\t", "\x0b"]) + rnd.choice([rnd.choice(pool), rnd.choice(pool).upper(), rnd.choice(pool).lower(), ""]) + rnd.choice(["", "\r", "  "])
    return ["\n".join(line() for _ in range(rnd.randint(0, 12))) for _ in range(n)] + [None, "", "\n\n", "a line of its own\na line of its own", "abcdefghi\nabcdefghij", "abcdefghi\nABCDEFGHIJ ", "éàüöäßñçøå", "ÉÀÜÖÄßÑÇØÅ", "éàüöäßñçøå "]


def fresh(spark):
    return line_dedup.LineIndex(spark, scratch(spark, "index"), shards=5)


def test_lines_are_those_of_brute_force(spark):
    for rows in (list(enumerate(given(1))), list(enumerate(texts(2)))):
        docs = frame(spark, [t for _, t in rows])
        index = fresh(spark)
        index.add(docs)
        assert result(index, docs) == brute(rows)
        kept = {r["doc_id"]: r["kept"] for r in index.dedupe(docs).collect()}
        assert all(hashlib.sha256(kept[i].encode()).hexdigest() == h for i, _, _, h in brute(rows))


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = given(4, 20)
    ids = [None, None, 5, 5, -3] + [i // 2 for i in range(len(t) - 5)]
    rows = list(zip(ids, t, strict=True)) + [(5, t[2]), (5, t[2])]
    docs = frame(spark, [x for _, x in rows], [i for i, _ in rows])
    index = fresh(spark)
    index.add(docs)
    assert result(index, docs) == brute(rows)
    empty = fresh(spark)
    assert result(empty, docs.limit(0)) == Counter() and result(empty, frame(spark, ["a long line of text"] * 2)) == Counter((i, 1, 0, hashlib.sha256(b"a long line of text").hexdigest()) for i in range(2))
    empty.add(docs.limit(0))
    assert result(empty, docs.limit(0)) == Counter() and state(empty) == set()


def test_batches_and_deletions_are_reversible(spark):
    """Documents in three batches, one batch taken out, another added twice: each time the index tells what one of the documents left alone would."""
    rows = list(enumerate(given(7, 90)))
    docs = lambda r: frame(spark, [t for _, t in r], [i for i, _ in r])
    a, b, c = rows[::3], rows[1::3], rows[2::3]
    index, alone = fresh(spark), fresh(spark)
    index.add(docs(a))
    before = state(index)
    index.add(docs(b))
    index.add(docs(b))  # again: nothing is counted twice
    index.add(docs(c))
    assert result(index, docs(rows)) == brute(rows)
    index.remove(docs(b + c))
    assert state(index) == before and result(index, docs(a)) == brute(a)
    index.remove(docs(b))
    index.add(docs(c))
    alone.add(docs(a + c))
    assert state(index) == state(alone) and result(index, docs(a + c)) == brute(a + c)
    # filters have no key that is gone, and each that is there
    for kind, least in ((line_dedup.HELD, 1), (line_dedup.SHARED, 2)):
        marks = sum(int(np.count_nonzero(np.frombuffer(r["slots"], np.uint16))) for r in index.filters().filter(f"kind = '{kind}'").collect())
        assert marks == sum(r[1] >= least for r in state(index))


def test_a_version_without_its_marker_is_no_version(spark):
    rows = list(enumerate(given(9, 30)))
    docs = frame(spark, [t for _, t in rows])
    index = fresh(spark)
    index.add(docs.filter("doc_id < 20"))
    index.add(docs.filter("doc_id >= 20"))
    os.remove(f"{index.path.removeprefix('file://')}/v2/DONE")  # as if the writer had stopped there
    assert index.version == 1 and state(index) == state_of(spark, docs.filter("doc_id < 20"))
    again = line_dedup.LineIndex(spark, index.path)
    assert again.shards == 5
    again.add(docs.filter("doc_id >= 20"))
    assert again.version == 2 and result(again, docs) == brute(rows)


def state_of(spark, docs):
    index = fresh(spark)
    index.add(docs)
    return state(index)


def test_cuckoo_filters_hold_what_was_added(spark):
    """Over several tables, with repeated marks, against a multiset: no key is missed, few others are found, all go again."""
    rnd = random.Random(3)
    keys = [rnd.randbytes(16) for _ in range(90_000)]
    f = line_dedup.Cuckoo()
    places = line_dedup.places(keys)
    f.add(*places)
    assert len(f.tables) == 2 and f.has(*places).all()
    strangers = line_dedup.places([rnd.randbytes(16) for _ in range(20_000)])
    assert f.has(*strangers).mean() < 0.01
    half = np.arange(len(keys)) % 2 == 0
    f.remove(places[0][half], places[1][half])
    assert f.has(places[0][~half], places[1][~half]).all() and sum(map(np.count_nonzero, f.tables)) == (~half).sum()
    same = line_dedup.places([keys[1]] * 30)
    f.add(*same)
    f.remove(same[0][:29], same[1][:29])
    assert f.has(same[0][:1], same[1][:1]).all()
    f.remove(places[0][~half], places[1][~half])
    f.remove(same[0][:1], same[1][:1])
    assert not any(t.any() for t in f.tables)
    f.remove(*strangers)
    assert not f.has(*places).any()
