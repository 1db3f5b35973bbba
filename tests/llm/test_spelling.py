"""Spelling variants against brute force over all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import spelling

from .data import frame, texts


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    by = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n}


def found(docs):
    rows = spelling.variants(docs).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_brute_force(spark, seed):
    """Words of few letters, repeated letters and accents, so that near words, chains and ties are common."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abÀé") for _ in range(rnd.randint(4, 8))) for _ in range(120)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "Ökonomie", "ÖKONOMIE", "strasse", "straße", "x×y÷z"]
    given = [" ".join(rnd.choice(words[: 1 + rnd.randrange(len(words))]) for _ in range(rnd.randint(0, 90))) for _ in range(60)] + [None, "", "  ", "12 34", "aaaaaa " * 4000]
    want = brute(list(enumerate(given)))
    assert found(frame(spark, given)) == want
    assert sum(w[0] is not None for w in want.values()) >= 5


def test_nulls_ties_repeats_and_empty_tables(spark):
    given = ["stone stone stone", "stone stone stone", "stome stome stome stome stome stome stome", "stope stope stope stope stope stope stope stone", None]
    ids = [None, None, 3, 3, 9]
    got = found(frame(spark, given, ids))
    assert got == brute(list(zip(ids, given, strict=True)))
    chain = ["colour " * 40, "colouur " * 20, "colouuur " * 9, "colouuuur " * 4]
    assert {w: r[1] for w, r in found(frame(spark, chain)).items()} == dict.fromkeys(["colour", "colouur", "colouuur", "colouuuur"], "colour")
    assert found(frame(spark).limit(0)) == {}
    assert found(frame(spark, ["abc de", None, ""])) == {}
    assert found(frame(spark, texts(3))) == brute(list(enumerate(texts(3))))


def test_two_near_words_share_a_key():
    """Any global order of bigrams will do: the three rarest of both words and the intact half make one key that both have."""
    rnd = random.Random(5)
    for _ in range(3000):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 9)))
        i, c = rnd.randrange(len(w)), rnd.choice("abcd")
        v = rnd.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])
        if v == w:
            continue
        grams = [x + y for x in "abcd" for y in "abcd"]
        rnd.shuffle(grams)
        order = {g: k for k, g in enumerate(grams)}
        short, long = sorted((w, v), key=len)
        mine = {k for k, shorter in spelling.keys(long, order) if not shorter}
        other = {k for k, shorter in spelling.keys(short, order) if shorter == (len(w) != len(v))}
        assert mine & other, (w, v)
