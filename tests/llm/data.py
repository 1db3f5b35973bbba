"""Small tables with nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, label long, h string, word string"


def texts(seed=0, n=40):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    word = lambda: rnd.choice(vocabulary)
    base = [" ".join(word() + rnd.choice(["", "", "", ".", ",", ".\n"]) for _ in range(rnd.randint(8, 160))) for _ in range(n)]
    passage = " ".join(word() for _ in range(60))
    out = list(base)
    for i in range(0, n, 4):
        w = base[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rnd.randrange(len(w))] = "EDIT" + word()
        out += [base[i], " ".join(w)]
    out += [f"{base[i]} {passage} {base[i + 1]}" for i in range(6)]
    out += [None, "", " ", "\n\n", "one", "One two three four", "one two three four", "é Ä ß 日本語 ​x", " ".join(word() for _ in range(6000)), "a " * 120, "x\ty\x0bz\x0cq\r\n"]
    return out


def frame(spark, given=None, ids=None):
    given = texts() if given is None else given
    ids = range(len(given)) if ids is None else ids
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", len(t or ""), "clash", 7, "h", "w") for i, t in zip(ids, given, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
