"""Fuzzy joins of titles with a vocabulary, exact at every size: an index of letters finds the pairs that can reach a ratio, and only those are compared.

A block ratio is at most twice the letters that two strings have in common, repeated ones as often, by the letters of both. So two strings of n and m letters with a ratio of
`least` have ceil(least * (n + m) / 2) letters in common, and of each string's letters, ordered by rarity over both tables, one of the first n (or m) less that many, plus one, is
common to both. Each string is filed under those, with both lengths, so the join is on a letter and two lengths; a pair that meets is compared by its letters, then by its blocks.
No pair that reaches `least` is lost, and none of one table's size decides what is found.

The scores are tables of pairs (text, entry, score); best_entries takes the best pair of each title. Pairs below `least` are none: such a title has neither key nor score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folding import is_numeral
from ..functions.similarity import lazy
from .graph import _cut

# ---- pairs of strings by their ratio ----


def letter_ranks(*tables: DataFrame) -> dict[str, int]:
    """Each letter's place by rarity in the strings `s` of the tables; as many as the strings have different code points."""
    counts: Counter = Counter()
    for df in tables:
        each = df.select(F.explode(F.split("s", "")).alias("x")).groupBy("x").count()
        counts.update({r["x"]: r["count"] for r in each.collect()})
    return {x: k for k, (x, _) in enumerate(sorted(counts.items(), key=lambda p: (p[1], p[0])))}


def needed(n: int, m: int, least: float) -> int:
    """Letters that strings of n and m letters with a ratio of `least` have in common."""
    return math.ceil(least * (n + m) / 2 - 1e-9)


def letter_keys(s: str, ranks: dict[str, int], lengths: list[int], least: float, left: bool) -> Iterator[str]:
    """The keys of a string among strings of the given lengths: the lengths of both, and its rarest letters, each with its occurrence."""
    seen: Counter = Counter()
    letters = []
    for x in s:
        seen[x] += 1
        letters.append((ranks[x], -seen[x], x))
    letters.sort()
    n = len(s)
    for m in lengths:
        common = needed(n, m, least)
        if common <= min(n, m):
            for _, k, x in letters[: n - common + 1]:
                yield f"{n},{m},{-k}{x}" if left else f"{m},{n},{-k}{x}"


@lazy("double")
def _ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The block ratio; none where the letters in common rule `least` out."""

    def one(x, y, low):
        m = SequenceMatcher(None, x, y)
        return m.ratio() if m.quick_ratio() >= low else None

    return pd.Series([one(x, y, low) for x, y, low in zip(a, b, least, strict=True)], dtype="Float64")


def ratio_pairs(left: DataFrame, right: DataFrame, least: float, both_ways: bool = False) -> DataFrame:
    """a, b, ratio, back: the strings `s` of left and right with a block ratio of `least` or more. The order of the two matters to the ratio: back is that of b and a, and with
    both_ways a pair counts where either reaches `least`. Null and empty strings have no pair."""
    left, right = (df.select("s").filter("s <> ''").distinct() for df in (left, right))
    ranks = letter_ranks(left, right)

    def filed(df: DataFrame, others: DataFrame, name: str) -> DataFrame:
        lengths = sorted(r["n"] for r in others.select(F.length("s").alias("n")).distinct().collect())
        is_left = name == "a"

        def file(frames):
            for frame in frames:
                rows = [(k, s) for s in frame["s"] for k in letter_keys(s, ranks, lengths, least, is_left)]
                yield pd.DataFrame(rows, columns=["key", name])

        return df.mapInPandas(file, f"key string, {name} string")

    met = filed(left, right, "a").join(filed(right, left, "b"), "key").select("a", "b").distinct()
    scored = met.withColumn("ratio", _ratio("a", "b", F.lit(least))).withColumn("back", _ratio("b", "a", F.lit(least)))
    reaches = F.coalesce(F.col("ratio") >= least, F.lit(False))
    return scored.filter(reaches | F.coalesce(F.col("back") >= least, F.lit(False)) if both_ways else reaches)


def holding_pairs(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """a, b: the strings `s` of left that hold one of right whole, of `least` letters or more: met by the rarest run of `least` letters of the held one."""
    left, right = (df.select("s").filter(F.length("s") >= least).distinct() for df in (left, right))
    runs = lambda df: df.select("s", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - (least - 1)), lambda i: F.substring("s", i, F.lit(least))))).alias("run"))
    held = runs(right)
    counts = runs(left).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(counts, "run", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).select(F.col("s").alias("b"), "r.run")
    return runs(left).withColumnRenamed("s", "a").join(rarest, "run").filter(F.contains("a", "b")).select("a", "b")


def head_pairs(heads: DataFrame, names: DataFrame, least: float = 0.55, bonus: float = 0.85, shortest: int = 4, held: int = 6) -> DataFrame:
    """text, entry, score of running heads `s` and names `s`: the block ratio, or `bonus` where one of `held` letters or more lies whole in the other. Heads with fewer than
    `shortest` letters are fragments, without a pair."""
    heads = heads.filter(F.length(F.replace("s", F.lit(" "), F.lit(""))) >= shortest)
    inside = holding_pairs(heads, names, held).unionByName(holding_pairs(names, heads, held).select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("ratio", F.lit(bonus))
    scored = ratio_pairs(heads, names, least).select("a", "b", "ratio").unionByName(inside)
    return scored.groupBy(F.col("a").alias("text"), F.col("b").alias("entry")).agg(F.bround(F.max("ratio"), 3).alias("score"))


# ---- pairs of titles by their words ----

#: A word is like another from this ratio on; a title that lies in the other counts so much of what it covers; a word of so many letters may be the beginning of another.
LIKE, COVERED, BEGINS = 0.75, 0.9, 4


def like_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, ratio, cover: the words `s` of titles and entries that are like one another. cover is how well a stands for b: 1 where it begins with it."""
    pairs = ratio_pairs(left, right, LIKE, both_ways=True)
    begins = left.select(F.col("s").alias("a"), F.explode(F.transform(F.sequence(F.lit(BEGINS), F.greatest(F.length("s"), F.lit(BEGINS))), lambda i: F.substring("s", F.lit(1), i))).alias("b")).distinct()
    whole = begins.filter(F.length("b") >= BEGINS).join(right.select(F.col("s").alias("b")).distinct(), "b").select("a", "b", F.lit(True).alias("begins"))
    return pairs.join(whole, ["a", "b"], "full_outer").select("a", "b", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.when(F.col("begins"), 1.0).otherwise(F.coalesce("back", F.lit(0.0))).alias("cover"))


def _paired(like: Column) -> Column:
    """The sum of ratios where the words of a title, in order, each take the likest entry word that is left. like: the pairs, by word, falling ratio and entry word."""
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit("").alias("word"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        free = (x["ratio"] >= LIKE) & (x["a"] != s["word"]) & ~F.array_contains(s["taken"], x["b"])
        return F.when(free, F.struct(F.array_append(s["taken"], x["b"]).alias("taken"), x["a"].alias("word"), (s["sum"] + x["ratio"]).alias("sum"))).otherwise(s)

    return F.aggregate(like, start, step, lambda s: s["sum"])


def title_pairs(titles: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """text, entry, score (rounded to three places) of the titles and entries, both arrays `words`, that are alike by `least`.

    Every numeral of a title must be in the entry. Other words pair off, each word of the title, in order, with the likest one that is left, and the score is twice the sum of
    their ratios by the words of both. An entry whose words, and numerals, are all covered by the title counts as nine tenths of how well, however much longer the title is.

    Candidates have a pair of like words, and are met by an entry's rarest words only: as many of its words must have a like word in the title as `least` asks, so the commonest
    need no look. The likeness of words is a table of distinct words."""

    def sides(df: DataFrame, name: str) -> DataFrame:
        numeral = lambda w: is_numeral(w)
        own = df.select(F.array_sort(F.array_distinct("words")).alias("w")).filter(F.size("w") > 0).distinct()
        return own.select(F.array_join("w", " ").alias(name), F.filter("w", numeral).alias("numerals"), F.filter("w", lambda w: ~numeral(w)).alias("words"))

    t, e = sides(titles, "text"), sides(entries, "entry")
    t_words, e_words = t.select("text", F.explode("words").alias("a")), e.select("entry", F.size("words").alias("n"), F.explode("words").alias("b"))
    like = _cut(like_words(t_words.select(F.col("a").alias("s")), e_words.select(F.col("b").alias("s"))))
    # the words of an entry that must be looked up
    low = least - 0.0005
    asks = F.greatest(F.lit(1.0), F.ceil(F.least(low * (F.col("n") + 1) / 2, low / COVERED * F.col("n")) - 1e-9))
    rarity = e_words.groupBy("b").agg(F.count(F.lit(1)).alias("often"))
    listed = e_words.join(rarity, "b").groupBy("entry", "n").agg(F.sort_array(F.collect_list(F.struct("often", "b"))).alias("r"))
    asked = listed.select("entry", F.explode(F.slice("r", F.lit(1), F.col("n") - asks.cast("int") + 1)).alias("r")).select("entry", "r.b")
    numbers = lambda x, y: F.size(F.array_except(x, y)) == 0
    pairs = t_words.join(like.select("a", "b"), "a").join(asked, "b").select("text", "entry").distinct()
    pairs = pairs.join(t, "text").join(e.select("entry", F.col("numerals").alias("e_numerals"), F.col("words").alias("e_words")), "entry").filter(numbers(F.col("numerals"), F.col("e_numerals")))
    carried = ["words", "numerals", "e_words", "e_numerals"]
    each = pairs.select("*", F.explode("words").alias("a")).select("*", F.explode("e_words").alias("b")).join(like, ["a", "b"])
    scored = each.groupBy("text", "entry").agg(F.sort_array(F.collect_list(F.struct("a", (-F.col("ratio")).alias("less"), "b", "ratio", "cover"))).alias("like"), *(F.any_value(c).alias(c) for c in carried))
    covers = F.transform(F.array_distinct(F.transform("like", lambda x: x["b"])), lambda b: F.array_max(F.transform("like", lambda x: F.when((x["b"] == b) & (x["cover"] >= LIKE), x["cover"]).otherwise(0.0))))
    covered = F.when(numbers(F.col("e_numerals"), F.col("numerals")), COVERED * F.aggregate(covers, F.lit(0.0), lambda s, x: s + x) / F.size("e_words")).otherwise(0.0)
    both = 2 * _paired(F.col("like")) / (F.size("words") + F.size("e_words"))
    by_words = scored.select("text", "entry", F.bround(F.greatest(both, covered), 3).alias("score"))
    # titles of numerals alone match entries of numerals alone that have them all
    alone = lambda df: df.filter(F.size("words") == 0)
    first = alone(t).select("text", "numerals", F.get("numerals", F.lit(0)).alias("x"))
    by_numerals = first.join(alone(e).select("entry", F.col("numerals").alias("e_numerals"), F.explode("numerals").alias("x")), "x").filter(numbers(F.col("numerals"), F.col("e_numerals"))).select("text", "entry", F.lit(1.0).alias("score"))
    return by_words.unionByName(by_numerals).filter(F.col("score") >= least)


# ---- any other score ----

#: Entries that a callback meets at once.
BLOCK = 1000


def called_pairs(texts: DataFrame, names: DataFrame, score: Callable[[str, str], float], least: float | None = None) -> DataFrame:
    """text, entry, score by a Python function, which no index can help: each distinct text `s` is a query against all names `s`, block by block. Without `least`, the pairs of each
    text that are the best of a block, however low."""
    texts, names = (df.select("s").filter("s IS NOT NULL").distinct() for df in (texts, names))
    blocks = names.groupBy(F.pmod(F.xxhash64("s"), F.lit(math.ceil(max(names.count(), 1) / BLOCK))).alias("block")).agg(F.collect_list("s").alias("names"))  # BLOCK names each, about
    asked = texts.withColumn("block", F.explode(F.array(*(F.lit(r["block"]) for r in blocks.select("block").collect())).cast("array<long>")))

    def call(frames):
        for frame in frames:
            rows = []
            for s, names in zip(frame["s"], frame["names"], strict=True):
                scored = [(s, x, float(score(s, x))) for x in names]
                low = max(r[2] for r in scored) if least is None else least
                rows += [r for r in scored if r[2] >= low]
            yield pd.DataFrame(rows, columns=["text", "entry", "score"])

    return asked.join(blocks, "block").select("s", "names").mapInPandas(call, "text string, entry string, score double")


# ---- the best entry ----


def best_entries(titles: DataFrame, vocabulary: DataFrame, title: str, key: str, name: str, pairs: DataFrame, order: str | None = None, after: str | None = None) -> DataFrame:
    """titles with key and score of the best vocabulary entry, by pairs (text, entry, score) of titles and names; null where a title has no pair. Of equal scores the entry first in
    `order` (else key) counts; with `after`, a column of titles, entries at or behind it come before the ones ahead of it, as an index runs on."""
    by = order or key
    asked = titles.select(F.col(title).alias("text"), (F.col(after) if after else F.lit(None).cast(dict(vocabulary.dtypes)[by])).alias("_after")).distinct()
    entries = vocabulary.select(F.col(key).alias("_key"), F.col(name).alias("entry"), F.col(by).alias("_by"))
    ahead = F.when(F.col("_after").isNotNull() & (F.col("_by") < F.col("_after")), 1).otherwise(0)
    best = F.min(F.struct((-F.col("score")).alias("less"), ahead.alias("ahead"), F.col("_by").isNull().alias("none"), "_by", "_key")).alias("m")
    found = asked.join(pairs, "text").join(entries, "entry").groupBy("text", "_after").agg(best)
    known = found.select(F.col("text").alias("_t"), "_after", F.col("m._key").alias(key), (-F.col("m.less")).alias("score"))
    same = titles[title].eqNullSafe(known["_t"]) & (titles[after].eqNullSafe(known["_after"]) if after else F.lit(True))
    return titles.join(known, same, "left").drop("_t", "_after")
