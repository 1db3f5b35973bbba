"""Spelling variants grouped: words that differ by one code point, found by a rare-first q-gram prefix filter.

Words are counted over all texts first. Their positional bigrams are ordered globally, the rarest bigram first (ties by bigram, then by place in the word), and
each word is filed under its three rarest. One inserted, deleted or replaced code point destroys two bigrams of a word at most, so two near words have one of their three in
common, at places that the edit moves by one at most: in words of one length at the same place, else at the same place or one behind. All of the edit lies on one side of such a
bigram, and in one half of that side, so the join key is the bigram, its place and the length, which are the limits of place, with the side and the half that the edit leaves: what a
verification would compare first. A word also files itself as the shorter one under the keys of words one longer. Every pair that meets is verified by its edit distance.

At scale: the only tables are the vocabulary, 24 short rows a word at most for the join, and the near pairs. The order of bigrams is as large as the alphabet allows (90 letters
squared) and goes with the task. Words are counted map-side first, so a frequent word is a row a task. Forms at least double in count, so a chain of forms is short; roots are
found by pointer doubling over tables in the shared folder.

Defined results: null and empty texts have no words; rows that repeat a doc_id and a text count each; a null doc_id is written as nothing before the colon; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, stored

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RAREST = 5, 3, 3
#: One run in so many, by its hash, loses a code point.
DAMAGED = 97
FIRST, LAST = 0xC0, 0xFF  # the accented letters of RUN


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of all texts, one in DAMAGED with a code point deleted, that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.filter(F.length("run") >= LEAST_LETTERS).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram's place in the global order, the rarest first; as many entries as the alphabet has pairs, at most."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram")).groupBy("gram").count()
    return {r["gram"]: k for k, r in enumerate(sorted(grams.collect(), key=lambda r: (r["count"], r["gram"])))}


def rarest(word: str, order: dict[str, int]) -> list[int]:
    """The places of a word's rarest bigrams."""
    return sorted(range(len(word) - 1), key=lambda p: (order[word[p : p + 2]], p))[:RAREST]


def keys(word: str, order: dict[str, int]) -> Iterator[tuple[str, bool]]:
    """The keys that a word is filed under, and whether as the shorter one of two: length of the longer word, place of the bigram, what is on the bigram's intact side, and one half of
    the other side, as the edit leaves one half whole."""
    for p in rarest(word, order):
        for shorter in (False, True):
            n = len(word) + shorter
            if rest := n - p - 2:  # the edit is behind the bigram
                half = rest // 2
                yield f"{n},{p}<{word[: p + 2 + half]}", shorter
                if half:
                    yield f"{n},{p}({word[: p + 2]}|{word[half - rest :]}", shorter
            if rest := p + shorter:  # before it
                half = rest // 2
                yield f"{n},{rest}>{word[:half]}|{word[p:]}", shorter
                if half:
                    yield f"{n},{rest}){word[p - rest + half :]}", shorter


def filed(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """key (a hash), shorter, word, n: 24 rows a word at most."""

    def file(batches):
        for batch in batches:
            out = [(key, shorter, word, n) for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for key, shorter in keys(word, order)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], ["key", "shorter", "word", "n"])

    return words.select("word", "n").mapInArrow(file, "key string, shorter boolean, word string, n long").withColumn("key", F.xxhash64("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every two words that differ by one code point, once."""
    entries = filed(words, bigram_order(words))
    own = entries.filter(~F.col("shorter")).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    other = entries.select("key", "shorter", F.col("word").alias("a"), F.col("n").alias("a_n"))
    met = own.join(other.hint("merge"), "key").filter((F.col("shorter") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word where it is at least twice as frequent."""
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("best")), F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("best")))).alias("w"))
    best = ways.groupBy("w.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("w.best").alias("best"))
    takes = -F.col("best.less") >= 2 * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root: for words with a form, the last of their chain of forms, by pointer doubling."""
    now = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = nxt
        if not now.filter("moved").head(1):
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary of docs."""
    words = stored(vocabulary(docs, id_col, text_col), "words")
    formed = stored(forms(words, near_pairs(words)), "formed")
    dropped(words)
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda k: k::BIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"
    utf8 = "flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    return rf"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
each_run AS MATERIALIZED (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
tab AS MATERIALIZED (SELECT {table} AS tab),
hashed AS MATERIALIZED (SELECT run, k, {crc} AS h FROM each_run, tab),
made AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = cut.rest UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = cut.rest),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(less := -v.n, near := near)) AS best FROM near JOIN v ON v.word = near.near GROUP BY near.word),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 2 * n THEN best.near END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END::BIGINT AS form_n FROM v LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word"""
