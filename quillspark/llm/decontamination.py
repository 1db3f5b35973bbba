"""Benchmark passages in documents: a prefix-filtered set join, with DataFrame functions only.

A window is 10 consecutive words of an item (a shorter item is one window). To occur, all of a window's words must occur, so one necessary
word is enough of a prefix: the rarest, by its count over all documents. In each row, a bit filter over those prefix words picks candidate
places; each brings the words around it, is joined on its word to the windows filed under it, and kept where the window, laid by its word's
position, lies inside the text (the bounds) and equals the words there (the exact check).

Defined results: a null or empty text has no words and no hits; an item without words has no window; repeated rows are each judged; an empty
benchmark marks nothing; other columns are ignored. The window table is broadcast up to BROADCAST_BYTES, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, fits_broadcast, stored

WINDOW, BROADCAST_BYTES, MOST_BITS = 10, 8 << 20, 1 << 18
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; none where the text is null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """item_id, at, window (array of words) of every item."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("window"))


def maybe_broadcast(df: DataFrame, key_bytes: str) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, key_bytes, BROADCAST_BYTES) else df


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (sorted array of item_ids as strings) of every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = windows(benchmark, item_col, item_text_col, size)
    # how often the corpus has each benchmark word: the row filter below the count keeps the shuffle to benchmark words
    vocabulary = maybe_broadcast(items.select(F.explode("window").alias("word")).distinct(), "length(word) + 24")
    counts = texts.select(F.explode(words(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    # the rarest word of each window; a window with a word that no document has can't occur
    distinct = items.select(F.array_join("window", " ").alias("passage"), "window").distinct()
    ranked = distinct.select("passage", F.posexplode("window").alias("at", "word")).join(counts, "word", "left").fillna(0, ["count"])
    first = F.row_number().over(Window.partitionBy("passage").orderBy("count", "word", "at"))
    prefixes = ranked.withColumn("place", first).filter("place = 1 and count > 0").select("word", "passage", "at", (F.length("passage") - F.length(F.replace("passage", F.lit(" "))) + 1).alias("n"))
    prefixes = stored(prefixes, "prefixes")
    small = fits_broadcast(prefixes, "length(word) + length(passage) + 48", BROADCAST_BYTES)
    marked = bit_filter(prefixes)
    reach = size - 1
    rows = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    places = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: marked(F.get("w", i - 1)))
    context = F.transform(places, lambda i: F.struct((i - 1).alias("place"), F.get("w", i - 1).alias("word"), F.least(i - 1, F.lit(reach)).alias("lead"), F.slice("w", F.greatest(i - reach, F.lit(1)), F.lit(2 * reach + 1)).alias("near")))
    around = rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.when(F.size("w") > 0, context)).alias("c")).select("doc_id", "row", "n_words", "c.*")
    # joined by shuffle, rows without a candidate get keys of their own (no word has a space), so that they are no hot null key
    spread = F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string")))
    joined = around.join(F.broadcast(prefixes), "word", "left") if small else around.withColumn("word", spread).join(prefixes, "word", "left")
    inside = (F.col("lead") >= F.col("at")) & (F.col("place") - F.col("at") + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.expr("slice(near, greatest(lead - at, 0) + 1, n)"), " ") == F.col("passage")
    hit = F.when(inside & same, F.struct((F.col("place") - F.col("at")).alias("start"), "n", "passage"))
    per_row = stored(joined.select("doc_id", "row", "n_words", hit.alias("hit")).groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hits")), "hits")
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))).cast("long")
    of_passage = maybe_broadcast(items.select(F.array_join("window", " ").alias("passage"), F.col("item_id").cast("string").alias("item_id")).distinct(), "length(passage) + 32")
    passages = per_row.filter(F.size("hits") > 0).select("doc_id", "row", F.explode(F.array_distinct(F.col("hits.passage"))).alias("passage"))
    names = passages.join(of_passage, "passage").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    clean = per_row.filter(F.size("hits") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hit_rows = per_row.filter(F.size("hits") > 0).select("doc_id", "row", "n_words", n_hit.alias("n_hit"))
    key = F.col("h.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("h.row") == F.col("m.row"))
    return clean.unionByName(hit_rows.alias("h").join(names.alias("m"), key).select("h.doc_id", "n_words", "n_hit", "items"))


def without_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of the benchmark; each row goes by its own text, as rows are told apart by a hash of doc_id and text."""
    key = "_leak_key"
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    hit = find(keyed, benchmark, key, text_col).filter("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(maybe_broadcast(stored(hit, "leaks"), "8L"), key, "left_anti").select(*docs.columns)


def bit_filter(prefixes: DataFrame):
    """A condition on a word: whether its bit is set in a filter of at most MOST_BITS bits over the prefix words. Words that pass may still be none."""
    tokens = prefixes.agg(F.count_distinct("word").alias("n")).first()["n"]
    bits = min(MOST_BITS, 1 << max(10, (64 * tokens).bit_length()))
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(bits)).cast("int")
    slots = prefixes.select(slot(F.col("word")).alias("b")).distinct()
    filled = {r["k"]: r["m"] for r in slots.groupBy(F.shiftright("b", 5).alias("k")).agg(F.sum(F.expr("shiftleft(1L, b & 31)")).alias("m")).collect()}  # a row for 32 bits
    bitmap = F.from_json(F.lit(str([filled.get(k, 0) for k in range(bits >> 5)])), "array<bigint>")
    return lambda w: F.call_function("shiftright", F.get(bitmap, F.shiftright(slot(w), 5)), slot(w).bitwiseAND(31)).bitwiseAND(1) == 1


def oracle() -> str:
    tokens = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".replace("\\\\", "\\")
    return f"""
WITH iw AS (SELECT item_id, {tokens} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[i : i + {WINDOW - 1}]) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS passage
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {tokens} AS w FROM documents),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS passage
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.passage = win.passage),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
