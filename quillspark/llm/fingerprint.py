"""Fingerprints of documents: a Merkle tree over sections and paragraphs, with DataFrame functions only.

A paragraph is a line; a section ends with a paragraph whose own hash says so (one in four), so an inserted line moves no later section. Every node is a whole SHA-256: a
paragraph's of its text, any other's of its children's hashes. Below the paragraphs come pieces, for likeness: each run of letters and digits, PIECE code points at most, with the one before
it. Where pieces begin depends on what is around them only, never on the length of the text. Of the hashes of a text's pieces the LEAST smallest are kept (a bottom-k sketch).
A fingerprint is `root|sections|paragraphs|pieces`, the root whole, the levels below it cut to 8 hex digits for print only: equal
roots mean equal texts, and where roots differ, the branches that differ tell which sections and paragraphs were edited.
Likeness is 1 for equal roots, else twice the pieces that both have by the pieces of each (Dice's coefficient, 0 to 1): exact up to LEAST pieces, else estimated from the
smallest hashes of both, with a standard error of 0.04 at most.

Defined results: a null text is an empty one; a table with one document is followed by itself; documents with the same doc_id are
ordered by text; other columns are ignored; a null doc_id comes first in the order.

Successors at scale: documents are dealt out by blocks of consecutive ids, and each block also gets a copy of the document that follows its last,
so one shuffle of the texts suffices and no task sees more than a block of ids. Blocks find their successors within ranges of ids; only the ranges'
first ids, as many as there are partitions, meet in one task. Ids far apart make many blocks, which costs a second copy of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, stored

BLOCK = 1024
#: First digits of the hashes of paragraphs that end a section.
ENDS = "048c"
BROADCAST_BYTES = 8 << 20
#: What pieces are made of: no ASCII marks or white space, and no marks of Chinese and Japanese; and how many of their hashes are kept.
PIECE, LEAST = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{3000}-\x{303F}\x{FF00}-\x{FF0F}]{1,8}", 128


def fingerprint(text: Column) -> Column:
    """The fingerprint of a string column; null counts as empty."""
    whole = lambda x: F.sha2(x, 256)
    short = lambda level: F.transform(level, lambda x: F.substring(x, 1, 8))
    text = F.coalesce(text, F.lit(""))
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  names a value, so that it isn't computed again for each use
    pairs = lambda c: F.transform(c, lambda x, i: F.concat(F.when(i > 0, F.get(c, i - 1)).otherwise(""), F.lit(" "), x))
    sketch = F.transform(F.array_distinct(once(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), pairs)), lambda x: F.substring(F.md5(x), 1, 8))
    least = F.array_join(F.slice(F.sort_array(F.array_distinct(sketch)), 1, LEAST), "")
    # sections: the paragraphs' hashes as one string, with a mark behind those that end a section
    marked = lambda p: F.array_join(F.transform(p, lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin(*ENDS), "/").otherwise(""))), "")
    sections = lambda p: F.transform(F.split(F.rtrim(marked(p), F.lit("/")), "/", -1), whole)
    printed = lambda s, p: F.concat_ws("|", whole(F.array_join(s, "")), F.array_join(short(s), ""), F.array_join(short(p), ""))
    tree = once(F.transform(F.split(text, "\n", -1), whole), lambda p: once(sections(p), lambda s: printed(s, p)))
    return F.concat(tree, F.lit("|"), least)


def hashes(level: Column) -> Column:
    """The 8-digit hashes of a level of a fingerprint."""
    return F.regexp_extract_all(level, F.lit("[0-9a-f]{8}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    part = lambda x: hashes(F.split_part(x, F.lit("|"), F.lit(4)))
    # of whole sketches all, of cut ones the smallest of both together
    both = lambda s: F.when((F.size(s["x"]) < LEAST) & (F.size(s["y"]) < LEAST), F.array_union(s["x"], s["y"])).otherwise(F.slice(F.sort_array(F.array_union(s["x"], s["y"])), 1, LEAST))
    counts = F.transform(F.array(F.struct(part(a).alias("x"), part(b).alias("y"))), lambda s: F.struct(F.size(both(s)).alias("n"), F.size(F.array_intersect(F.array_intersect(s["x"], s["y"]), both(s))).alias("m")))
    dice = F.element_at(F.transform(counts, lambda c: F.coalesce(2 * c["m"] / F.nullif(c["n"] + c["m"], F.lit(0)).cast("double"), F.lit(0.0))), 1)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(dice)


def first_edit(a: Column, b: Column) -> Column:
    """The first paragraph (from 0) in which two texts differ, by their fingerprints; null where the roots are equal."""
    part = lambda x: hashes(F.split_part(x, F.lit("|"), F.lit(3)))
    pairs = F.arrays_zip(part(a).alias("x"), part(b).alias("y"))
    differs = F.array_position(F.transform(pairs, lambda p: ~p["x"].eqNullSafe(p["y"])), True) - 1
    return F.when(F.substring(a, 1, 64) != F.substring(b, 1, 64), differs)


def edits(a: Column, b: Column) -> Column:
    """The paragraphs (from 0, comma-joined) of the second text that the first one lacks, by their fingerprints; empty where the roots are equal."""
    part = lambda x: hashes(F.split_part(x, F.lit("|"), F.lit(3)))
    places = lambda p, new: F.array_join(F.filter(F.transform(p, lambda h, i: F.when(F.array_contains(new, h), i.cast("string"))), lambda x: x.isNotNull()), ",")
    named = F.transform(F.array(F.struct(part(b).alias("p"), F.array_except(part(b), part(a)).alias("new"))), lambda s: places(s["p"], s["new"]))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), "").otherwise(F.element_at(named, 1))


def successors(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), with next_text: the text of the next document in ascending doc_id order, after the last the first's."""
    block = F.floor(F.col("doc_id") / BLOCK)
    heads = docs.groupBy(block.alias("block")).agg(F.min("doc_id").alias("head"))
    # a row a block: dealt out by ranges, in which each finds the one behind it; the last of a range takes the first of the next range, the very last the first of all
    ranged = stored(heads.repartitionByRange("head").select("block", F.struct("head").alias("h"), F.spark_partition_id().alias("range")), "heads")
    ranges = ranged.groupBy("range").agg(F.min("h").alias("low"))
    whole = Window.orderBy("range")
    first = F.first("low").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = ranges.select("range", F.coalesce(F.lead("low").over(whole), first).alias("after"))
    inner = F.lead("h").over(Window.partitionBy("range").orderBy("h"))
    following = ranged.withColumn("inner", inner).join(after, "range").select("block", F.coalesce("inner", "after")["head"].alias("next_id"))
    # a row a block, 16 bytes each: broadcast up to BROADCAST_BYTES, else joined by shuffle
    following = F.broadcast(following) if fits_broadcast(heads, "16L", BROADCAST_BYTES) else following
    # the first text of a doc_id stands for it where ids repeat
    ghosts = docs.join(following, F.col("doc_id").eqNullSafe(F.col("next_id"))).groupBy("block", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("block", F.lit(True).alias("ghost"), "doc_id", "text")
    rows = docs.select(block.alias("block"), F.lit(False).alias("ghost"), "doc_id", "text").unionByName(ghosts)
    next_text = F.lead("text").over(Window.partitionBy("block").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text"))
    return rows.withColumn("next_text", next_text).filter(~F.col("ghost")).select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter replaced by as many first code points of the next text, or all of them."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(following, F.lit(1), F.floor(n / 4).cast("int")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: fingerprints of its text and its edited text, and likenesses to the edited text and the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = successors(rows).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    marked = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).cast("long").alias("first_edit"), edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_paragraphs"))


def oracle() -> str:
    def tree(x: str) -> str:
        short = "list_transform({0}, lambda q: q[1:8])".format
        pairs = f"list_transform([regexp_extract_all({x}, '{PIECE}')], lambda c: list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 1 THEN c[i - 1] ELSE '' END || ' ' || c[i]))[1]"
        least = f"array_to_string(list_sort(list_distinct(list_transform(list_distinct({pairs}), lambda q: md5(q)[1:8])))[1:{LEAST}], '')"
        return f"""list_transform([list_transform(string_split({x}, chr(10)), lambda q: sha256(q))],
      lambda p: list_transform([list_transform(string_split(rtrim(array_to_string(list_transform(p, lambda h: h || CASE WHEN h[1:1] IN ({', '.join(map(repr, ENDS))}) THEN '/' ELSE '' END), ''), '/'), '/'), lambda q: sha256(q))],
        lambda s: sha256(array_to_string(s, '')) || '|' || array_to_string({short('s')}, '') || '|' || array_to_string({short('p')}, ''))[1])[1] || '|' || {least}"""

    def part(x: str, k: int) -> str:
        return f"regexp_extract_all(split_part({x}, '|', {k}), '[0-9a-f]{{8}}')"

    def like(a: str, b: str) -> str:
        x, y = part(a, 4), part(b, 4)
        both = f"list_sort(list_distinct({x} || {y}))[1 : CASE WHEN len({x}) < {LEAST} AND len({y}) < {LEAST} THEN {2 * LEAST} ELSE {LEAST} END]"
        m = f"len(list_intersect(list_intersect({x}, {y}), {both}))"
        return f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0::DOUBLE ELSE coalesce(2.0 * {m}::DOUBLE / nullif(len({both}) + {m}, 0), 0.0) END"

    p, q = part("fingerprint", 3), part("edited_fingerprint", 3)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM d),
e AS (SELECT *, text[1 : length(text) - length(text) // 4] || next_text[1 : length(text) // 4] AS edited FROM n),
f AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {tree("text")} AS fingerprint, {tree("edited")} AS edited_fingerprint, {tree("next_text")} AS next_fingerprint FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {like("fingerprint", "edited_fingerprint")} AS near_edited, {like("fingerprint", "next_fingerprint")} AS near_next,
  CASE WHEN fingerprint[1:64] <> edited_fingerprint[1:64] THEN coalesce(list_position(list_transform(range(1, greatest(len({p}), len({q})) + 1), lambda i: {p}[i] IS DISTINCT FROM {q}[i]), true), 0) - 1 END::BIGINT AS first_edit,
  CASE WHEN fingerprint[1:64] = edited_fingerprint[1:64] THEN '' ELSE array_to_string(list_transform(list_filter(range(1, len({q}) + 1), lambda i: NOT list_contains({p}, {q}[i])), lambda i: i - 1), ',') END AS edited_paragraphs
FROM f"""
