"""Passages that occur more than once, removed word by word: relative Lempel-Ziv parsing against an index of reference blocks.

Every window of WINDOW words has an anchor: the run of ANCHOR words in it whose hash is least (the rightmost of equals), so equal windows
have equal anchors at equal places. The windows of a document that share an anchor make up a block of WINDOW to 2 * WINDOW words, and all
blocks of all documents are indexed by anchor; each kind of block has its first occurrence in the corpus as reference (its last one, for the first itself).
A document's block is looked up in the index. One that the index has twice matches its reference as a whole. One whose anchor is known from other
blocks only can match in part: there windows are looked up one by one among those of the other blocks, one of each kind standing for its copies.
Blocks with an anchor of their own match nothing. The parse of a document then goes from left to right over its matches: a factor begins at
the first word that a match covers, with the longest match from there, and goes on as long as further matches go on in the same reference text at the same
distance; where they do not, at the factor's boundary, the next match begins a factor of its own, also where it overlaps the last WINDOW - 1 words. A factor is
WINDOW words at least, and the words of all factors go.

So the shuffles carry a row a block, about a fifteenth of the words, window hashes only at boundaries, and the compressed texts twice.
Counts are summed before the shuffle and joined back, so a passage that a third of the documents hold is no group in one task.

Defined results: a null or empty text has no words; texts shorter than a window keep all; repeated rows count as occurrences of one another
(each loses what the others hold); rows with a null doc_id are rows as others are; other columns are ignored; equality is that of two 64-bit hashes, of anchor
and window, and a row is known by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, dropped, hash_words, joined_hash, range_sums, run_hashes, stored, texts_of, words_of

WINDOW, ANCHOR = 35, 8
SPREAD = WINDOW - ANCHOR + 1  # runs in a window


def least(h: np.ndarray, k: int) -> np.ndarray:
    """For each of the runs of k values, the place of the least, the rightmost of equals."""
    place, value, size = np.arange(len(h)), h, 1
    while size < k:
        step = min(size, k - size)
        n = len(value) - step
        right = value[step:] <= value[:n]
        place, value = np.where(right, place[step:], place[:n]), np.where(right, value[step:], value[:n])
        size += step
    return place


def blocks(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the words of several documents, one after another: each block's anchor place, first and last window start, anchor hash and hash."""
    none = np.zeros(0, np.int64)
    if len(w) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    runs = run_hashes(w, ANCHOR)
    place = least(runs, SPREAD)
    start = np.flatnonzero(doc[: len(w) - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = place[start]
    cut = np.flatnonzero(np.diff(place)) + 1
    first, last = start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])]
    at = place[np.concatenate([[0], cut])]
    return at, first, last, runs[at], joined_hash(joined_hash(range_sums(w, first, last + WINDOW), (last - first).astype(np.uint64)), (at - first).astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def index(texts: DataFrame) -> DataFrame:
    """A row a block of texts (row, doc_id, text): row, at (first and last window start, packed), anchor, block."""

    def parse(batches):
        for whole in batches:
            for batch in batches_of(whole, 2):
                w, size = hash_words(texts_of(batch.column(2)))
                doc, offset = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                _, first, last, anchor, block = blocks(w, doc)
                own = doc[first] if len(first) else first
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(((first - offset[own]) << 8) | (last - first)), signed(anchor), signed(block)], ["row", "at", "anchor", "block"])

    return texts.mapInArrow(parse, "row long, at long, anchor long, block long")


def packed_texts(texts: DataFrame) -> DataFrame:
    """The texts as compressed bytes, for the shuffle."""

    def press(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in batches_of(whole, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if t is None else z.compress(t) for t in texts_of(batch.column(2))], pa.binary())], ["row", "doc_id", "packed"])

    return texts.mapInArrow(press, "row long, doc_id long, packed binary")


def boundary_windows(texts: DataFrame) -> DataFrame:
    """The windows of the given blocks: row, start, anchor, window."""

    def parse(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, packed, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, _ = hash_words([z.decompress(packed)])
                hashes = run_hashes(w, WINDOW)
                at, anchor = np.array([g["at"] for g in given], np.int64), np.array([g["anchor"] for g in given], np.int64)
                n = (at & 255) + 1
                start = np.repeat((at >> 8) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row, np.int64)), pa.array(start), pa.array(np.repeat(anchor, n)), signed(hashes[start])], ["row", "start", "anchor", "window"])

    return texts.mapInArrow(parse, "row long, start long, anchor long, window long")


def referring(found: DataFrame, kinds: DataFrame, key: list[str], place: str) -> DataFrame:
    """The rows of found with the reference of their kind: its first place (row and word) in the corpus, or the last one where the row is the first itself."""
    first = F.struct("row", place) == F.col("first")
    return found.join(kinds, key).withColumn("ref", F.when(first, F.col("last")).otherwise(F.col("first")))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The packed texts (row, doc_id, packed), and the matches: row, a, b (words a to b - 1), ref_row, ref_a (the row and word where the reference has them)."""
    texts = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_blocks = stored(index(texts), "blocks", compression="zstd")
    # the keys of each join are a table of their own: both its sides then come from fresh shuffles, whose hot partitions Spark splits
    known = stored(all_blocks.groupBy("anchor").count().filter("count > 1").select("anchor"), "known")
    shared = stored(all_blocks.join(known, "anchor", "left_semi"), "shared-blocks", compression="zstd")
    dropped(all_blocks)
    kinds = shared.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("first"), F.max(F.struct("row", "at")).alias("last"))
    kinds = stored(kinds, "kinds", compression="zstd")
    twice = kinds.filter("n > 1").select("anchor", "block", "first", "last")
    word = lambda at: F.shiftright(at, 8)
    whole = referring(shared, twice, ["anchor", "block"], "at").select("row", word("at").alias("a"), (word("at") + F.col("at").bitwiseAND(255) + WINDOW).alias("b"), F.col("ref.row").alias("ref_row"), word("ref.at").alias("ref_a"))
    # a kind of block whose anchor has other kinds: its windows are compared, one block standing for all of its kind
    several = stored(kinds.groupBy("anchor").count().filter("count > 1").select("anchor"), "several")
    ends = kinds.join(several, "anchor", "left_semi").select("first.*", "anchor").groupBy("row").agg(F.collect_list(F.struct("at", "anchor")).alias("given"))
    packed = packed_texts(texts)
    windows = stored(boundary_windows(packed.join(ends, "row").dropDuplicates(["row"]).select("row", "packed", "given")), "windows", compression="zstd")
    again = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start")).alias("first"), F.max(F.struct("row", "start")).alias("last")).filter("n > 1").drop("n")
    again = stored(again, "again", compression="zstd")
    parts = referring(windows, again, ["anchor", "window"], "start").select("row", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b"), F.col("ref.row").alias("ref_row"), F.col("ref.start").alias("ref_a"))
    return packed, whole.unionByName(parts)


def parsed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The factors of a document, as (a, b, ref_row, ref_a), from its matches: greedily from left to right, the longest match first."""
    out: list[tuple[int, int, int, int]] = []
    a = b = ref = shift = None
    for x, y, row, at in sorted(found, key=lambda m: (m[0], -m[1], m[2], m[3])):
        if b is not None and y <= b:
            continue  # within the factor
        if b is not None and row == ref and at - x == shift and x <= b - WINDOW + 1:
            b = y  # goes on in the same reference
            continue
        if b is not None:
            out.append((a, b, ref, a + shift))
        a, b, ref, shift = x, y, row, at - x
    return [*out, (a, b, ref, a + shift)] if b is not None else out


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by spaces, if asked for), kept_sha256, removed_spans (like `0-40,90-130`, in words), n_factors
    and factors (like `0-40:ref:7`, the row that has the reference and the word there, if kept is asked for) of every row."""
    packed, found = matches(docs, id_col, text_col)
    marks = found.groupBy("row").agg(F.collect_set(F.struct("a", "b", "ref_row", "ref_a")).alias("found"))

    def cut(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(z.decompress(packed)) if packed else []
                edge = np.zeros(len(words) + 1, np.int64)
                factors = parsed([tuple(m.values()) for m in given or ()])
                for a, b, _, _ in factors:
                    edge[a] += 1
                    edge[b] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                at = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join(x for x, g in zip(words, gone.tolist(), strict=True) if not g) if given else b" ".join(words)
                named = ",".join(f"{a}-{b}:{row}:{ref}" for a, b, row, ref in factors) if with_kept else None
                out.append((len(words), int(gone.sum()), kept.decode() if with_kept else None, hashlib.sha256(kept).hexdigest(), ",".join(f"{a}-{b}" for a, b in at.reshape(-1, 2).tolist()), len(factors), named))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "removed_spans", "n_factors", "factors"])

    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, removed_spans string, n_factors long, factors string"
    return packed.join(marks, "row", "left").select("doc_id", "packed", "found").mapInArrow(cut, schema)


def oracle() -> str:
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
dup AS (SELECT p FROM win GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM win WHERE p IN (SELECT p FROM dup)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY words.k) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
