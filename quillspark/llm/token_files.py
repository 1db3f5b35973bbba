"""Token ids in files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

One job tokenises every text and deals the id lists out by doc_id range, so that part files follow one
another in ascending doc_id order; each part is cut into blocks of about BLOCK ids. Counts of all ids give
one code for the corpus, at most MAX_BITS long. A block holds its documents' ids and lengths, its bits, and the
bit offset of each STEP-th id, so that a reader decodes all stretches of a block side by side by one table.

Defined results: a null text is an empty one (its list is the end id alone); an empty table gives no rows; rows that
repeat a doc_id are all kept, in the order of their texts; other columns are ignored; a text of any length is one
list. What the driver holds: a count for each id of the vocabulary, and a sum for each part file.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_WORD_BYTES, batches_of, dropped, kept, stored

BLOCK, STEP, MAX_BITS = 1 << 19, 256, 16


# ---- tokenising ----


class WordTokens:
    """Ids of texts by the tokenizers library, a word at a time: words seen before are looked up. A full store keeps the words that came again since it was last full.

    Exact for tokenizers whose pre-tokenizer drops white space and lower-cases, as word_bpe_49k does: no token spans
    white space.
    ASCII punctuation after a letter or digit, to the end of the word, is a pre-token of its own: such words are put together from both parts.
    Lower-casing A-Z first changes nothing where both forms are in NFC already and no special token can arise.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a batch is one list here: threads would have nothing to share
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # words of lower-case letters in NFC pass the normaliser and the splitting pattern unchanged: a copy without them is faster
        plain = json.loads(self.tokenizer.to_str())
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": next(x for x in plain["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # tokens that end a word, where the model marks them
        self.last, suffix = np.zeros(self.vocabulary, bool), self.tokenizer.model.end_of_word_suffix
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.size, self.known, self.n, self.held = 0, {}, 0, 0
        self.starts, self.ids, self.again = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, bool)

    def make_room(self) -> None:
        """Forgets the words that did not come again, or all, where that would leave little room."""
        stay = self.again[: self.n]
        words = list(compress(self.known, stay))  # known is in the order of its numbers
        ids, sizes = self.gather(np.flatnonzero(stay))
        self.clear()
        if 4 * len(words) <= 3 * self.most and 4 * sum(map(len, words)) <= 3 * MOST_WORD_BYTES:
            self.add(words, ids, sizes)

    def learn(self, words: list[bytes]) -> None:
        letters, other, both, known = {}, {}, [], self.known
        for w, s in zip(words, b"\n".join(words).decode().split("\n"), strict=True):  # no word holds a line feed
            stem = s if s.isalpha() else s.rstrip(string.punctuation)
            # whether the normaliser leaves the stem as it is; ASCII is in NFC
            same = stem.islower() or stem.isdigit() if stem.isascii() else stem.lower() == stem and unicodedata.is_normalized("NFC", stem)
            if len(stem) < len(s):
                if not same or not (stem[-1].isalpha() or "0" <= stem[-1] <= "9") or "<|" in s:
                    other[w] = s
                    continue
                cut = len(stem) - len(s)
                both.append((w, w[:cut], w[cut:]))
                if w[cut:] not in known:
                    other[w[cut:]] = s[cut:]
                w = w[:cut]
                if w in known:
                    continue
            if same and stem.isalpha():
                letters[w] = stem
            else:
                other[w] = stem
        self.learn_by(self.plain, list(letters.items()))
        self.learn_by(self.tokenizer, list(other.items()))
        if both:
            ids, sizes = self.gather(np.array([(known[a], known[b]) for _, a, b in both]).reshape(-1))
            self.add([w for w, _, _ in both], ids, sizes[::2] + sizes[1::2])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words, one word after another, and how many each has."""
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)], lengths

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[self.held : self.held + len(ids)] = ids
        self.starts[self.n + 1 : self.n + len(words) + 1] = self.held + np.cumsum(sizes)
        self.known.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.size += sum(map(len, words))
        self.n, self.held = self.n + len(words), self.held + len(ids)

    def learn_by(self, tokenizer, words: list[tuple[bytes, str]]) -> None:
        for i in range(0, len(words), 20_000):
            part, texts = [w for w, _ in words[i : i + 20_000]], [s for _, s in words[i : i + 20_000]]
            if tokenizer is self.plain and self.last.any():  # one pre-token a word: its marked token is its end, and no offsets are needed
                ids = np.array(tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
                sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            else:
                got = tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
                ids, sizes = np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            self.add(part, ids, sizes)

    def __call__(self, texts: list[bytes | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. Words are told apart by Arrow, so that each is looked up once a call."""
        # a copy: not all of Arrow's functions read slices right
        given = pa.concat_arrays([texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).cast(pa.string())]).fill_null("")
        low, whole = pc.ascii_lower(given), pc.match_substring(given, "<|").to_numpy(zero_copy_only=False).copy()
        other = np.flatnonzero(~pc.string_is_ascii(given).to_numpy(zero_copy_only=False))
        pairs = zip(given.take(other).to_pylist(), low.take(other).to_pylist(), strict=True)
        whole[other] |= np.array([not all(unicodedata.is_normalized("NFC", x) for x in pair) for pair in pairs], bool)
        trimmed = pc.ascii_trim_whitespace(pc.if_else(pa.array(whole), given, low))
        sizes = np.zeros(len(trimmed), np.int64)
        used = pc.binary_length(trimmed).to_numpy() > 0
        lists = pc.ascii_split_whitespace(trimmed.filter(pa.array(used)))
        sizes[used] = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        words = pc.binary_join(one, pa.scalar("\n", coded.dictionary.type))[0].as_buffer().to_pybytes().split(b"\n") if len(coded) else []
        if self.n > self.most or self.size > MOST_WORD_BYTES:
            self.make_room()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn([words[i] for i in new])
            at[new] = [self.known[words[i]] for i in new]
        at = at[coded.indices.to_numpy()]
        ids, lengths = self.gather(at)
        ends = np.cumsum(lengths)
        bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids, np.diff(bound)


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this Python worker."""
    return kept(("tokens", path), lambda: WordTokens(path))


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


# ---- the code ----


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit codes of {most} bits")
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_flags, packages = [], np.zeros(0)
    for _ in range(most):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        leaf_flags.append(rank < len(weights))
        merged = both[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take, lengths = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for leaf in reversed(leaf_flags):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.count_nonzero(lengths == 0) :].tolist():
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each next `most` bits: the id and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (most - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    ids[: spans.sum()], sizes[: spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def encoded(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Bits, the bit offset of each STEP-th id, and the number of bits."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    checkpoints = (ends - sizes)[::STEP].astype(np.uint64)
    value, size = codes[ids].astype(np.uint64), sizes.astype(np.uint64)
    for _ in range(2):  # neighbours become one, twice: four codes are 64 bits at most
        if len(value) % 2:
            value, size = np.append(value, np.uint64(0)), np.append(size, np.uint64(0))
        value, size = (value[::2] << size[1::2]) | value[1::2], size[::2] + size[1::2]
    ends = np.cumsum(size.astype(np.int64))
    start, used = ends - size.astype(np.int64), size > 0
    value, size, start = value[used], size[used], start[used]
    place, off = start >> 6, (start & 63).astype(np.uint64)
    left = value << (np.uint64(64) - size)
    first, rest = left >> off, np.where(off > 0, left << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
    out = np.zeros((total >> 6) + 2, np.uint64)
    if total:
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        out[place[cut]] = np.bitwise_or.reduceat(first, cut)
        out[place[cut] + 1] |= np.bitwise_or.reduceat(rest, cut)
    return out.astype(">u8").tobytes()[: (total + 7) >> 3], checkpoints, total


def decoded(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: all stretches go forward together, one table look-up an id."""
    data = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    ids, sizes = table
    at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), STEP), np.uint32)
    last = n - (len(checkpoints) - 1) * STEP
    for k in range(min(STEP, n)):
        if k == last:
            at = at[:-1]
        v = (three[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[: len(at), k] = ids[v]
        at = at + sizes[v]
    return out.reshape(-1)[:n]


# ---- the jobs ----

#: nulls holds the places in a block of the rows without a doc_id, which come first; in doc_ids they have 0.
BLOCKS = "part int, block int, first_doc_id long, n_docs long, n_ids long, doc_ids binary, nulls binary, sizes binary"


def id_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of plain ids, in ascending doc_id order within parts, and the parts in ascending order."""

    kind = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("width", pa.int32())])

    def blocks(batches):
        import zstandard

        tokens, press = word_tokens(tokenizer_path), zstandard.ZstdCompressor(level=1)
        width = 2 if tokens.vocabulary <= 1 << 16 else 4
        part, seq, held, rows = TaskContext.get().partitionId(), 0, 0, []

        def block():
            d, n, none = (np.concatenate([r[i] for r in rows]) for i in (0, 1, 3))
            raw = b"".join(r[2].astype(np.uint16 if width == 2 else np.uint32).tobytes() for r in rows)
            return pa.RecordBatch.from_pylist([{"part": part, "block": seq, "first_doc_id": None if none[0] else int(d[0]), "n_docs": len(d), "n_ids": int(n.sum()), "doc_ids": d.tobytes(), "nulls": np.flatnonzero(none).astype(np.int64).tobytes(), "sizes": n.tobytes(), "ids": press.compress(raw), "width": width}], schema=kind)

        for whole in batches:
            for batch in batches_of(whole, 1, BLOCK * 2):
                ids, sizes = with_end(*tokens(batch.column(1)), end_id)
                if rows and held + len(ids) > BLOCK:
                    yield block()
                    seq, held, rows = seq + 1, 0, []
                rows.append((batch.column(0).fill_null(0).to_numpy(), sizes.astype(np.int64), ids, batch.column(0).is_null().to_numpy(zero_copy_only=False)))
                held += len(ids)
        if rows:
            yield block()

    # dealt out before tokenising: finding the ranges reads its input once more, and that should be the scan alone. The texts' beginnings deal out rows that share an id, in the order of texts
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(blocks, BLOCKS + ", ids binary, width int")


def plain_ids(blob: bytes, width: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint16 if width == 2 else np.uint32)


def id_counts(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs in the corpus; a row for each id and task goes through the shuffle."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.bincount(plain_ids(blob, width))
                if len(now) > len(total):
                    now, total = total, now.astype(np.int64)
                total[: len(now)] += now
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return {r["id"]: r["n"] for r in blocks.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises docs and writes the token files at path: the codebook, and the blocks in ascending doc_id order."""
    spark = docs.sparkSession
    plain = stored(id_blocks(docs, tokenizer_path, end_id, id_col, text_col), "ids", compression="none")
    counts = id_counts(plain)
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    for k, n in counts.items():
        dense[k] = n
    lengths = code_lengths(dense)
    codes = canonical(lengths)
    shared = spark.sparkContext.broadcast((lengths, codes))  # at most 2 ** MAX_BITS entries

    def press(batches):
        lengths, codes = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                bits, checkpoints, _ = encoded(plain_ids(row.pop("ids"), row.pop("width")), lengths, codes)
                yield pa.RecordBatch.from_pylist([row | {"checkpoints": checkpoints.tobytes(), "bits": bits}], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("checkpoints", pa.binary()), ("bits", pa.binary())])
    spark.createDataFrame([(MAX_BITS, STEP, bytearray(lengths.tobytes()))], "max_bits int, step int, lengths binary").write.parquet(f"{path}/codebook")
    plain.mapInArrow(press, BLOCKS + ", checkpoints binary, bits binary").write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(plain)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decodes token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    book = spark.read.parquet(f"{path}/codebook").first()
    shared = spark.sparkContext.broadcast(decoding_table(np.frombuffer(bytes(book["lengths"]), np.uint8), book["max_bits"]))
    blocks = spark.read.parquet(f"{path}/blocks")
    heads = blocks.select("part", "block", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # a row for each part file
    within = heads.withColumn("within", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids"))
    starts = within.join(parts.select("part", "before"), "part").select("part", "block", (F.col("before") + F.col("within")).alias("block_start"))

    def open_(batches):
        table = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                ids = decoded(r["bits"], np.frombuffer(r["checkpoints"], np.uint64), r["n_ids"], table).astype("<u4")
                d, n = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["sizes"], np.int64)
                none = np.isin(np.arange(len(d)), np.frombuffer(r["nulls"], np.int64))
                lists = [p.tobytes() for p in np.split(ids, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), r["part"], np.int32)), pa.array(np.full(len(d), r["block"], np.int32)), pa.array(d, mask=none), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in lists], pa.int64()), pa.array(lists if with_ids else [None] * len(d), pa.binary())], ["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.mapInArrow(open_, "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(F.broadcast(starts) if blocks_are_few(starts) else starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def blocks_are_few(starts: DataFrame, most: int = 200_000) -> bool:
    """Whether the blocks' starts (16 bytes each) may be broadcast; otherwise they are joined by shuffle."""
    return starts.count() <= most
