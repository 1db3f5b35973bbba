"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, with set-relation skipping.

Sets are the distinct runs of SHINGLE words (shorter texts: the whole sequence is one). Equal sets count as one from the start. A set's
tokens are ordered light before heavy, and only its prefix is indexed: two linked sets share a token of both prefixes. Skipping:

- by position: an index list holds each set's size and the token's place in it; lists are cut in blocks of near sizes, and blocks that an entry's place
  leaves too few tokens for are skipped as a whole, then single entries are (the first token that two linked sets share leaves enough of both);
  parity bits of the sets rule out most pairs that are left;
- by answers: lists of the first few tokens link each set to one pivot of the list, which is verified. Sets that this joins are highly similar, so
  their pairs among one another are known to be of one component, and the full lists are searched only for pairs of different components.

A heavy token is one that some tasks saw repeatedly: the order only moves cost, never a result. Lists whose sets are all of one component
are dropped by an aggregate that is combined before the shuffle, so a group of near copies of any size is no list in one task.

Disk: prefixes, and the lists that pairs come from, go through the shuffle in ROUNDS parts by token, each done before the next begins; texts are packed and shuffled only for the
sets of pairs that are to be verified, found by a hash of the text where those hashes can be broadcast. With each of these pairs one text goes through a
shuffle, so pairs whose texts are large against all sets are verified in parts as well: the disk goes with the input, whatever the number of pairs.

Defined results: a null or empty text, or one without words, has an empty set, linked with nothing (its component is its doc_id); repeated rows
are equal sets, so linked; rows with a null doc_id link as others do, but name no component (a component of only such rows has a null one); rows that share
a doc_id with another text are judged each by its own text; other columns are ignored. Links inside a component are not counted: its sets are joined
by pivots, and set_copies counts the rows with an equal set only. Set identity and tokens are 64-bit hashes, the verification compares token sets of the texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, dropped, fits_broadcast, forget, hash_words, mix, run_hashes, texts_of
from .common import stored as written
from .components import components

SHINGLE, SIMILAR = 5, 75  # words; percent
#: A token counts as heavy where tasks that hold it at least LOCAL times hold it so often together; the most frequent of these are broadcast, 16 bytes each.
LOCAL, HEAVY, MOST_HEAVY = 2, 6, 1 << 20
#: Tokens of each set whose lists give pivots; the size beyond which a list of several components gets MORE_PIVOTS more.
PIVOT_TOKENS, LONG_LIST, MORE_PIVOTS = 6, 24, 16
#: Sizes of one block of a list differ by less than this factor.
BLOCK_RATIO = 1.15
#: Tokens that a task counts at once, 8 bytes each.
MOST_HELD = 2_000_000
#: Parts of the tokens whose prefixes and lists are shuffled one after another: each makes the sets again, and holds that share of the disk.
ROUNDS = 3
#: Bytes of text hashes, 8 each, that are broadcast to find the texts of pairs; of more, all texts are packed and shuffled.
MOST_HASHES = 64 << 20
#: Tokens of the sets whose texts go through the shuffle with pairs at once: as many as all sets have, or LEAST_MOVED if that is more.
LEAST_MOVED = 32 << 20
FOLD = ["x0", "x1", "x2", "x3"]
FACTS = ["kind", "a", "n", "sid", "h", "bits", *FOLD]


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct tokens of each text."""
    w, size = hash_words(texts, lower=True)
    runs, out = run_hashes(w, SHINGLE), []
    for a, n in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
        if n >= SHINGLE:
            s = np.sort(runs[a : a + n - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(mix(run_hashes(w[a : a + n], n) + np.uint64(n)) if n else w[:0])
    return out


def set_ids(sets: list[np.ndarray]) -> list[int | None]:
    """Hashes of sets, as signed 64-bit integers; null for the empty one."""
    size = np.array([len(s) for s in sets], np.int64)
    used = np.flatnonzero(size)
    out: list[int | None] = [None] * len(sets)
    if len(used):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(np.concatenate(sets) ^ np.uint64(0xD6E8FEB86659FD93)), (np.cumsum(size) - size)[used])
            ids = (sums ^ mix(size[used].astype(np.uint64))).view(np.int64)
        for i, x in zip(used.tolist(), ids.tolist(), strict=True):
            out[i] = x
    return out


def parity_bits(s: np.ndarray) -> bytes:
    """The parity of the tokens in each of 2 ** k slots, about as many slots as tokens: sets differ in at least as many tokens as their bits do."""
    k = max(8, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes) -> np.ndarray:
    """Parity bits as those of 256 slots: four signed 64-bit integers."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<i8").reshape(-1, len(FOLD)), axis=0)


def bits_allow(x: bytes, nx: int, y: bytes, ny: int) -> bool:
    """Whether two sets may be linked as far as their parity bits tell."""
    a, b, na, nb = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    while na > nb:  # two slots become one
        na //= 2
        a = (a & ((1 << na) - 1)) ^ (a >> na)
    while nb > na:
        nb //= 2
        b = (b & ((1 << nb) - 1)) ^ (b >> nb)
    return (100 + SIMILAR) * (a ^ b).bit_count() <= (100 - SIMILAR) * (nx + ny)


def described(texts: DataFrame) -> DataFrame:
    """kind 0: a, n, sid, h, bits, x0 to x3 = doc_id, set size, set, a hash of the text, the set's parity bits, whole and folded; kind 1: a, n = a token that this task saw n >= LOCAL times."""

    def parse(batches):
        forget()
        held: list[np.ndarray] = []
        seen: set[int | None] = set()
        for whole in batches:
            for batch in batches_of(whole, 1):
                sets = shingle_sets(texts_of(batch.column(1)))
                ids = set_ids(sets)
                bits = [parity_bits(s) if len(s) else None for s in sets]
                fold = np.stack([folded(b) if b else np.zeros(len(FOLD), np.int64) for b in bits], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), batch.column(2), pa.array(bits, pa.binary()), *(pa.array(x) for x in fold)], FACTS)
                first = {i: s for s, i in zip(sets, ids, strict=True) if i not in seen}  # equal sets count once
                seen.update(first)
                held.append(np.concatenate([np.zeros(0, np.uint64), *first.values()]))
                if sum(map(len, held)) > MOST_HELD:  # long tasks count in parts
                    yield from repeated(held)
        yield from repeated(held)

    def repeated(held):
        if held:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            tokens, n = tokens[n >= LOCAL].view(np.int64), n[n >= LOCAL]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int8)), pa.array(tokens), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), *[pa.nulls(len(n), pa.int64())] * len(FOLD)], FACTS)

    return texts.withColumn("h", F.xxhash64("text")).mapInArrow(parse, "kind byte, a long, n long, sid long, h long, bits binary, " + ", ".join(f"{x} long" for x in FOLD))


def prefix_size(n: int) -> int:
    return n - -(-SIMILAR * n // 100) + 1


def heavy_order(spark: SparkSession, heavy: pa.Table):
    """Heavy tokens (a), in order, and their counts (n), for every task."""
    tokens, counts = heavy["a"].to_numpy().view(np.uint64), heavy["n"].to_numpy()
    up = np.argsort(tokens, kind="stable")
    return spark.sparkContext.broadcast((tokens[up], counts[up]))


def postings(texts: DataFrame, shared, part: int = 0, parts: int = 1) -> DataFrame:
    """token, sid, n, at: the prefix of each set that a task holds, once for equal sets; of parts of all tokens, one. shared: heavy_order()."""

    def emit(batches):
        tokens, counts = shared.value
        seen: set[int] = set()
        for whole in batches:
            for batch in batches_of(whole, 1):
                out, ids, sizes = [], [], []
                sets = shingle_sets(texts_of(batch.column(1)))
                for s, sid in zip(sets, set_ids(sets), strict=True):
                    if sid is None or sid in seen:
                        continue
                    seen.add(sid)
                    k = prefix_size(len(s))
                    if len(tokens):
                        place = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        light = tokens[place] != s
                        if not light[: k + 1].all():
                            weighty = s[~light]
                            s = np.concatenate([s[light], weighty[np.argsort(counts[place[~light]], kind="stable")]])
                    out.append(s[:k])
                    ids.append(sid)
                    sizes.append(len(s))
                if out:
                    length = np.array([len(x) for x in out])
                    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                    token = np.concatenate(out)
                    mine = token % np.uint64(parts) == part
                    yield pa.RecordBatch.from_arrays([pa.array(x[mine]) for x in (token.view(np.int64), np.repeat(np.array(ids, np.int64), length), np.repeat(sizes, length).astype(np.int32), at.astype(np.int32))], ["token", "sid", "n", "at"])

    return texts.mapInArrow(emit, "token long, sid long, n int, at int")


def shared_lists(rows: DataFrame) -> DataFrame:
    """The rows of postings whose token another set has too, each set once a token; a task reads its tokens in order and holds a batch."""

    def keep(batches):
        last = None  # the last row of the batch before, if it was not yet given out
        for batch in batches:
            if not batch.num_rows:
                continue
            t, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            if last is not None and last[0] == t[0] and last[1] == s[0]:
                first[0] = False
            batch = batch.filter(pa.array(first))
            if not batch.num_rows:
                continue
            t = batch.column(0).to_numpy()
            same = t[1:] == t[:-1]
            joins = last is not None and last[0] == t[0]
            keep_ = np.concatenate([[joins], same]) | np.concatenate([same, [False]])
            if joins and not last[2]:
                yield last[3]
            if keep_.any():
                yield batch.filter(pa.array(keep_))
            last = (int(t[-1]), batch.column(1)[-1].as_py(), bool(keep_[-1]), batch.slice(batch.num_rows - 1))

    return rows.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(keep, "token long, sid long, n int, at int")


def crossing_pairs(rows: DataFrame) -> DataFrame:
    """a, b: pairs of sets of different labels in one list that sizes, places and folded parity bits allow; a pair may come several times.

    A list is cut into blocks of near sizes. An entry is filed under the block of its own size if its place leaves enough tokens for a partner of that size or
    more; an entry looks only into the blocks of the smaller sizes that its own place still allows, so whole blocks are skipped. Blocks are keys of a
    join of two fresh shuffles: Spark deals a hot one out over several tasks.
    """
    left = F.col("n") - F.col("at")
    top = F.floor((100 + SIMILAR) * left / SIMILAR) - F.col("n")  # the largest partner that the tokens from this place on can meet
    block = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(BLOCK_RATIO))).cast("int")
    low, high = F.ceil(SIMILAR * F.col("n") / 100), F.least("n", "top")
    sized = rows.withColumn("top", top)
    names = ["token", "block", "sid", "n", "top", "label", *FOLD]
    filed = sized.filter("top >= n").withColumn("block", block(F.col("n"))).select(*(F.col(c).alias(f"{c}_i" if c not in ("token", "block") else c) for c in names))
    asking = sized.filter(high >= low).withColumn("block", F.explode(F.sequence(block(low), block(high)))).select(*(F.col(c).alias(f"{c}_j" if c not in ("token", "block") else c) for c in names))
    differ = sum((F.bit_count(F.col(f"{x}_i").bitwiseXOR(F.col(f"{x}_j"))) for x in FOLD[1:]), F.bit_count(F.col(f"{FOLD[0]}_i").bitwiseXOR(F.col(f"{FOLD[0]}_j"))))
    both = F.expr(f"label_i <> label_j and n_i <= n_j and (n_i < n_j or sid_i < sid_j) and 100 * n_i >= {SIMILAR} * n_j and n_i <= top_j and n_j <= top_i") & ((100 + SIMILAR) * differ <= (100 - SIMILAR) * (F.col("n_i") + F.col("n_j")))
    keys = (F.col("f.token") == F.col("q.token")) & (F.col("f.block") == F.col("q.block"))
    # merged, so that a hot block can be split: never a hash table of a block
    joined = filed.alias("f").hint("merge").join(asking.alias("q"), keys & both)
    return joined.select(F.least("sid_i", "sid_j").alias("a"), F.greatest("sid_i", "sid_j").alias("b"))


def needed(x, y):
    """The least overlap of linked sets of x and y tokens."""
    return -(-SIMILAR * (x + y) // (100 + SIMILAR))


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sets' parity bits allow, and n, the size of b."""
    one = sketches.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    two = sketches.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))

    def check(batches):
        for batch in batches:
            good = [bits_allow(x, nx, y, ny) for x, nx, y, ny in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "na", "bits_b", "nb")), strict=True)]
            yield batch.select(["a", "b", "nb"]).rename_columns(["a", "b", "n"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "b").join(two, "a").mapInArrow(check, "a long, b long, n long")


def text_hashes(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """h: the hash of one text of each set of ids. sets: sid and h of every row."""
    return sets.join(ids, "sid", "left_semi").groupBy("sid").agg(F.min("h").alias("h")).select("h").distinct()


def packed_texts(texts: DataFrame, ids: DataFrame, hashes: DataFrame) -> DataFrame:
    """sid, packed: a compressed text of each set of ids, whose texts have these hashes."""
    if fits_broadcast(hashes, "8", MOST_HASHES):
        # another text may have the hash: what is kept is told apart by its set
        texts = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(hashes), "h", "left_semi").select("doc_id", "text")
    return pack(texts).join(ids, "sid", "left_semi").groupBy("sid").agg(F.first("packed").alias("packed"))


def verified(pairs: DataFrame, packed: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by their texts; of parts of all pairs, one."""
    one = packed.select(F.col("sid").alias("b"), F.col("packed").alias("text_b"))
    if parts > 1:
        pairs, one = (x.filter(F.pmod(F.xxhash64("b"), F.lit(parts)) == part) for x in (pairs, one))
    two = packed.select(F.col("sid").alias("a"), F.col("packed").alias("text_a"))

    def check(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if len(kept) > 500:
                    kept.clear()
                new = {sid: text for sid, text in ((a, x), (b, y)) if sid not in kept}
                if new:
                    kept.update(zip(new, shingle_sets([z.decompress(t) for t in new.values()]), strict=True))
                common = len(np.intersect1d(kept[a], kept[b], assume_unique=True))
                good.append(100 * common >= SIMILAR * (len(kept[a]) + len(kept[b]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "b").join(two, "a").mapInArrow(check, "a long, b long")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs, and set_copies, the rows with an equal set."""
    made: list[DataFrame] = []

    def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
        made.append(written(df, what, **options))
        return made[-1]

    def linked(pairs: DataFrame, what: str) -> DataFrame:
        """The stored pairs whose sets are linked; pairs itself goes."""
        # the texts of their sets, once for equal sets; by the set itself, so that no other row's text can stand for it
        ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        hashes = stored(text_hashes(sets, ids), "hashes")
        packed = stored(packed_texts(texts, ids, hashes), "texts", compression="none")
        n = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // max(LEAST_MOVED, tokens)))
        out = reduce(DataFrame.unionByName, [stored(verified(pairs, packed, k, n), what) for k in range(n)])
        dropped(packed)
        dropped(pairs)
        return out

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = stored(described(texts), "sets", compression="zstd")
    sets = facts.filter("kind = 0").select(F.col("a").alias("doc_id"), "n", "sid", "h")
    heavy = facts.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY).orderBy(F.desc("n"), "a").limit(MOST_HEAVY).toArrow()
    order = heavy_order(docs.sparkSession, heavy)
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    parts = [stored(shared_lists(postings(texts, order, k, ROUNDS)), "lists", compression="zstd") for k in range(ROUNDS)]
    lists = reduce(DataFrame.unionByName, parts)
    wanted = stored(lists.select("sid").distinct(), "wanted")
    sketches = stored(sets_bits(facts).join(wanted, "sid", "left_semi"), "sketches", compression="none")
    # answers by pivots: in each list of first tokens, every set against the largest. Keys of joins are tables of their own, so that Spark splits hot partitions
    firsts = lists.filter(F.col("at") < PIVOT_TOKENS)
    pivots = stored(firsts.groupBy("token").agg(F.max(F.struct("n", "sid")).alias("pivot")), "pivots")
    stars = firsts.join(pivots, "token").filter((F.col("sid") != F.col("pivot.sid")) & (100 * F.col("n") >= SIMILAR * F.col("pivot.n"))).select(F.col("pivot.sid").alias("a"), F.col("sid").alias("b")).distinct()
    found = stored(possible(stars, sketches), "star-pairs")
    edges = linked(found, "star-edges")
    labels = stored(components(edges), "labels")
    # long lists that are still of several components: more pivots of each, against the sets of other components
    long_lists = stored(mixed_lists(lists, labels).filter(F.col("size") > LONG_LIST).select("token"), "long-lists")
    tops = labels.withColumnRenamed("node", "pivot").withColumnRenamed("label", "pivot_label")
    rows = stored(labelled_lists(lists.join(long_lists, "token", "left_semi"), labels), "long-rows", compression="zstd")
    more_pivots = rows.groupBy("token").agg(*(F.min_by("sid", F.xxhash64("sid", F.lit(k))).alias(f"p{k}") for k in range(MORE_PIVOTS)))
    open_lists = stored(more_pivots.select("token", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(MORE_PIVOTS))))).alias("pivot")), "more-pivots")
    sizes = sketches.select(F.col("sid").alias("pivot"), F.col("n").alias("pivot_n"))
    open_lists = open_lists.join(sizes, "pivot").join(tops, "pivot", "left").withColumn("pivot_label", F.coalesce("pivot_label", "pivot"))
    against = rows.join(open_lists, "token").filter(f"label <> pivot_label and 100 * least(n, pivot_n) >= {SIMILAR} * greatest(n, pivot_n)").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
    found = stored(possible(against, sketches), "pivot-pairs")
    dropped(rows)
    edges = edges.unionByName(linked(found, "pivot-edges"))
    labels = stored(components(edges), "labels")
    # all lists, for pairs that these answers leave open
    mixed = stored(mixed_lists(lists, labels).select("token"), "mixed")
    named = stored(labelled_lists(lists.join(mixed, "token", "left_semi"), labels).join(sketches.select("sid", *FOLD), "sid").select("token", "sid", "n", "at", "label", *FOLD), "named", compression="zstd")
    for done in parts:
        dropped(done)
    pairs = [stored(crossing_pairs(named.filter(F.pmod("token", F.lit(ROUNDS)) == k)).distinct(), "pairs", compression="zstd") for k in range(ROUNDS)]
    dropped(named)
    found = stored(possible(reduce(DataFrame.unionByName, pairs).distinct(), sketches), "possible-pairs")
    more = linked(found, "edges")
    for done in (*pairs, sketches):
        dropped(done)
    # the later links join whole components: theirs are found among labels, which are few
    name = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    higher = components(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    joined = labels.unionByName(higher.select(F.col("label").alias("node"), F.col("label"))).distinct()
    final = joined.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label")).distinct()
    placed = sets.join(final.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "n", "sid", F.coalesce("label", "sid").alias("label"))
    placed = written(placed, "placed")
    for done in made:  # only placed is read from now on
        dropped(done)
    least = placed.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    copies = placed.filter("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("set_copies"))
    return placed.join(least, "label", "left").join(copies, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("set_copies", F.lit(0)).cast("long").alias("set_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of linked rows, that of the least doc_id (null ids last, then by a hash of the row); rows without words all stay.

    Rows are told apart by a hash of doc_id and text, so a row stays or goes by its own text, whatever other row has its doc_id, or none."""
    key = "_near_key"
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    linked = join_similar(keyed, key, text_col)
    ids = keyed.select(F.col(key).alias("doc_id"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("order"))
    groups = linked.filter("n_shingles > 0").select("doc_id", "component_id").distinct().join(ids.distinct(), "doc_id")
    stay = groups.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.key").alias(key), F.lit(True).alias("_near_words"))
    empty = linked.filter("n_shingles = 0").select(F.col("doc_id").alias(key), F.lit(False).alias("_near_words")).distinct()
    chosen = keyed.join(stay.unionByName(empty), key)
    # of rows that repeat doc_id and text, one
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    return chosen.withColumn("_near_place", place).filter("_near_place = 1 or not _near_words").select(*docs.columns)


def labelled_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with the component of each set; a set without links is its own."""
    return lists.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("token", "sid", "n", "at", F.coalesce("label", "sid").alias("label"))


def mixed_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """token, size of the lists of several components; combined before the shuffle."""
    per = labelled_lists(lists, labels).groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
    return per.filter("lo <> hi").select("token", "size")


def sets_bits(facts: DataFrame) -> DataFrame:
    """sid, n, bits, x0 to x3, once for equal sets."""
    return facts.filter("kind = 0 and sid is not null").groupBy("sid").agg(F.min("n").alias("n"), *(F.min(c).alias(c) for c in ("bits", *FOLD)))


def pack(texts: DataFrame) -> DataFrame:
    """sid, packed: a compressed text of each set that a task holds, once for equal sets."""

    def press(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        seen: set[int] = set()
        for whole in batches:
            for batch in batches_of(whole, 1):
                given = texts_of(batch.column(1))
                new = {i: t for i, t in zip(set_ids(shingle_sets(given)), given, strict=True) if i is not None and i not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(map(z.compress, new.values()), pa.binary())], ["sid", "packed"])

    return texts.mapInArrow(press, "sid long, packed binary")


def oracle() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= {SIMILAR} * (p.n + q.n - k)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.o AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(o) AS o FROM r GROUP BY 1) m USING (doc_id)"""
