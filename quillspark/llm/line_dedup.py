"""Lines that several documents hold, kept in one of them: an index of sharded cuckoo filters backed by exact reference-count tables, which takes documents in and out again.

A line's key is the first 16 bytes of the SHA-256 of the line, stripped of white space and with A-Z lower-cased; only lines of LEAST code points or more have one. An index at a path has,
by version, the postings (which document holds which key, as signed changes), the exact counts (how many documents hold a key, and the smallest doc_id of them) of the keys that a version
changed, and for each shard of the keys two cuckoo filters: of the keys that any document holds, and of those that two or more hold. Filters only say which keys need no look at the
tables: a key that they do not know is new, or held once; the rest is looked up, so results are exact. add() counts a batch, asks the filters, joins the counts of maybe known
keys only, and inserts new keys; remove() takes the postings of documents back, and deletes from the filters the keys whose count falls to none or to one. So removing what was added
leaves counts, filters' answers and results as they were. A version counts once its marker is there; what a failed run has left without one is written anew.

A filter is a stack of tables of one size, each of BUCKETS buckets of four 16-bit marks; a mark's two buckets are the same in every table, so equal marks stand for one another in any of
them and a deletion takes any. A full stack grows by a table.

At scale: counts are summed before their shuffle; shards are of a hash of the key, each met by a row a distinct key, so a line that a third of the documents hold is one row there; a
task holds one shard's filters and streams the keys by. Documents' lines meet the shared keys in a join whose hot partitions Spark can split. SHARDS is set when an index is made: one
for about a million keys.

Defined results: a null or empty text is one empty line; rows with one doc_id, or with none, are one document, which holds what any of them holds, and each row loses what the document loses;
no doc_id comes after all others, so of a document with an id and one without the first keeps its lines; a line repeated within its document only is not repeated; equality of keys is
that of 128 bits; a row is known by a 64-bit hash of doc_id and text; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, mix, stored, texts_of
from .substring_dedup import packed_texts

LEAST, STRIP = 10, b" \t\n\x0b\x0c\r"
SHARDS = 64
BUCKETS, SLOTS, FULL, ROUNDS = 1 << 14, 4, 0.9, 100
HELD, SHARED = "held", "shared"


def key_of(line: bytes) -> bytes | None:
    """A line's key, or None where it is too short."""
    line = line.strip(STRIP).lower()
    return hashlib.sha256(line).digest()[:16] if len(line) >= LEAST and (len(line) >= 4 * LEAST or len(line.decode()) >= LEAST) else None


# ---- cuckoo filters ----


def places(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first bucket and the mark (never 0) of each key."""
    parts = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return (parts[:, 0] % BUCKETS).astype(np.int64), (parts[:, 1] % 65535 + 1).astype(np.uint16)


def other(bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A mark's other bucket; of that one, the first again."""
    return bucket ^ (mix(mark.astype(np.uint64)) % BUCKETS).astype(np.int64)


class Cuckoo:
    """A filter as a stack of tables: 0 is an empty slot."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    def has(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        found, second = np.zeros(len(mark), bool), other(bucket, mark)
        for t in self.tables:
            found |= (t[bucket] == mark[:, None]).any(axis=1) | (t[second] == mark[:, None]).any(axis=1)
        return found

    def add(self, bucket: np.ndarray, mark: np.ndarray) -> None:
        """Inserts each mark once, repeated ones so often."""
        for k in count():
            if not len(mark):
                return
            if k == len(self.tables):
                self.tables.append(np.zeros((BUCKETS, SLOTS), np.uint16))
            room = max(0, int(FULL * BUCKETS * SLOTS) - int(np.count_nonzero(self.tables[k])))
            left = placed(self.tables[k], bucket[:room], mark[:room])
            bucket, mark = np.concatenate([left[0], bucket[room:]]), np.concatenate([left[1], mark[room:]])

    def remove(self, bucket: np.ndarray, mark: np.ndarray) -> None:
        """Deletes one copy for each mark; marks that are not there change nothing."""
        while len(mark):
            # one of each kind at a time: copies of a mark in its two buckets are taken one after another
            _, now = np.unique(np.minimum(bucket, other(bucket, mark)) * 65536 + mark, return_index=True)
            b, m, todo = bucket[now], mark[now], np.ones(len(now), bool)
            for t in self.tables:
                for at in (b, other(b, m)):
                    hit = (t[at] == m[:, None]) & todo[:, None]
                    row = np.flatnonzero(hit.any(axis=1))
                    t[at[row], hit[row].argmax(axis=1)] = 0
                    todo[row] = False
            rest = np.setdiff1d(np.arange(len(mark)), now)
            bucket, mark = bucket[rest], mark[rest]


def settled(table: np.ndarray, bucket: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts marks into free slots of their buckets; what found none."""
    for slot in range(SLOTS):
        free = np.flatnonzero(table[bucket, slot] == 0)
        at, first = np.unique(bucket[free], return_index=True)
        table[at, slot] = mark[free[first]]
        bucket, mark = np.delete(bucket, free[first]), np.delete(mark, free[first])
    return bucket, mark


def placed(table: np.ndarray, bucket: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts marks into a table, moving others to their other buckets; those without a place after ROUNDS."""
    for k in range(ROUNDS):
        for _ in range(2):
            bucket, mark = settled(table, bucket, mark)
            bucket = other(bucket, mark)
        if not len(mark):
            break
        at, first = np.unique(bucket, return_index=True)
        out = table[at, k % SLOTS].copy()
        table[at, k % SLOTS] = mark[first]
        bucket, mark = np.concatenate([np.delete(bucket, first), other(at, out)]), np.concatenate([np.delete(mark, first), out])
    return bucket, mark


# ---- shards: filters and keys stream by, sorted by shard ----

FILTERS = "shard int, kind string, layer int, slots binary"


def met(filters: DataFrame | None, keys: DataFrame, run, schema: str) -> DataFrame:
    """run(filters of a shard by kind, keys, signs by kind) for the keys (shard, key, held, shared) in blocks, then with no keys at a shard's end; it gives record batches."""
    rows = keys.select("shard", F.lit(1).alias("later"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("layer"), F.lit(None).cast("binary").alias("slots"), "key", HELD, SHARED)
    if filters is not None:
        blank = [F.lit(None).cast("binary").alias("key"), F.lit(0).cast("byte").alias(HELD), F.lit(0).cast("byte").alias(SHARED)]
        rows = filters.select("shard", F.lit(0).alias("later"), "kind", "layer", "slots", *blank).unionByName(rows)

    def stream(batches):
        shard, now = None, {}
        for batch in batches:
            shards = batch.column(0).to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(shards)) + 1):
                if not len(part):
                    continue
                piece = batch.slice(int(part[0]), len(part))
                if shards[part[0]] != shard:
                    if shard is not None:
                        yield from run(shard, now, None, None)
                    shard, now = int(shards[part[0]]), {HELD: Cuckoo(), SHARED: Cuckoo()}
                n = len(part) - int(piece.column(1).to_numpy().sum())  # the filters come first
                for kind, slots in zip(piece.column(2).slice(0, n).to_pylist(), piece.column(4).slice(0, n).to_pylist(), strict=True):
                    now[kind].tables.append(np.frombuffer(slots, np.uint16).reshape(BUCKETS, SLOTS).copy())
                if n < len(part):
                    rest = piece.slice(n)
                    yield from run(shard, now, rest.column(5).to_pylist(), {kind: rest.column(c).to_numpy() for kind, c in ((HELD, 6), (SHARED, 7))})
        if shard is not None:
            yield from run(shard, now, None, None)

    return rows.repartition("shard").sortWithinPartitions("shard", "later", "layer", "key").mapInArrow(stream, schema)


def asked(filters: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """The keys (shard, key) that the filters may hold."""

    def run(shard, now, given, signs):
        if given:
            yes = np.flatnonzero(now[kind].has(*places(given)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(yes), shard, np.int32)), pa.array([given[i] for i in yes.tolist()], pa.binary())], ["shard", "key"])

    zero = F.lit(0).cast("byte")
    return met(filters, keys.select("shard", "key", zero.alias(HELD), zero.alias(SHARED)), run, "shard int, key binary")


def changed(filters: DataFrame | None, keys: DataFrame) -> DataFrame:
    """The filters after insertions (1) and deletions (-1) of the keys (shard, key, held, shared)."""

    def run(shard, now, given, signs):
        if given is None:
            for kind, f in now.items():
                for layer, t in enumerate(f.tables):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind]), pa.array([layer], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["shard", "kind", "layer", "slots"])
            return
        bucket, mark = places(given)
        for kind, f in now.items():
            f.remove(bucket[signs[kind] < 0], mark[signs[kind] < 0])
            f.add(bucket[signs[kind] > 0], mark[signs[kind] > 0])

    return met(filters, keys, run, FILTERS)


# ---- the index ----

COUNTS = "shard int, key binary, refs long, first long"
POSTINGS = "shard int, key binary, doc_id long, change byte"


def line_keys(docs: DataFrame, shards: int) -> DataFrame:
    """row, doc_id, key, shard: the distinct keys of each row of docs (row, doc_id, text)."""

    def find(batches):
        for whole in batches:
            for batch in batches_of(whole, 2):
                found = [{k for line in t.split(b"\n") if (k := key_of(line))} if t else () for t in texts_of(batch.column(2))]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for f in found for k in sorted(f)], pa.binary())], ["row", "doc_id", "key"])

    return docs.mapInArrow(find, "row long, doc_id long, key binary").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


class LineIndex:
    """An index of the lines of documents at a path that all executors share, by one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path = spark, path
        shape = f"{path}/shape"
        if self._there(shape + "/_SUCCESS"):
            shards = spark.read.parquet(shape).first()["shards"]
        else:
            spark.range(1).select(F.lit(shards).alias("shards")).write.mode("overwrite").parquet(shape)
        self.shards = shards

    # -- versions

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, at: str) -> bool:
        fs, path = self._fs(at)
        return fs.exists(path)

    @property
    def version(self) -> int:
        """The last finished version; 0 at first."""
        return next(k for k in count() if not self._there(f"{self.path}/v{k + 1}/DONE"))

    def _read(self, what: str, schema: str) -> DataFrame | None:
        """The rows of all finished versions, with their version."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/v{k}/{what}").withColumn("version", F.lit(k)) for k in range(1, self.version + 1)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _commit(self, **tables: DataFrame) -> None:
        at = f"{self.path}/v{self.version + 1}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        fs, path = self._fs(f"{at}/DONE")
        fs.create(path).close()

    def _latest(self, df: DataFrame | None, keys: list[str], rest: list[str]) -> DataFrame | None:
        if df is None or self.version == 1:
            return df
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*keys, "x.*")

    # -- what it holds

    def counts(self) -> DataFrame:
        """key, refs (documents that hold it), first (the smallest of them, null where it has no id), with shard."""
        found = self._latest(self._read("counts", COUNTS), ["shard", "key"], ["refs", "first"])
        return (found if found is not None else self.spark.createDataFrame([], COUNTS)).filter("refs > 0").select("shard", "key", "refs", "first")

    def postings(self) -> DataFrame:
        """shard, key, doc_id: which document holds which key."""
        found = self._read("postings", POSTINGS)
        if found is None:
            return self.spark.createDataFrame([], POSTINGS).drop("change")
        if self.version > 1:
            found = found.groupBy("shard", "key", "doc_id").agg(F.sum("change").alias("change"))
        return found.filter("change > 0").select("shard", "key", "doc_id")

    def filters(self) -> DataFrame | None:
        """The filters of each shard, as its last version has them."""
        found = self._read("filters", FILTERS)
        if found is None or self.version == 1:
            return found
        last = found.groupBy("shard").agg(F.max("version").alias("version"))  # a row a shard
        return found.join(last, ["shard", "version"])

    # -- what changes it

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Takes documents in; lines that the index has of the same doc_id already are not counted again."""
        batch = stored(line_keys(rows_of(docs, id_col, text_col), self.shards).select("shard", "key", "doc_id").distinct(), "batch")
        new, old = batch, None
        if (filters := self.filters()) is not None:
            maybe = stored(asked(filters, batch.select("shard", "key").distinct(), HELD).join(self.counts().select("key", "refs", "first"), "key"), "known")
            held = self.postings().join(maybe.select("key"), "key", "left_semi").select("key", F.col("doc_id").alias("d"))
            new = stored(batch.alias("b").join(held.alias("h"), (F.col("b.key") == F.col("h.key")) & F.col("b.doc_id").eqNullSafe(F.col("h.d")), "left_anti"), "new")
            old = maybe.select("key", F.col("refs").alias("was"), F.col("first").alias("was_first"))
        counts = new.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"))
        if old is None:
            after = counts.withColumn("was", F.lit(0))
        else:
            after = counts.join(old, "key", "left").select("shard", "key", (F.col("refs") + F.coalesce("was", F.lit(0))).alias("refs"), F.least("first", "was_first").alias("first"), F.coalesce("was", F.lit(0)).alias("was"))
        self._finish(stored(after, "after"), new.withColumn("change", F.lit(1).cast("byte")), filters)

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes the documents with these ids (a null one: those without) out again; unknown ids change nothing."""
        if not self.version:
            return
        gone_ids = ids.select(F.col(id_col).cast("long").alias("d")).distinct()
        held, filters = self.postings(), self.filters()
        gone = stored(held.join(gone_ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi"), "gone")
        touched = stored(gone.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("less")), "touched")
        left = held.join(touched.select("key"), "key", "left_semi").join(gone_ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
        left = left.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"))
        refs = F.coalesce("refs", F.lit(0).cast("long"))
        after = touched.join(left, "key", "left").select("shard", "key", refs.alias("refs"), "first", (refs + F.col("less")).alias("was"))
        self._finish(stored(after, "after"), gone.withColumn("change", F.lit(-1).cast("byte")), filters)

    def _finish(self, after: DataFrame, postings: DataFrame, filters: DataFrame | None) -> None:
        """Writes a version: after has the counts of all changed keys, and what they were."""
        step = lambda least: ((F.col("refs") >= least).cast("byte") - (F.col("was") >= least).cast("byte")).cast("byte")
        events = after.select("shard", "key", step(1).alias(HELD), step(2).alias(SHARED))
        if filters is not None:
            filters = filters.join(after.select("shard").distinct(), "shard", "left_semi").select("shard", "kind", "layer", "slots")
        self._commit(postings=postings.select("shard", "key", "doc_id", "change"), counts=after.select("shard", "key", "refs", "first"), filters=changed(filters, events))

    # -- what it is for

    def dedupe(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (the lines that stay, if asked for), kept_sha256 of every row of docs, whose documents the index holds."""
        texts = rows_of(docs, id_col, text_col)
        drops = self.drops(texts) if self.version else self.spark.createDataFrame([], "row long, gone array<binary>")

        def cut(batches):
            import zstandard

            z = zstandard.ZstdDecompressor()
            for batch in batches:
                out = []
                for packed, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines = (z.decompress(packed) if packed else b"").split(b"\n")
                    gone = set(gone or ())
                    kept = [x for x in lines if key_of(x) not in gone] if gone else lines
                    whole = b"\n".join(kept)
                    out.append((len(lines), len(lines) - len(kept), whole.decode() if with_kept else None, hashlib.sha256(whole).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"])

        joined = packed_texts(texts).join(drops, "row", "left").select("doc_id", "packed", "gone")
        return joined.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string")

    def drops(self, texts: DataFrame) -> DataFrame:
        """row, gone: the keys that a row of texts (row, doc_id, text) loses."""
        lines = stored(line_keys(texts, self.shards), "lines", compression="zstd")
        maybe = asked(self.filters(), lines.select("shard", "key").distinct(), SHARED)
        shared = stored(maybe.join(self.counts().filter("refs > 1").select("key", "first"), "key").select("key", "first"), "shared")
        found = lines.select("row", "doc_id", "key").join(shared, "key").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        return found.groupBy("row").agg(F.collect_set("key").alias("gone"))


def oracle() -> str:
    white = " || ".join(f"chr({c})" for c in STRIP)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_line AS (SELECT r, doc_id, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
keyed AS (SELECT *, translate(trim(line, {white}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each_line),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) > 1),
marked AS (SELECT r, doc_id, i, line, shared.key IS NOT NULL AND doc_id IS DISTINCT FROM first AS gone FROM keyed LEFT JOIN shared ON keyed.key = shared.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY r, doc_id"""
