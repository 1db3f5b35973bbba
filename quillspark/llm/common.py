"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a fresh local one only where it is unset and the master is local."""
    jsc = spark.sparkContext._jsc.sc()
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        found = jsc.getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut and any executor can reread it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    spark._jvm.System.gc()  # the finished job's shuffle files go once the driver has collected what refers to them
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a frame that stored() gave, by Hadoop's file system."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._quill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame, key_bytes: str, limit: int) -> bool:
    """Whether the rows of df, by the summed size expression, are under limit bytes: one small aggregate."""
    n = df.agg(F.sum(F.expr(key_bytes)).alias("n")).first()["n"]
    return (n or 0) <= limit


def ascii_lower(col):
    """A-Z lower-cased, nothing else touched."""
    return F.translate(col, UPPER, LOWER)


# ---- what a Python worker keeps from task to task ----

_kept: dict = {}
#: Bytes of words that such an object holds before it is emptied.
MOST_WORD_BYTES = 16 << 20


def kept(key, make):
    """The one object that this Python worker keeps between its tasks: asked for under another key, the one before goes."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """For tasks that need the memory and keep nothing: what the worker held goes back to the system, where the C library can give it back."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- vectorised words and hashes (numpy inside tasks) ----

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixing of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> S30)) * M1
        x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def run_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values, by doubling: about 2 log2(k) passes."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, w, 1
    while True:
        if k & size:
            part = power[done : done + n]
            out = part if out is None else joined_hash(out, part)
            done += size
        if size * 2 > k:
            return out if k > 1 else mix(out)
        power = joined_hash(power[: len(power) - size], power[size:])
        size *= 2


BREAKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STEP, BACK = np.uint64(0x9E3779B97F4A7C17), np.uint64(pow(0x9E3779B97F4A7C17, -1, 1 << 64))
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
VALUES = {False: _VALUES, True: _VALUES[_LOWER]}


def range_sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[a:b] modulo 2 ** 64, whatever their places: prefix sums by an inverse step, shifted back."""
    with np.errstate(over="ignore"):
        down = np.full(len(values) + 1, BACK)
        down[0] = 1
        np.cumprod(down, out=down)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * down[:-1], out=sums[1:])
        up = np.full(len(values) + 1, STEP)
        up[0] = 1
        np.cumprod(up, out=up)
        return (sums[b] - sums[a]) * up[a]


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, one after another (A-Z lower-cased if asked for), and how many each text has."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    edge = np.diff(np.concatenate([[True], BREAKS[raw]]).astype(np.int8))
    a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = joined_hash(range_sums(VALUES[lower][raw], a, b), (b - a).astype(np.uint64))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    counts = np.diff(np.append(np.searchsorted(a, begin), len(a)))
    return hashes, counts


def batches_of(batch: pa.RecordBatch, text: int, most_chars: int = 1_000_000):
    """Slices of a batch that hold about most_chars bytes of text at most, or one row."""
    size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > most_chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words as [^\\x20\\x09-\\x0D]+: bytes.split() cuts at exactly these six."""
    return text.split() if text else []
