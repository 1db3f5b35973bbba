"""Whitening of embeddings: a compensated covariance of all vectors, its eigenvectors, and every vector projected on them with unit variance.

Entries become whole numbers, so the sums of a dimension are exact, and a vector is centred without rounding as n * x - S. The centred values, as pairs of doubles (double-double, a
high part and what it lacks), are multiplied for every two dimensions with error-free transformations (Knuth's sum, Dekker's product), and each task adds up the products of its rows
in double-double. A task's sums are a row for each dimension, with the high and the low parts apart; tasks are merged in a shuffle by dimension, again in double-double, so no order of
tasks and no large mean spoils the covariance. What comes to the driver is the square of the dimensions, whatever the number of rows. The eigenvectors of that matrix come from
LAPACK's dsyevd (by numpy.linalg.eigh): reduction to tridiagonal form, then divide and conquer. Signs are fixed: the largest entry of a component is positive.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are those with an entry of 2 ** 56 or more, which has no whole number in a long.
Vectors whose length is not the commonest (the longest, where two are equally common) are dropped too. Repeated rows and null or repeated ids count each. Components without variance (or with less than
the rounding of the largest), as of one vector or of equal vectors, have a null `whitened` and do not count in identity_error, which is null where no component has any; `explained` is null where nothing varies.
`deviation` is null where it exceeds a long. Vectors without entries have no components and so no rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**56  # times SCALE it is still in a long
#: Products of a pass: a stripe of pairs of dimensions, for as many rows as fill it.
STRIPE = 1 << 16
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

# ---- double-double: pairs of arrays, high and low ----


def two_sum(a, b):
    """a + b, and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b, and what rounding took from it."""
    p = a * b
    x, y = 134217729.0 * a, 134217729.0 * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def normal(h, low):
    s = h + low
    return s, low - (s - h)


def dd_add(ah, al, bh, bl):
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = normal(s, e + t)
    return normal(s, e + f)


def dd_multiply(ah, al, bh, bl):
    p, e = two_product(ah, bh)
    return normal(p, e + (ah * bl + al * bh))


def dd_divide(h, low, n: float):
    """By a whole number."""
    q = h / n
    p, e = two_product(q, n)
    return normal(q, ((h - p) - e + low) / n)


def dd_total(h: np.ndarray, low: np.ndarray):
    """The sum over the first axis, by halves."""
    while len(h) > 1:
        half = len(h) // 2
        s, t = dd_add(h[:half], low[:half], h[half : 2 * half], low[half : 2 * half])
        h, low = (np.concatenate([s, h[2 * half :]]), np.concatenate([t, low[2 * half :]])) if len(h) % 2 else (s, t)
    return h[0], low[0]


class Products:
    """Sums of the products of every two columns, in double-double."""

    def __init__(self, dims: int):
        self.i, self.j = np.triu_indices(dims)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))
        self.starts = np.searchsorted(self.i, np.arange(dims + 1)).tolist()

    def add(self, h: np.ndarray, low: np.ndarray) -> None:
        for a in range(0, len(self.i), STRIPE):
            at = slice(a, a + STRIPE)
            i, j = self.i[at], self.j[at]
            rows = max(1, STRIPE // len(i))
            for r in range(0, len(h), rows):
                x, y = h[r : r + rows], low[r : r + rows]
                self.high[at], self.low[at] = dd_add(self.high[at], self.low[at], *dd_total(*dd_multiply(x[:, i], y[:, i], x[:, j], y[:, j])))

    def rows(self):
        """A row for each dimension: its number, the high and the low parts of its products with itself and all later ones."""
        for i, (a, b) in enumerate(zip(self.starts, self.starts[1:], strict=False)):
            yield i, self.high[a:b], self.low[a:b]


PARTS = "i int, high array<double>, low array<double>"


def part_batch(rows) -> pa.RecordBatch:
    i, high, low = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(list(high), pa.list_(pa.float64())), pa.array(list(low), pa.list_(pa.float64()))], ["i", "high", "low"])


def merged(parts: DataFrame) -> DataFrame:
    """The parts of all tasks added up in double-double, a row for each i; a partition's rows stream by, sorted by i."""

    def merge(batches):
        at = h = low = None
        for batch in batches:
            for i, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.array(x), np.array(y)
                if i == at:
                    h, low = dd_add(h, low, x, y)
                else:
                    if at is not None:
                        yield part_batch([(at, h, low)])
                    at, h, low = i, x, y
        if at is not None:
            yield part_batch([(at, h, low)])

    return parts.repartition("i").sortWithinPartitions("i").mapInArrow(merge, PARTS)


def covariance_of(df: DataFrame, dims: int, n: int, centred) -> np.ndarray:
    """The covariance (divisor n) of the rows of df, whose batches centred() turns into centred values as high and low parts."""

    def products(batches):
        sums, any_rows = Products(dims), False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                sums.add(*centred(batch))
        if any_rows:
            yield part_batch(sums.rows())

    out = np.zeros((dims, dims))
    for r in merged(df.mapInArrow(products, PARTS)).collect():
        h, low = dd_divide(np.array(r["high"]), np.array(r["low"]), float(n))
        out[r["i"], r["i"] :] = out[r["i"] :, r["i"]] = h + low
    return out


# ---- whole numbers ----


def whole(c: Column) -> Column:
    return F.floor(c.cast("double") * SCALE).cast("long") + SHIFT


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is there and has finite entries only."""
    return df.filter(F.col(vec_col).isNotNull() & F.forall(vec_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: 64-bit where all fits, else Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def halves(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """c / n in double-double."""
    if c.dtype != object:
        h = c.astype(np.float64)
        return dd_divide(h, (c - h.astype(np.int64)).astype(np.float64), float(n))
    h = np.array([[v / n for v in row] for row in c.tolist()])
    return h, np.array([[float(Fraction(v, n) - Fraction(x)) for v, x in zip(row, xs, strict=True)] for row, xs in zip(c.tolist(), h.tolist(), strict=True)])


def deviations(c: np.ndarray) -> list[int | None]:
    """The sums of squares of the rows, exact; None beyond a long."""
    if c.dtype != object and c.shape[1] * float(np.abs(c.astype(np.float64)).max(initial=0)) ** 2 < 2.0**62:
        return (c * c).sum(axis=1).tolist()
    return [t if (t := sum(v * v for v in row)) < 1 << 63 else None for row in c.tolist()]


@dataclass
class Whitening:
    """n vectors, their sums by dimension, and the components by falling eigenvalue, as columns; varies tells which have variance."""

    n: int
    dims: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def varies(self) -> np.ndarray:
        return self.values > self.dims * np.finfo(np.float64).eps * max(float(self.values.max(initial=0.0)), 0.0)


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0)
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def numbers(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    return usable(df, vec_col).filter(F.size(vec_col) == dims).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, whole).alias("x"))


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening | None:
    """Of all usable vectors; None where there are none, or where they have no entries."""
    length = usable(df, vec_col).groupBy(F.size(vec_col).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None or not length["dims"]:
        return None
    n, dims = length["count"], length["dims"]
    rows = numbers(df, id_col, vec_col, dims)

    def adds(batches):
        sums = np.zeros(dims, object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                small = len(x) * float(np.abs(x.astype(np.float64)).max()) < 2.0**62
                sums = sums + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(int(v)) for v in sums])], ["i", "s"])

    by = rows.select("x").mapInArrow(adds, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.zeros(dims, object)
    for r in by:
        sums[r["i"]] = int(r["s"])
    v = covariance_of(rows.select("x"), dims, n, lambda batch: halves(scaled(matrix(batch.column(0), dims), n, sums), n))
    values, vectors = components(v)
    return Whitening(n, dims, sums, values, vectors, float(np.trace(v)))


def apply(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation, whitened (an array, one entry for each component with variance) of every usable vector."""
    varies = model.varies[:most]
    projection = model.vectors[:, :most][:, varies] / np.sqrt(model.values[:most][varies])
    n, sums, dims, width = model.n, model.sums, model.dims, int(varies.sum())

    def project(batches):
        for batch in batches:
            c = scaled(matrix(batch.column(1), dims), n, sums)
            h, low = halves(c, n)
            w = (h + low) @ projection
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(c), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["vec_id", "deviation", "whitened"])

    return numbers(df, id_col, vec_col, dims).mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, width: int) -> float | None:
    """The largest entry, without its sign, of the covariance of `whitened` less the identity; the means are taken in double-double too."""
    if not width:
        return None

    def adds(batches):
        h = low = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch.column(0), width)
                h, low = dd_add(h, low, *dd_total(w, np.zeros_like(w)))
        yield part_batch([(0, h, low)])

    r = merged(whitened.select("whitened").mapInArrow(adds, PARTS)).first()
    mean_h, mean_low = dd_divide(np.array(r["high"]), np.array(r["low"]), float(n))

    def centred(batch):
        h, e = two_sum(matrix(batch.column(0), width), -mean_h)
        return normal(h, e - mean_low)

    return float(np.abs(covariance_of(whitened.select("whitened"), width, n, centred) - np.eye(width)).max())


def whitened_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, id_col, vec_col)
    if model is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    varies = model.varies[:most]
    rows = stored(apply(df, model, id_col, vec_col, most), "whitened")
    error = identity_error(rows, model.n, int(varies.sum()))
    # components without variance, which come last, have no entry in the array
    shares = [(k + 1, float(e / model.trace) if model.trace > 0 else None) for k, e in enumerate(model.values[:most])]
    listed = F.array(*(F.struct(F.lit(k).cast("int").alias("component"), F.lit(share).cast("double").alias("explained")) for k, share in shares))
    each = rows.select("vec_id", "deviation", "whitened", F.explode(listed).alias("c"))
    return each.select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("c.component") - 1).alias("whitened"), "c.explained", F.lit(error).cast("double").alias("identity_error"))
