"""Pages of rows with heights: a greedy fill with forced breaks, a cap, a first page of its own and rows that no page can hold; by jump pointers.

Heights count in millionths, so sums are exact. Where a page ends that begins at a row follows from the running sums alone: the first row whose sum is more than the page can
hold, found by sorting sums and limits together, or the next forced break, or the cap. So every row has a pointer to the row that would begin the next page. Which rows do begin pages is the
path of pointers from the first row: pointers are doubled until none is left, and the path is marked from the longest jumps to the shortest, in as many rounds as the number of pages has
bits, for all keys at once.

That moves every row several times. Keys of at most MOST_HELD rows, which is nearly all of them, are filled row by row instead, where a window has brought them together in order: a task
holds one such key. The pointers are for longer ones, and for those with heights below zero.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut, _drop

UNIT = 1_000_000
#: Rows of a key that are filled one by one.
MOST_HELD = 10_000


def _units(height: str) -> Column:
    return F.round(F.coalesce(height, F.lit(0.0)) * UNIT).cast("long")


def _filled(heights: list[int], breaks: list[bool], first: int, other: int, gap: int, cap: int | None) -> tuple[list[int | None], int | None]:
    """The pages of one key's rows, and the first row that is too tall for the page that it begins."""
    pages, page, used, rows, tall = [], 0, 0, 0, None
    for i, (h, forced) in enumerate(zip(heights, breaks, strict=True)):
        room = first if page == 1 else other
        if i == 0 or forced or (cap and rows >= cap) or used + gap + h > room:
            page, used, rows = page + 1, h, 1
            if tall is None and h > (first if i == 0 else other):
                tall = i
        else:
            used, rows = used + gap + h, rows + 1
        pages.append(page)
    return (pages if tall is None else [None] * len(pages)), tall


def paginate(df: DataFrame, key: str, order: list[str], height: str, room: float, first_room: float | None = None, gap: float = 0.0, cap: int | None = None, forced: str | None = None) -> DataFrame:
    """df with page (from 1; null for all rows of a key that has a row too tall for its page) and too_tall (the number, from 0, of the first such row).

    Rows fill a page in order, `gap` apart. A page begins where the next row doesn't fit, where `cap` rows are on it, and where `forced` is true (which for the first row says
    nothing). The first page of a key holds first_room, the others room. A null height is none."""
    how = (room, first_room, gap, cap, forced)
    if gap < 0:
        return _by_pointers(df, key, order, height, *how)
    rest = _cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(_units(height)).alias("_low")).filter((F.col("_n") > MOST_HELD) | (F.col("_low") < 0)).select(F.col(key).alias("_k")))
    if rest.isEmpty():
        return _by_rows(df, key, order, height, *how)
    same = F.col(key).eqNullSafe(F.col("_k"))
    return _by_rows(df.join(rest, same, "left_anti"), key, order, height, *how).unionByName(_by_pointers(df.join(rest, same, "left_semi"), key, order, height, *how))


def _by_rows(df: DataFrame, key: str, order: list[str], height: str, room: float, first_room: float | None, gap: float, cap: int | None, forced: str | None) -> DataFrame:
    """paginate where a task can hold the rows of any key."""
    limits = round((room if first_room is None else first_room) * UNIT), round(room * UNIT), round(gap * UNIT)
    breaks = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    # the window brings the rows of a key into one partition, in order; the sort after it finds them so
    together = df.select("*", _units(height).alias("_h"), breaks.alias("_forced"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_i")).sortWithinPartitions(key, "_i")
    names = df.columns

    def fill(batch):
        starts = [i for i, n in enumerate(batch.column("_i").to_pylist()) if n == 1] + [batch.num_rows]
        heights, breaks = batch.column("_h").to_pylist(), batch.column("_forced").to_pylist()
        pages, talls = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            found, tall = _filled(heights[a:b], breaks[a:b], *limits, cap)
            pages += found
            talls += [tall] * (b - a)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pages, pa.int64()), pa.array(talls, pa.int64())], [*names, "page", "too_tall"])

    def run(batches):
        held = None  # the rows of the last key so far
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            begun = max(i for i, n in enumerate(batch.column("_i").to_pylist()) if n == 1)
            if begun:
                yield fill(batch.slice(0, begun))
            held = batch.slice(begun)
        if held is not None:
            yield fill(held)

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return together.mapInArrow(run, f"{kinds}, page long, too_tall long")


def _by_pointers(df: DataFrame, key: str, order: list[str], height: str, room: float, first_room: float | None, gap: float, cap: int | None, forced: str | None) -> DataFrame:
    """paginate for any keys and heights."""
    units = lambda x: F.round(x * UNIT).cast("long")
    whole, space = Window.partitionBy(key).orderBy(*order), round(gap * UNIT)
    before = F.sum(units(F.coalesce(height, F.lit(0.0))) + space).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - units(F.coalesce(height, F.lit(0.0))) - space
    breaks = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = df.withColumn("_i", F.row_number().over(whole).cast("long") - 1).withColumn("_h", units(F.coalesce(height, F.lit(0.0)))).withColumn("_before", before).withColumn("_forced", breaks & (F.col("_i") > 0))
    rows = _cut(rows)
    limit = F.when(F.col("_i") == 0, round((room if first_room is None else first_room) * UNIT)).otherwise(round(room * UNIT))
    # a row fits on the page that began at row i if its own sum is at most what was before i and the limit
    sums = rows.select(key, (F.col("_before") + F.col("_h")).alias("_at"), F.lit(0).alias("_asks"), "_i", F.lit(None).cast("boolean").alias("_forced"))
    asks = rows.select(key, (F.col("_before") + limit).alias("_at"), F.lit(1).alias("_asks"), "_i", "_forced")
    fits = F.max(F.when(F.col("_asks") == 0, F.col("_i"))).over(Window.partitionBy(key).orderBy("_at", "_asks", "_i").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.unionByName(asks).withColumn("_fits", fits).filter("_asks = 1").drop("_at", "_asks")
    ahead = Window.partitionBy(key).orderBy("_i").rowsBetween(1, Window.unboundedFollowing)
    stop = F.least(F.greatest(F.coalesce("_fits", F.lit(-1)), F.col("_i")) + 1, F.min(F.when(F.col("_forced"), F.col("_i"))).over(ahead), *([F.col("_i") + cap] if cap else []))
    pointers = ends.withColumn("_to", stop).join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")))
    jump = _cut(pointers.filter("_to < _n").select(F.col(key).alias("_k"), "_i", "_to"))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        on = jump.select(F.col("_k").alias("_l"), F.col("_i").alias("_to"), F.col("_to").alias("_on"))
        jump = _cut(jump.join(on, (jump["_k"].eqNullSafe(on["_l"])) & (jump["_to"] == on["_to"])).select("_k", "_i", F.col("_on").alias("_to")))
    starts = _cut(rows.filter("_i = 0").select(F.col(key).alias("_k"), "_i"))
    for jump in reversed(jumps):
        at = starts.select(F.col("_k").alias("_l"), F.col("_i").alias("_j"))
        further = jump.join(at, jump["_k"].eqNullSafe(at["_l"]) & (jump["_i"] == at["_j"])).select("_k", F.col("_to").alias("_i"))
        old, starts = starts, _cut(starts.unionByName(further).distinct())
        _drop(old)
    marked = rows.join(starts.select("_k", F.col("_i").alias("_j"), F.lit(True).alias("_starts")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_i") == F.col("_j")), "left")
    tall = F.min(F.when(F.col("_starts") & (F.col("_h") > limit), F.col("_i"))).over(Window.partitionBy(key))
    page = F.count("_starts").over(Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("too_tall", tall).withColumn("page", F.when(F.col("too_tall").isNull(), page))
    return out.select(*df.columns, "page", "too_tall")
