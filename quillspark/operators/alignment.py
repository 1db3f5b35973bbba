"""Expected texts aligned to printed items in order, and boxes of words read as table rows."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import by
from .state import fold_rows


def align(expected: DataFrame, printed: DataFrame, key: str, number: str, text: str, place: str, folds: list) -> DataFrame:
    """Each expected text of a key, in order of `number`, goes to the first printed item of the same text behind the place of the one before; texts are the same under the first of the
    functions `folds` that finds an item there. A text that was placed before and is not printed again stands where it stood (a repeated set is printed once).

    Returned: key, number, place (null where none is found) and how: the fold's number from 0, `again` or `missing`."""
    rows = expected.select(key, number, text)
    for i, fold in enumerate(folds):
        at = printed.groupBy(F.col(key), fold(F.col(text)).alias("_f")).agg(F.array_sort(F.collect_set(place)).alias(f"_at{i}"))
        rows = rows.withColumn("_f", fold(F.col(text))).join(at, [key, "_f"], "left").drop("_f")

    def step(state, row):
        last, memo = state
        name, *places = row
        for i, found in enumerate(places):
            k = 0 if last is None else bisect_right(found or (), last)
            if found and k < len(found):
                memo[name] = found[k]
                return (found[k], memo), {"place": found[k], "how": str(i)}
        if name in memo:
            return state, {"place": memo[name], "how": "again"}
        return state, {"place": None, "how": "missing"}

    kind = dict(printed.dtypes)[place]
    out = fold_rows(rows, key, [number], [text, *(f"_at{i}" for i in range(len(folds)))], [key, number], "_to", f"struct<place: {kind}, how: string>", lambda: (None, {}), step)
    return out.select(key, number, F.col("_to.place").alias(place), F.col("_to.how").alias("how"))


def table_rows(words: DataFrame, page: str, columns: int, width: Column, near: float, heading: Column) -> DataFrame:
    """Words in boxes (page, x0, y0, x1, y1, text) as rows in reading order: bands between the headings that cross columns, in them columns, in these lines.

    A word's column is that of its middle among `columns` of equal share of `width`; words of a column whose tops lie at most `near` below the one above are one line.
    A line that is a heading (a condition on column, line text `text` and `x0`, `x1` of the line) names the section of all lines behind it, over pages too."""
    middle = (F.col("x0") + F.col("x1")) / 2
    crossing = F.col("x1") - F.col("x0") > width / columns
    w = words.withColumn("_column", F.when(crossing, -1).otherwise(F.least(F.floor(middle / width * columns), F.lit(columns - 1))).cast("int"))
    # bands: how many words across columns stand above a word. They are counted by height first, so that a page's words are never one task: of one height, words across come one by one
    # and before the others
    across = F.count_if(F.col("_column") == -1)
    heights = w.groupBy(page, "y0").agg(across.alias("_across")).withColumn("_above", F.sum("_across").over(by([page], "y0").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_across"))
    heights = heights.filter("_above + _across > 0").select(F.col(page).alias("_p"), F.col("y0").alias("_y"), "_above", "_across")
    apart = w.filter("_column = -1").withColumn("_place", F.row_number().over(by([page, "y0"], "x0", "text")))
    w = apart.unionByName(w.filter("_column <> -1"), allowMissingColumns=True).join(heights, F.col(page).eqNullSafe(F.col("_p")) & F.col("y0").eqNullSafe(F.col("_y")), "left")
    w = w.withColumn("_band", F.coalesce(F.col("_above") + F.coalesce("_place", "_across"), F.lit(0)).cast("long")).drop("_p", "_y", "_above", "_across", "_place")
    inside = by([page, "_band", "_column"], "y0", "x0", "text")
    new = F.when(F.col("y0") - F.lag("y0").over(inside) <= near, 0).otherwise(1)
    w = w.withColumn("_new", new).withColumn("_line", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    lines = w.groupBy(page, "_band", "_column", "_line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"))
    lines = lines.withColumn("column", F.col("_column")).withColumn("_heading", heading)
    # sections carry over pages: the last heading of each page first, then within the page
    page_order = by([page], "_band", "_column", "_line")
    ends = lines.filter("_heading").groupBy(page).agg(F.max_by("text", F.struct("_band", "_column", "_line")).alias("_ends"))
    pages = lines.select(page).distinct().join(ends, page, "left").withColumn("_before", F.last("_ends", ignorenulls=True).over(Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)))  # a row a page
    own = F.last(F.when(F.col("_heading"), F.col("text")), ignorenulls=True).over(page_order.rowsBetween(Window.unboundedPreceding, 0))
    carried = lines.withColumn("_own", own).withColumn("row", F.row_number().over(page_order).cast("long")).join(pages.select(page, "_before"), page)
    return carried.filter("not _heading").select(page, "row", "column", F.coalesce("_own", "_before").alias("section"), "text")
