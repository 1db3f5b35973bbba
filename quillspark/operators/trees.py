"""JSON documents as leaves by pointer, and the differences of two of them, at any depth."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def _leaves(value) -> list[tuple[str, str]]:
    """Pointer and value (as compact JSON) of each leaf, in document order; empty objects and lists are leaves."""
    out, stack = [], [("", value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            stack += [(f"{at}/{i}", x) for i, x in reversed(list(enumerate(v)))]
        else:
            out.append((at, json.dumps(v, ensure_ascii=False, separators=(",", ":"))))
    return out


def _read(text: str) -> list[tuple[str, str]]:
    try:
        return _leaves(json.loads(text))
    except (ValueError, RecursionError):
        return [("!", json.dumps(text, ensure_ascii=False))]


def leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, pointer, value: a row for each leaf of the JSON text of each row. A null document has none; text that is no JSON, or is nested more deeply than
    the parser goes (some thousand levels), has one leaf with the pointer `!`."""
    kind = to_arrow_type(df.schema[key].dataType)

    def run(batches):
        for batch in batches:
            keys, pointers, values = [], [], []

            def given():
                return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(pointers, pa.string()), pa.array(values, pa.string())], [key, "pointer", "value"])

            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                found = _read(text)
                keys += [k] * len(found)
                pointers += [p for p, _ in found]
                values += [v for _, v in found]
                if len(keys) > 50_000:
                    yield given()
                    keys, pointers, values = [], [], []
            yield given()

    return df.select(key, document).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, pointer string, value string")


def tree_diff(before: DataFrame, after: DataFrame, key: str, document: str) -> DataFrame:
    """key, pointer, state (added, removed, changed), was, now of each leaf that differs; rows that only one side has differ in all leaves. Of a key that repeats, every row of one side
    is held against every row of the other.

    Documents meet by key, as texts; equal ones have no leaf that differs, and only the others are read, each pair in its task."""
    given = lambda df, name: df.filter(F.col(document).isNotNull()).groupBy(key).agg(F.collect_list(document).alias(name))
    one = (F.size("_was") == 1) & (F.size("_now") == 1)
    both = given(before, "_was").join(given(after, "_now"), key, "full_outer").filter(~F.coalesce(one & (F.get("_was", F.lit(0)) == F.get("_now", F.lit(0))), F.lit(False)))
    kind = to_arrow_type(before.schema[key].dataType)
    names = [key, "pointer", "was", "now"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for k, *sides in zip(*(batch.column(c).to_pylist() for c in (key, "_was", "_now")), strict=True):
                was, now = ({}, {})
                for found, texts in zip((was, now), sides, strict=True):
                    for text in texts or ():
                        for pointer, value in _read(text):
                            found.setdefault(pointer, []).append(value)
                for pointer in {**was, **now}:
                    for a in was.get(pointer, (None,)):
                        for b in now.get(pointer, (None,)):
                            if a != b:
                                for column, x in zip(out, (k, pointer, a, b), strict=True):
                                    column.append(x)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(c, pa.string()) for c in out[1:])], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(c, pa.string()) for c in out[1:])], names)

    found = both.select(key, "_was", "_now").mapInArrow(run, f"`{key}` {dict(before.dtypes)[key]}, pointer string, was string, now string")
    return found.select(key, "pointer", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("state"), "was", "now")
