"""Scores in XML as events: measures, layers and notes with exact lengths; documents that declare anything of their own are refused."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

OUT = "measure string, layer string, place long, pitch string, num long, den long, dots long, error string"
#: Elements that last, and those that hold others.
LASTING, TUPLET = {"note", "rest", "chord", "space"}, "tuplet"


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _number(e, name: str, default: str, least: int) -> int | None:
    """A whole-number attribute, None where it is none or below `least`; lengths of more than a thousand dots or parts are none."""
    value = e.get(name, default)
    return int(value) if value.isascii() and value.isdigit() and len(value) <= 3 and int(value) >= least else None


def events_of(text: str) -> list[tuple]:
    """(measure, layer, place, pitch, num, den, dots, error): the lasting elements of each layer in order; one row with the error where the text is refused. An element whose
    length, or that of a tuplet around it, is no number is a row with an error of its own."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return [(None, None, None, None, None, None, None, "declares entities")]
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        return [(None, None, None, None, None, None, None, f"no XML: {str(e).partition(':')[0]}")]
    out = []
    for measure in (e for e in root.iter() if _name(e) == "measure"):
        for layer in (e for e in measure.iter() if _name(e) == "layer"):
            place, stack = 0, [(e, Fraction(1)) for e in reversed(layer)]
            while stack:
                e, ratio = stack.pop()
                if _name(e) == TUPLET:
                    base, parts = _number(e, "numbase", "2", 1), _number(e, "num", "3", 1)
                    ratio = ratio * Fraction(base, parts) if ratio and base and parts else None
                if _name(e) not in LASTING:
                    stack += [(x, ratio) for x in reversed(e)]
                    continue
                dots, dur = _number(e, "dots", "0", 0), _number(e, "dur", "", 1)
                error = "bad tuplet" if ratio is None else "bad dots" if dots is None or dots > 8 else None if dur else "no length"
                length = None if error else Fraction(1, dur) * (2 - Fraction(1, 2**dots)) * ratio
                pitch = _name(e) if _name(e) != "note" else f"{e.get('pname', '?')}{e.get('oct', '')}"
                out.append((measure.get("n"), layer.get("n"), place, pitch, length and length.numerator, length and length.denominator, dots, error))
                place += 1
    return out


def score_events(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key and the columns of events_of; a null text has no rows."""
    kind = to_arrow_type(df.schema[key].dataType)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches):
        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds))], [key, *names])

        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, *e) for e in events_of(text)] if text is not None else []
                if len(rows) > 50_000:
                    yield given(rows)
                    rows = []
            yield given(rows)

    return df.select(key, xml).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {OUT}")
