"""Sequence similarity that SQL has no function for, as Arrow UDFs: matching-block ratios and greedy word matching."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy(returns: str):
    """A pandas UDF that is made at each call, so that importing this module needs no session."""

    def over(f):
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return over


@lazy("double")
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, rounded to three places; the order of the two matters. Null where either is null."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio(), 3) for x, y in zip(a, b, strict=True)], dtype="Float64")


@lazy("double")
def word_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of words of a that find a word of b of their own with a ratio of 0.75 or more, each taking the best that is left; numbers must be equal."""

    def one(x, y):
        if x is None or y is None:
            return None
        left, hits, words = y.split(), 0.0, x.split()
        for w in words:
            scores = [(1.0 if w == v else 0.0) if w.isdigit() or v.isdigit() else SequenceMatcher(None, w, v).ratio() for v in left]
            best = max(range(len(left)), key=lambda i: (scores[i], -i), default=None)
            if best is not None and scores[best] >= 0.75:
                hits += scores[best]
                left.pop(best)
        return round(hits / len(words), 3) if words else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


@lazy("string")
def difference_kind(a: pd.Series, b: pd.Series) -> pd.Series:
    """equal, missing, extra, changed or mixed: the kinds of edits that turn a into b, by their matching blocks."""

    def one(x, y):
        kinds = {op for op, *_ in SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes()} - {"equal"}
        return "equal" if not kinds else {"delete": "missing", "insert": "extra", "replace": "changed"}[kinds.pop()] if len(kinds) == 1 else "mixed"

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@lazy("double")
def sequence_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of a's melody that b has in order: both are arrays of steps, compared by the intervals between them, so that transposition is no difference. Null where either is
    null, 0 where either has no interval."""

    def one(x, y):
        if x is None or y is None:
            return None
        p, q = ([v - u for u, v in zip(s, s[1:], strict=False)] for s in (list(x), list(y)))
        if not p or not q:
            return 0.0
        return round(sum(m.size for m in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks()) / len(p), 3)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


@lazy("double")
def text_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of a's letters that b has in order; null where either is null or empty."""
    one = lambda x, y: round(sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / len(x), 3) if x and y else None
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


@lazy("boolean")
def lies_inside(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the first twenty characters of a, at least eight, stand in b but for a fifth, as one stretch. False where either is null."""

    def one(x, y):
        head = (x or "")[:20]
        if len(head) < 8 or not y:
            return False
        return SequenceMatcher(None, head, y, autojunk=False).find_longest_match(0, len(head), 0, len(y)).size >= 0.8 * len(head)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])
