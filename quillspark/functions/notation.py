"""Chant notation in letters as steps: clefs, notes, divisions, and what a reader should look at."""

from __future__ import annotations

import re
from bisect import bisect

import pandas as pd

from .similarity import lazy

#: Fixed values of the notation: notes in parentheses with words between them; a clef by letter, flat and line; a note letter with what follows it, and other signs.
PIECE = re.compile(r"\((?P<notes>[^()]*)\)|(?P<words>[^()]+)|(?P<loose>[()])")
CLEF = re.compile(r"([cf])(b?)([1-4])")
SIGN = re.compile(r"(?P<accidental>[a-mA-M][xy#])|(?P<custos>[a-mA-M]\+)|(?P<note>[a-mA-M](?:v{1,3}|V{1,3}|s{1,3})?)|(?P<mark>[\s0-9./!@'_,:;`~<>\-oOqwWrRzZ]+)|(?P<unknown>.)", re.DOTALL)
DIVISION = "::"
#: The letters on the lines of the staff, and how far the clef's own note is above do.
LINES, ABOVE_DO = "dfhj", {"c": 0, "f": 3}
#: What makes a reading unsure, in the order in which it is told.
FLAGS = ["no clef", "accidental", "unknown notation", "loose parentheses", "text without notes"]
SCHEMA = "struct<steps: array<int>, phrases: array<int>, words: string, flags: array<string>>"


def read(text: str) -> dict:
    """Steps above the clef's do (an octave is 7), each with the number of its phrase, the words that are sung, and flags.

    The text is one table of pieces. Where clefs and divisions stand in it tells, by search, which clef a note is under and which phrase it is in."""
    pieces = [(m.lastgroup, m[m.lastgroup]) for m in PIECE.finditer(re.sub(r"%[^\n]*", "", text.rpartition("%%")[2]))]
    groups = {i: re.sub(r"\[[^\]]*\]", "", x).strip() for i, (kind, x) in enumerate(pieces) if kind == "notes"}
    clefs = [(i, m) for i, x in groups.items() if (m := CLEF.fullmatch(x))]
    divisions = [i for i, x in groups.items() if x == DIVISION]
    at, do = [i for i, _ in clefs], [ord("j"), *(ord(LINES[int(m[3]) - 1]) - ABOVE_DO[m[1]] for _, m in clefs)]
    signs = [(i, s.lastgroup, s[0]) for i, x in groups.items() if x != DIVISION and i not in at for s in SIGN.finditer(x)]
    notes = [(i, ord(s[0].lower()), max(1, len(s) - 1)) for i, kind, s in signs if kind == "note"]
    sung = [(ord_ - do[bisect(at, i)], bisect(divisions, i)) for i, ord_, times in notes for _ in range(times)]
    kinds, last = {kind for _, kind, _ in signs}, max(groups, default=-1)
    # words are sung to the notes right behind them
    words = "".join(x for (kind, x), (after, _) in zip(pieces, [*pieces[1:], (None, None)], strict=False) if kind == "words" and after == "notes")
    found = {
        "no clef": any(not bisect(at, i) for i, _, _ in notes),
        "accidental": "accidental" in kinds or any(m[2] for _, m in clefs),
        "unknown notation": "unknown" in kinds,
        "loose parentheses": any(kind == "loose" for kind, _ in pieces),
        "text without notes": any(kind == "words" and x.strip() for kind, x in pieces[last + 1 :]),
    }
    return {"steps": [s for s, _ in sung], "phrases": [p for _, p in sung], "words": " ".join(re.sub(r"<[^>]*>", "", words).split()), "flags": [f for f in FLAGS if found[f]]}


@lazy(SCHEMA)
def read_notation(c: pd.Series) -> pd.DataFrame:
    """Steps, phrases, words and flags of each text; a null text has no steps and the flag `empty`."""
    rows = [read(x) if x else {"steps": [], "phrases": [], "words": "", "flags": ["empty"]} for x in c]
    return pd.DataFrame(rows, columns=["steps", "phrases", "words", "flags"])
