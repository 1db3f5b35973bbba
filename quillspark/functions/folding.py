"""Folding by Unicode decomposition, and words of headings with damaged numerals, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import lazy
from .text import LIGATURES

#: Words that carry no meaning in headings, and ordinals with their numerals.
STOPWORDS = ["in", "et", "de", "ad", "pro", "the", "of", "a", "cum", "s", "ss"]
ORDINALS = {"prima": "i", "secunda": "ii", "tertia": "iii", "quarta": "iv", "quinta": "v", "sexta": "vi"}
#: A numeral of at most a few hundred, without a look-ahead, so that other engines take it too; it also fits the empty string.
NUMERAL = "^(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
#: What scanners read for the i of a numeral.
DAMAGED, MENDED = "l1|!/", "iiiii"


@lazy("string")
def decomposed(c: pd.Series) -> pd.Series:
    """Compatibility decomposition without the combining marks."""
    return c.map(lambda x: x if x is None or x.isascii() else "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)))


def fold_nfkd(c: Column) -> Column:
    """Lower case, ligatures spelled out, marks off, compatibility forms plain; null stays null."""
    for a, b in LIGATURES[:2]:
        c = F.replace(F.replace(c, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b))
    return F.lower(decomposed(c))


def is_numeral(c: Column) -> Column:
    return (c != "") & c.rlike(NUMERAL)


def numeral(n: int) -> str:
    """The numeral of a number below forty, in small letters."""
    return "x" * (n // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]


#: The numerals that are short enough to be mended: of up to five letters, without fifties, as their l is read for i.
SHORT = [x for x in map(numeral, range(1, 40)) if len(x) <= 5]


def mended_numeral(c: Column) -> Column:
    """A word is the short numeral that it reads as with all its damaged letters mended, where it has a sound letter too; any other word stays."""
    read = F.translate(c, DAMAGED, MENDED)
    return F.when((F.translate(c, DAMAGED, "") != "") & F.array_contains(F.array(*map(F.lit, SHORT)), read), read).otherwise(c)


def heading_words(folded: Column) -> Column:
    """The distinct words of a folded heading, sorted: numerals mended and kept, ordinals as numerals, other words of one letter and stopwords dropped."""
    meaning = F.create_map(*map(F.lit, (x for pair in [*ORDINALS.items(), *((w, "") for w in STOPWORDS)] for x in pair)))
    known = lambda w: F.coalesce(F.element_at(meaning, w), w)
    read = lambda w: F.when(is_numeral(mended_numeral(w)), mended_numeral(w)).otherwise(known(F.translate(w, "1|!/", "")))
    words = F.transform(F.regexp_extract_all(folded, F.lit("[a-z1|!/]+"), F.lit(0)), read)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) | is_numeral(w))))
