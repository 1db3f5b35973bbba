"""Text and label functions on columns. Folding is a fixed table, so other engines can follow it exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the plain letters that they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"
#: Ligatures, spelled out before marks go.
LIGATURES = (("æ", "ae"), ("œ", "oe"), ("ß", "ss"))


def fold(c: Column) -> Column:
    """Lower case without marks and ligatures."""
    c = F.lower(c)
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, MARKED, PLAIN)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def condense(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z]", "")


def token_set(c: Column, stopwords: list[str]) -> Column:
    """Distinct folded words of two letters or more that are no stopwords, sorted."""
    words = F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0)))
    return F.array_sort(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords)))


def coverage(a: Column, b: Column) -> Column:
    """Share of the tokens of a that b has; 0 where a has none."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def strip_markup(c: Column) -> Column:
    """Scripts, styles, comments and tags removed, common entities decoded, white space folded."""
    c = F.regexp_replace(c, r"(?s)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def to_roman(n: Column) -> Column:
    """The Roman numeral of a number from 1 to 3999."""
    digit = lambda at, one, five, ten: F.element_at(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), (F.floor(n / at) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))


def roman_value(c: Column) -> Column:
    """The number that a Roman numeral writes: a letter before a greater one counts against it."""
    value = lambda x: F.element_at(F.create_map(*[F.lit(v) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in pair]), x)
    letters = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), value)
    return F.aggregate(letters, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, x: F.struct((s["sum"] + x - F.when(s["last"] < x, 2 * s["last"]).otherwise(0)).alias("sum"), x.alias("last")), lambda s: s["sum"])
