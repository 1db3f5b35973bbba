"""Secrets in texts: fixed patterns, and strings in a sensitive context that a primed zstandard can't compress.

The patterns give the kinds assign, access and hex. The method adds the kind novel: a long token close to a sensitive word, on
either side, whose marginal compressed bytes (context with it, less context without it, by zstandard primed with a dictionary of
identifiers) are as many as random characters of its alphabet take. Spans are in code points, ends exclusive, ordered by start, then kind as
listed; novel spans never overlap those of the patterns.

Defined results: a null text is an empty one, without spans; repeated rows are each scanned; other columns are ignored; an empty table gives an empty one.
Most texts are left after a few substring searches, so their cost is that of reading them. Very long texts and tokens take time in proportion to their length: sensitive words and
tokens are walked together once, and a token is measured once, in stretches.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, forget, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
LEAST_GROUP, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words whose neighbourhood is sensitive, and identifiers that fill the compressor's dictionary.
SENSITIVE = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"api key", b"access key", b"access_key", b"private_key", b"private key", b"credential", b"bearer", b"authorization", b"passphrase")
IDENTIFIERS = b" ".join(
    (
        b"abstract access account address api_key apikey application argument array assert async authorization await base64",
        b"bearer boolean break bucket buffer callback case catch certificate char class client client_id client_secret config connection const",
        b"continue credential database debug default define delete description double else encode endpoint enum environment error except export",
        b"extends false field file final finally float for format from function global hash header host http https identifier if implements import in",
        b"include index input int integer interface is json key lambda length library list localhost long main map method module name namespace new none null",
        b"number object option output override package parameter parent pass passphrase password path pattern port private private_key process protected public query raise read",
        b"region register request response result return role secret self server service session short signature sizeof static status string struct super switch",
        b"system table template this thread throw timeout token true try type undefined union unsigned update url user username utf-8 value variable version",
        b"virtual void volatile while window with write xml yaml yield 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    )
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE_TEXT = re.compile("|".join(re.escape(w.decode()) for w in SENSITIVE), re.I | re.A)
#: Characters of a token that are measured at once.
MEASURED = 4096
#: Code points between the end of the sensitive word and the candidate on either side, code points of context, and the marginal bytes a character:
#: the entropy of the token's alphabet times SURPRISE, and FIXED more for a token of one character (what zstandard spends on any token), NOVELTY at most.
REACH, CONTEXT, NOVELTY, SURPRISE, FIXED = 48, 256, 0.8, 0.95, 4.0
#: The characters of candidates by kind, and the marks among them.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=-")
HEX_TOKEN = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)")
HEXLIKE = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str, raw: bytes, low: bytes) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail its condition dropped afterwards."""
    out: list[Span] = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_GROUP]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in raw.translate(HEXLIKE):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(out)


class Novelty:
    """Marginal compressed size against a primed dictionary."""

    def __init__(self):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str, a: int, b: int) -> float:
        """Marginal bytes a character of text[a:b], by stretches of MEASURED characters, each in its context."""
        more = 0
        for x in range(a, b, MEASURED):
            y = min(b, x + MEASURED)
            before, after = text[max(0, x - CONTEXT) : x].encode(), text[y : y + CONTEXT].encode()
            more += len(self.press.compress(before + text[x:y].encode() + after)) - len(self.press.compress(before + after))
        return more / (b - a)


def least_novelty(token: str) -> float:
    """The marginal bytes a character from which a token counts as random, by the kinds of characters in it; marks alone count as the whole alphabet."""
    size = 16 if HEX_TOKEN.fullmatch(token) else sum(len(x) for x in ALPHABETS if any(c in x for c in token))
    if size <= len(ALPHABETS[-1]):
        size = sum(map(len, ALPHABETS))
    return min(NOVELTY, (SURPRISE + FIXED / len(token)) * math.log2(size) / 8)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """The long tokens within REACH of a sensitive word, each once, from left to right: a token is a run of its characters between two sensitive words, which cut it."""
    before = None
    for a, b in [*(m.span() for m in SENSITIVE_TEXT.finditer(text)), (None, None)]:
        for m in CANDIDATE.finditer(text, before or 0, len(text) if a is None else a):
            if before is not None and m.start() - before <= REACH or a is not None and a - m.end() <= REACH:
                yield m.span()
        before = b


class Taken:
    """Stretches of a text that are spans already, as sorted stretches that do not meet: each question is a binary search."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b


def novel_spans(text: str, low: bytes, base: list[Span], novelty: Novelty) -> list[Span]:
    if not any(w in low for w in SENSITIVE):
        return []
    taken = Taken((a, b) for a, _, b in base)
    return [(a, 3, b) for a, b in candidates(text) if not taken.meets(a, b) and novelty(text, a, b) >= least_novelty(text[a:b])]


def scanned(raw: bytes | None, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """The pattern spans, and all spans."""
    raw = raw or b""
    low, text = raw.lower(), raw.decode()
    base = base_spans(text, raw, low)
    return base, sorted(base + novel_spans(text, low, base, novelty))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of each kind, base (the pattern spans) and spans (all) of every row."""

    def find(batches):
        novelty = Novelty()
        for whole in batches:
            for batch in batches_of(whole, 1):
                found = [scanned(t, novelty) for t in texts_of(batch.column(1))]
                counts = [[sum(k == kind for _, k, _ in all_) for _, all_ in found] for kind in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([written(b) for b, _ in found], pa.string()), pa.array([written(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """text without its secrets; of assignments the name stays. Overlapping spans are one."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if kind == 0 and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced in the text, and the size column, where there is one, set to the new length where the text changed; nulls stay null."""
    at, size = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def clean(batches):
        forget()
        novelty = Novelty()
        for whole in batches:
            for batch in batches_of(whole, at):
                texts, sizes = batch.column(at).to_pylist(), batch.column(size).to_pylist() if size is not None else None
                for i, raw in enumerate(texts_of(batch.column(at))):
                    if raw and (spans := scanned(raw, novelty)[1]):
                        texts[i] = redacted(texts[i], spans)
                        if sizes:
                            sizes[i] = len(texts[i])
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
