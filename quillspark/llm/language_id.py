"""Language of texts: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty labels spans.

A model is learned from labelled rows: log-probabilities of the character runs of one to three letters in padded words, by
language, and the scripts that each language uses. A word is scored once per Python worker and looked up after that.
All texts of a batch go through Viterbi in step, so a step costs a few numpy calls for all of them.

Defined results: a null text, a text without letters, or a table with nothing to learn from gives `und` with score 0;
repeated rows are each judged; other columns are never looked at. The score is the share of the text's letters in spans
of the language that is returned (ties: the language first in sorted order). Letters of a script that no learned language uses
count as letters, but for no language, so a text without others has score 0.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_WORD_BYTES, batches_of, kept

#: Learning takes about so many labelled documents at most, chosen by a hash of doc_id; every run of letters in them is kept.
SAMPLE_DOCUMENTS = 4000
#: Bytes of text that are judged at once, and words that a Python worker keeps the scores of.
AT_ONCE, MOST_WORDS = 1_000_000, 300_000
#: In natural logarithms: what a change of language costs, and what a word costs in a language that does not use its script.
SWITCH, WRONG_SCRIPT = 9.0, 12.0

#: First and last code point of the letters of each script, from the Unicode blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x323AF),
]
#: Scripts written without spaces: each letter counts as a word.
UNSPACED = {"han", "kana", "thai"}
ASCII_WORDS = re.compile(r"[a-z]+")
#: Letters and the marks that combine with them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNSPACED_RUN = re.compile("[฀-๿぀-ヿ㐀-鿿\U00020000-\U000323af]")


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def words_in(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    words = LETTERS.findall(text.lower())
    if not UNSPACED_RUN.search(text):
        return words
    out = []
    for w in words:
        out += list(w) if UNSPACED_RUN.search(w) else [w]
    return out


def runs_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1) if padded[i : i + k] != " "]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> dict:
    """The model of the labelled rows of docs: counted by Spark tasks, summed by a shuffle; what returns is bounded by the sample."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))

    def count(batches):
        runs, scripts, words = Counter(), Counter(), Counter()
        for whole in batches:
            for batch in batches_of(whole, 0, AT_ONCE):
                for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for w in words_in(text):
                        words[lang, w] += 1
                for (lang, w), k in words.items():
                    scripts[lang, script_of(w)] += k
                    for run in runs_of(w):
                        runs[lang, run] += k
                words.clear()
        found = [(*k, "run", v) for k, v in runs.items()] + [(*k, "script", v) for k, v in scripts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "what", "kind", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, what string, kind string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n"))
    found = counts.select("lang", "kind", "what", "n").collect()
    langs = sorted({r["lang"] for r in found if r["kind"] == "run"})
    place = {x: i for i, x in enumerate(langs)}
    scripts: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    totals = np.zeros((len(langs), 4))
    for r in found:
        into = scripts if r["kind"] == "script" else grams
        into.setdefault(r["what"], np.zeros(len(langs)))[place[r["lang"]]] += r["n"]
        if r["kind"] == "run":
            totals[place[r["lang"]], len(r["what"])] += r["n"]
    kinds = Counter(len(g) for g in grams)
    logs = {g: np.log((n + 0.5) / (totals[:, len(g)] + 0.5 * kinds[len(g)] + 1)).astype(np.float32) for g, n in grams.items()}
    unseen = {k: np.log(0.5 / (totals[:, k] + 0.5 * kinds[k] + 1)).astype(np.float32) if langs else None for k in (1, 2, 3)}
    used = np.sum(list(scripts.values()), axis=0) if scripts else None
    return {"name": uuid.uuid4().hex, "langs": langs, "runs": logs, "unseen": unseen, "scripts": {s: (n > 0) & (n >= 0.01 * used) for s, n in scripts.items()}}


def script_table() -> tuple[np.ndarray, np.ndarray, list[str]]:
    order = sorted((a, b, name) for name, a, b in SCRIPTS)
    return np.array([x[0] for x in order]), np.array([x[1] for x in order]), [x[2] for x in order]


class Scorer:
    """Per-word scores of a model, kept for the words that were seen. A word's runs are looked up as numbers in sorted tables, for many new words at once."""

    def __init__(self, model: dict, most: int = MOST_WORDS):
        self.model, self.most, self.langs = model, most, model["langs"]
        n = len(self.langs)
        self.tables = {}
        for k in (2, 3) if n else ():
            grams = sorted((tuple(map(ord, g)), g) for g in model["runs"] if len(g) == k)
            keys = np.array([sum(c << 21 * (k - 1 - i) for i, c in enumerate(g)) for g, _ in grams], np.uint64)
            # then the row of unseen runs, and one for what is no run of a word
            rows = [model["runs"][g] for _, g in grams] + [model["unseen"][k], np.zeros(n)]
            self.tables[k] = keys, np.array(rows, np.float32)
        self.lows, self.highs, names = script_table()
        none = np.zeros(n, bool)
        self.fits = np.array([model["scripts"].get(x, none) for x in [*names, "other"]])  # scripts by languages
        self.clear()

    def clear(self) -> None:
        self.size, self.known, self.rows = 0, {}, np.zeros((1 << 14, max(1, len(self.langs))), np.float32)
        self.learned = np.zeros(len(self.rows), bool)  # whether some language uses the word's script

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the log-likelihoods of its runs, summed, narrowed by script and less the best one: long words speak louder; and whether its script is known."""
        code = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        up = np.uint64(21)
        two = (code[:-1] << up) | code[1:]
        three = (two[:-1] << up) | code[2:]
        total = np.zeros((len(words), len(self.langs)), np.float32)
        for k, grams in ((2, two), (3, three)):
            keys, rows = self.tables[k]
            at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
            at = np.where(keys[at] == grams, at, len(keys)) if len(keys) else np.zeros(len(grams), np.int64)
            if k == 3:
                at[ends[:-1] - 1] = len(keys) + 1  # over the end of a word
            total += np.add.reduceat(rows[at], starts, axis=0)
        first = code[starts + 1].astype(np.int64)
        script = np.searchsorted(self.lows, first, side="right") - 1
        fits = self.fits[np.where((script >= 0) & (first <= self.highs[np.maximum(script, 0)]), script, len(self.fits) - 1)]
        known = fits.any(axis=1)
        total = np.where(fits | ~known[:, None], total, total.max(axis=1, keepdims=True) - WRONG_SCRIPT)
        total[~known] = 0
        return 0.5 * (total - total.max(axis=1, keepdims=True)), known

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in rows and learned."""
        if len(self.known) > self.most or self.size > MOST_WORD_BYTES:
            self.clear()
        known = self.known
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if not missing:
            return at
        new = list(dict.fromkeys([words[i] for i in missing]))
        while len(known) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.learned = np.concatenate([self.learned, np.zeros_like(self.learned)])
        part = max(1, 400_000 // len(self.langs))
        for i in range(0, len(new), part):
            some = new[i : i + part]
            to = slice(len(known), len(known) + len(some))
            self.rows[to], self.learned[to] = self.score(some)
            known.update(zip(some, range(to.start, to.stop), strict=True))
            self.size += sum(map(len, some))
        at[missing] = [known[words[i]] for i in missing]
        return at


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word of each text; texts lie one after another in scores."""
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    out = np.zeros(len(scores), kind)
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
    if not len(size) or not size[0]:
        return out
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    back, value = np.zeros(scores.shape, kind), np.zeros((len(size), scores.shape[1]), np.float32)
    for t in range(size[0]):
        k = active[t]
        at = start[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(1)
            floor = v[np.arange(k), best] - switch
            moved = v < floor[:, None]
            back[at] = np.where(moved, best[:, None], np.arange(v.shape[1]))
            v = np.maximum(v, floor[:, None])
        value[:k] = v + scores[at]
    state = value.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return out


def scorer_of(model: dict) -> Scorer:
    """The scorer of this Python worker."""
    return kept(("language", model["name"]), lambda: Scorer(model))


def labelled(texts: list[str | None], scorer: Scorer) -> tuple[list[str], list[float], list[list[tuple[str, int]]]]:
    """For each text: its language, the score, and its spans as (language, words)."""
    lists = [words_in(t) if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    n = len(scorer.langs)
    if not n or not sizes.sum():
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    words = [w for x in lists for w in x]
    at = scorer.places(words)
    path = viterbi(scorer.rows[at], sizes)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), sizes)
    share = np.bincount(text * n + path, letters * scorer.learned[at], len(texts) * n).reshape(-1, n)
    total, best = np.bincount(text, letters, len(texts)), share.argmax(1)
    langs = [scorer.langs[b] if s else "und" for b, s in zip(best.tolist(), sizes.tolist(), strict=True)]
    score = np.where(total > 0, share[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
    cut = np.flatnonzero((np.diff(path) != 0) | (np.diff(text) != 0)) + 1 if len(path) else np.zeros(0, np.int64)
    first = np.concatenate([[0], cut])
    spans: list[list[tuple[str, int]]] = [[] for _ in texts]
    for a, b in zip(first.tolist(), [*first.tolist()[1:], len(path)], strict=True):
        spans[text[a]].append((scorer.langs[path[a]], b - a))
    return langs, score.tolist(), spans


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (like `en:120,fr:31`, in words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def judge(batches):
        scorer = scorer_of(shared.value)
        for whole in batches:
            for batch in batches_of(whole, 1, AT_ONCE):
                langs, score, spans = labelled(batch.column(1).to_pylist(), scorer)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array([",".join(f"{a}:{n}" for a, n in x) for x in spans], pa.string())], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id long, lang_pred string, score double, spans string")


def keep_known(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of `least` or more; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches):
        scorer = scorer_of(shared.value)
        for whole in batches:
            for batch in batches_of(whole, at, AT_ONCE):
                langs, score, _ = labelled(batch.column(at).to_pylist(), scorer)
                yield batch.filter(pa.array([a != "und" and s >= least for a, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
