"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has an edge for each piece that fits and, for a character that is no piece, its UTF-8 bytes as byte pieces. Forward
Viterbi gives the best score of each prefix; a backward A* search from the end takes it as an exact heuristic, so segmentations leave
its queue from the best down. No piece spans the space before a word or a character that only bytes can write, so a text's lattice is a row of small
ones: these are searched once per Python worker and looked up after that, and a text's N best are merged from the words
whose alternatives cost least.

Scores are the model's (of a BPE model: minus the rank of the merge). Encoding follows the model's rules: a space is written U+2581, one is
set before the text. A literal U+2581 is written in bytes, so decoding gives back every text exactly.

Defined results: a null text is an empty one; an empty text has no pieces, score 0 and no alternatives; of equal scores the order is fixed by the
search, which goes on from the place nearest the start; repeated rows are each encoded; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, kept, texts_of

SPACE, BYTE_COST = "▁", 10.0
#: Characters that are looked up at once, and how many such windows a Python worker keeps.
NEAR, MOST_NEAR = 4, 60_000
#: Marks before which a word may be cut where the model has no piece that joins the two.
MARKS = '.,;:!?|$%&#*"()-'


def segments_of(vocabulary) -> re.Pattern:
    """A space run and its word (as far as a mark that no piece joins to it, or else the next space), a line end or tab, or spaces alone."""
    plain = [p.replace(SPACE, " ") for p in vocabulary]
    behind_all = "".join(c for c in MARKS if not any(re.search(rf"[A-Za-z0-9\u0080-\U0010ffff]{re.escape(c)}", p) for p in plain))
    behind_ascii = "".join(c for c in MARKS if not any(re.search(rf"[A-Za-z0-9]{re.escape(c)}", p) for p in plain))
    ends = [rf"[A-Za-z0-9\x80-\xff]+(?=[{re.escape(behind_all)} \n\t]|\Z)", rf"[A-Za-z0-9\x80-\xff]*[A-Za-z0-9](?=[{re.escape(behind_ascii)} ])", r"[^ \n\t]+"]
    return re.compile(rf" *(?:{'|'.join(ends)})|[\n\t]| +".encode())


#: Words that a worker's store holds, and the bytes of them for each.
MOST_WORDS, WORD_BYTES = 400_000, 40


class Pieces:
    """A model's pieces, and the words that were segmented with it; words met once go when it holds `most`."""

    def __init__(self, path: str, best: int = 3, most: int = MOST_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.best, self.most, self.most_bytes = best, most, most * WORD_BYTES
        n = model.get_piece_size()
        self.bytes_of, self.vocabulary, self.byte_ids = [b""] * n, {}, [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.vocabulary[piece] = (i, model.get_score(i))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or "\t" in p for p in self.vocabulary):
            raise ValueError("pieces span words; this model can't be searched by word")
        # the starts of pieces: what is no whole piece has None
        self.starting = {p[:k]: None for p in self.vocabulary for k in range(1, len(p))} | {p: (s, (i,)) for p, (i, s) in self.vocabulary.items()}
        self.segments = segments_of(self.vocabulary)
        self.byte_score = min((s for _, s in self.vocabulary.values() if s > -1e8), default=0.0) - BYTE_COST
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offsets, self.all_bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.size, self.known, self.n, self.held, self.near = 0, {}, 0, 0, {}
        # of word w the segmentation k, best first, lies in ids between starts[w * best + k] and the place after it
        self.starts, self.ids = np.zeros((1 << 14) * self.best + 1, np.int64), np.zeros(1 << 16, np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32)
        self.scores = np.zeros((1 << 14, self.best))  # the best's score, then what each further one costs
        self.counts = np.zeros(1 << 14, np.int64)  # how often each was met

    def begins(self, window: str) -> tuple[list[tuple[int, float, tuple[int, ...]]], bool, bool]:
        """The pieces at the start of NEAR characters (or fewer, at the end of a word) as (length, score, ids); whether one is of one character; whether longer ones may fit."""
        found, further = [], len(window) == NEAR
        for k in range(1, len(window) + 1):
            piece = self.starting.get(window[:k], 0)
            if piece:
                found.append((k, *piece))
            elif piece == 0:
                further = False
                break
        if len(self.near) >= MOST_NEAR:
            self.near.clear()
        out = self.near[window] = (found, bool(found) and found[0][0] == 1, further)
        return out

    def lattice(self, text: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each place the edges that end there as (start, score, ids), and the best score of each prefix. A space is U+2581 already, a literal one U+0000 marked below."""
        n, near, get = len(text), self.near, self.starting.get
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        forward = [0.0] + [-np.inf] * n
        for i in range(n):
            at, window = forward[i], text[i : i + NEAR]
            found, single, further = near.get(window) or self.begins(window)
            for k, score, ids in found:
                into[i + k].append((i, score, ids))
                if at + score > forward[i + k]:
                    forward[i + k] = at + score
            for j in range(i + NEAR + 1, n + 1) if further else ():
                longer = get(text[i:j], 0)
                if longer:
                    into[j].append((i, longer[0], longer[1]))
                    forward[j] = max(forward[j], at + longer[0])
                elif longer == 0:  # no piece starts like this
                    break
            if not single:
                raw = (SPACE if text[i] == LITERAL else text[i]).encode()
                into[i + 1].append((i, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
                forward[i + 1] = max(forward[i + 1], at + self.byte_score * len(raw))
        return into, forward

    def search(self, text: str, best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a text, best first: A* from the end. The heuristic is exact, so each open place stands for a segmentation
        of its own with that very score, and no more places need be open than segmentations are still wanted."""
        into, forward = self.lattice(text)
        opened, count, out = [(-forward[-1], len(text), 0, 0.0, ())], 0, []
        while opened and len(out) < best:
            total, at, _, behind, path = opened.pop(0)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-total, tuple(ids)))
                continue
            wanted = best - len(out)
            for start, score, ids in into[at]:
                score += behind
                total = -(forward[start] + score)
                if len(opened) >= wanted:
                    if total >= opened[-1][0]:
                        continue
                    opened.pop()
                count += 1
                bisect.insort(opened, (total, start, count, score, (ids, path)))
        return out

    def learn(self, words: list[bytes]) -> None:
        """Searches new words and writes what they have all at once."""
        ids, lengths, scores, best, none = [], [], [], self.best, [np.inf] * self.best
        for word in words:
            found = self.search(lattice_text(word), best)
            top = found[0][0]
            row = [top]
            for s, x in found:
                ids += x
                lengths.append(len(x))
                row.append(top - s)
            del row[1]
            lengths += [0] * (best - len(found))
            scores.append(row + none[len(found) :])
        n, held = self.n + len(words), self.held + len(ids)
        while held > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + 1 > len(self.scores):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.scores) * best, np.int64)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.ids[self.held : held] = ids
        self.starts[self.n * best + 1 : n * best + 1] = self.held + np.cumsum(lengths)
        self.scores[self.n : n] = scores
        self.counts[self.n : n] = 0
        self.known.update(zip(words, range(self.n, n), strict=True))
        self.size += sum(map(len, words))
        self.n, self.held = n, held

    def shrink(self) -> None:
        """Words that were met once since the last time go; of the others, the most frequent stay, half of what may be held."""
        words, counts, best = list(self.known), self.counts[: self.n].copy(), self.best
        stay = np.flatnonzero(counts > 1)
        if len(stay) > self.most // 2:
            stay = np.sort(stay[np.argpartition(-counts[stay], self.most // 2)[: self.most // 2]])
        segments = (stay[:, None] * best + np.arange(best)).reshape(-1)
        lengths = self.starts[segments + 1] - self.starts[segments]
        ends = np.cumsum(lengths)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[segments] - (ends - lengths), lengths)]
        scores = self.scores[stay]
        self.clear()
        if sum(len(words[i]) for i in stay.tolist()) > self.most_bytes // 2:
            return
        while len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        rows = len(self.scores)
        while len(stay) + 1 > rows:
            rows *= 2
        self.starts, self.counts, self.scores = np.zeros(rows * best + 1, np.int64), np.zeros(rows, np.int64), np.zeros((rows, best))
        self.ids[: len(ids)], self.starts[1 : len(segments) + 1], self.scores[: len(stay)] = ids, ends, scores
        self.known = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.n, self.held, self.size = len(stay), len(ids), sum(map(len, self.known))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[at * self.best]
        lengths = self.starts[at * self.best + 1] - first
        ends = np.cumsum(lengths)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)], lengths

    def changed(self, ids: np.ndarray, begins: np.ndarray, at: np.ndarray, choices: Choices) -> np.ndarray:
        """ids with some words' best segmentations replaced by other ones; words begin at begins, at are their numbers."""
        out, done = [], 0
        for word, k in sorted(choices):
            s = at[word] * self.best + k
            out += [ids[done : begins[word]], self.ids[self.starts[s] : self.starts[s + 1]]]
            done = begins[word + 1]
        return np.concatenate([*out, ids[done:]])

    def encode(self, texts: list[bytes | None]) -> list[tuple[list[np.ndarray], list[float]]]:
        """For each text the ids of its best segmentations, best first, and their scores; an empty text has one list without ids, and no score."""
        lists = [self.segments.findall(b" " + t) if t else [] for t in texts]
        words = list(chain.from_iterable(lists))
        if self.n > self.most or self.size > self.most_bytes:
            self.shrink()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys([words[i] for i in new])))
            at[new] = [self.known[words[i]] for i in new]
        met = np.bincount(at, minlength=1)
        self.counts[: len(met)] += met
        ids, lengths = self.gather(at)
        bound = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        scores, out = self.scores[at], []
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            first, found = begins[a], merged(scores[a:b])
            own = ids[first : begins[b]]
            each = [self.changed(own, begins[a : b + 1] - first, at[a:b], choices) if choices else own for _, choices in found]
            out.append((each or [own], [s for s, _ in found]))
        return out

    def alternatives(self, text: bytes | None) -> list[tuple[float, list[int]]]:
        """The best segmentations of one whole text with their ids."""
        return [(s, list(ids)) for s, ids in self.search(lattice_text(b" " + text), self.best)] if text else []

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        out = self.all_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)]
        return out[1:].tobytes()  # without the space that was set before the text


#: Stands for a literal U+2581 while a text is searched: a lone surrogate, which no valid text holds.
LITERAL = "\udc81"


def lattice_text(raw: bytes) -> str:
    return raw.decode().replace(SPACE, LITERAL).replace(" ", SPACE)


#: Which words take which of their alternatives: (place of the word, number of the alternative); the others take their best.
Choices = tuple[tuple[int, int], ...]


def merged(scores: np.ndarray) -> list[tuple[float, Choices]]:
    """The best totals of a row of words, with what they take: each of the words takes its best or, at a cost, one of its alternatives."""
    if not len(scores):
        return []
    best, best_total = scores.shape[1], float(scores[:, 0].sum())
    if best == 1:
        return [(best_total, ())]
    costs = scores[:, 1:]
    k = min(best - 1, len(costs))  # the words beyond the k whose first alternatives cost least can't be among the best
    few = np.argpartition(costs[:, 0], k - 1)[:k]
    totals: list[tuple[float, Choices]] = [(0.0, ())]
    for word, row in zip(few.tolist(), costs[few].tolist(), strict=True):
        taken = [(c, ((word, i + 1),)) for i, c in enumerate(row) if c < np.inf]
        totals = sorted([*totals, *((t + c, choices + one) for t, choices in totals for c, one in taken)])[:best]
    return [(best_total - t, choices) for t, choices in totals]


def pieces(path: str, best: int = 3, most: int = MOST_WORDS) -> Pieces:
    """The pieces of this Python worker."""
    return kept(("pieces", path, best, most), lambda: Pieces(path, best, most))


def encode_decode(docs: DataFrame, model_path: str, best: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit integers), best_scores (comma-joined, best first), round_trip (whether decoding gives the text)
    of the best segmentation; best_n_pieces, best_crc32 and best_round_trip (comma-joined, in the order of best_scores) of each of the best ones; and, if asked for, ids and best_ids.

    most_words: what a worker's store holds; a smaller one takes less memory and more time."""

    def work(batches):
        p = pieces(model_path, best, most_words)
        for whole in batches:
            for batch in batches_of(whole, 1):
                texts = texts_of(batch.column(1))
                found = p.encode(texts)
                raw = [[ids.astype("<u4").tobytes() for ids in each] for each, _ in found]
                crc = [[zlib.crc32(x) for x in each] for each in raw]
                trip = [[p.decode(ids) == (t or b"") for ids in each] for (each, _), t in zip(found, texts, strict=True)]
                joined = lambda of, f: pa.array([",".join(map(f, x[: len(s)])) for x, (_, s) in zip(of, found, strict=True)], pa.string())
                columns = [
                    pa.array([len(each[0]) for each, _ in found], pa.int64()),
                    pa.array([x[0] for x in crc], pa.int64()),
                    pa.array([",".join(f"{x:.12g}" if abs(x) < 1e15 else "-inf" for x in s) for _, s in found], pa.string()),
                    pa.array([x[0] for x in trip], pa.bool_()),
                    joined([[len(ids) for ids in each] for each, _ in found], str),
                    joined(crc, str),
                    joined(trip, lambda x: "true" if x else "false"),
                    pa.array([x[0] if with_ids else None for x in raw], pa.binary()),
                    pa.array([x[: len(s)] if with_ids else None for x, (_, s) in zip(raw, found, strict=True)], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["doc_id", "n_pieces", "ids_crc32", "best_scores", "round_trip", "best_n_pieces", "best_crc32", "best_round_trip", "ids", "best_ids"]
    schema = "doc_id long, n_pieces long, ids_crc32 long, best_scores string, round_trip boolean, best_n_pieces string, best_crc32 string, best_round_trip string, ids binary, best_ids array<binary>"
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return out if with_ids else out.drop("ids", "best_ids")
