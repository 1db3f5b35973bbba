"""Each of the N best segmentations of a text, with its ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import sentence_pieces

from .data import frame, texts


def test_each_segmentation(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    given = [*texts(), "hello", "hello abcd", "the the the the", "q▁w  z "]
    p = sentence_pieces.Pieces(path)
    score_of = {i: s for i, s in p.vocabulary.values()} | {i: p.byte_score for i in p.byte_ids}
    got = {r["doc_id"]: r for r in sentence_pieces.encode_decode(frame(spark, given), path).collect()}
    for i, t in enumerate(given):
        r, each = got[i], [np.frombuffer(x, "<u4") for x in got[i]["best_ids"]]
        scores = [float(x) for x in r["best_scores"].split(",") if x]
        assert len(each) == len(scores) and len({x.tobytes() for x in each}) == len(each)
        assert r["best_n_pieces"] == ",".join(str(len(x)) for x in each) and r["best_crc32"] == ",".join(str(zlib.crc32(x.tobytes())) for x in each)
        assert r["best_round_trip"] == ",".join(["true"] * len(each))
        for ids, score in zip(each, scores, strict=True):
            assert p.decode(ids) == t.encode() and sum(score_of[k] for k in ids.tolist()) == pytest.approx(score)
        if t:
            assert bytes(r["ids"]) == each[0].tobytes()
            if len(t) < 400:
                whole = p.alternatives(t.encode())
                assert len(whole) == len(each) and sum(map(len, each)) and scores == pytest.approx([s for s, _ in whole])


def test_words_are_kept_when_the_tables_grow():
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentence_pieces.Pieces(path)
    p.starts, p.scores, p.ids = p.starts[: 2 * p.best + 1].copy(), p.scores[:2].copy(), p.ids[:4].copy()
    words = [b" hello", b" abcd", b" the", b" question", b" zq", b" eanthorat"]
    found = p.encode([b"hello abcd the question zq eanthorat"])[0]
    assert p.n == len(words) and all(p.decode(x) == b"hello abcd the question zq eanthorat" for x in found[0]) and len(found[0]) == 3


def test_words_that_go_come_back_the_same():
    """Segmentations do not depend on what a worker has kept, or dropped on the way."""
    import random

    from quillspark.llm.sentence_pieces import Pieces

    import public_tokenizers

    path, rnd = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    words = ["".join(rnd.choice("abcdeéß日") for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    given = [" ".join(rnd.choice(words[: rnd.choice((20, 400))]) for _ in range(60)).encode() for _ in range(40)]
    whole, small = Pieces(path), Pieces(path, most=50)
    for i in range(0, 40, 4):
        for (ids, scores), (other, more) in zip(whole.encode(given[i : i + 4]), small.encode(given[i : i + 4]), strict=True):
            assert scores == more and all((a == b).all() for a, b in zip(ids, other, strict=True))
    assert small.n < whole.n
