"""Texts in scripts that no learned language uses."""

import pytest

from quillspark.llm import language_id

from .data import frame


def test_unlearned_scripts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null")
    model = language_id.learn(docs)
    own = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    latin = sum(c.isalpha() for c in own)
    other = {"cyrillic": "все люди рождаются свободными ", "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระ ", "greek": "όλοι οι άνθρωποι γεννιούνται ", "han": "人人生而自由 "}
    given = [own, *other.values(), "", None]
    for t in other.values():
        own_letters = sum(map(len, language_id.words_in(t)))
        given += [own + " " + t * (latin // (2 * own_letters)), own + " " + t * (3 * latin // own_letters), t * (3 * latin // own_letters) + own]
    want = []
    for t in given:
        words = language_id.words_in(t or "")
        known = sum(len(w) for w in words if language_id.script_of(w) == "latin")
        want.append(known / max(1, sum(map(len, words))))
    rows = {r["doc_id"]: r for r in language_id.predict(frame(spark, given), model).collect()}
    assert [rows[i]["score"] for i in range(1, 7)] == [0.0] * 6
    for i in (0, *range(7, len(given))):
        assert rows[i]["lang_pred"] == "en" and rows[i]["score"] == pytest.approx(want[i], abs=0.05)
    kept = {r["doc_id"] for r in language_id.keep_known(frame(spark, given), model).collect()}
    assert kept == {i for i, x in enumerate(want) if x >= 0.5} and 0 in kept and len(kept) == 5
