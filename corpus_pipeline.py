"""A corpus pipeline of five stages, each on all that the one before kept; queries are registered in __spark_entry__.py.

language: documents whose language is not known with a score of at least one half go.
near_duplicates: of the documents linked by a Jaccard similarity of 0.75 of their five-word sets, the one with the least doc_id stays.
decontamination: documents with a benchmark passage of ten words go.
secrets: secrets are replaced in the text, and n_chars follows; no document goes.
encoding: the pieces of every document that is left, with the scores of the three best segmentations.

Defined results: each row stays or goes by its own text, also where it shares its doc_id with other rows or has none. Of rows that repeat doc_id and text,
near_duplicates keeps one, as of other copies (the least doc_id stays, a null one only where no other row of the group has one); rows without words
are copies of nothing, but language lets them go. Null texts and texts without letters go with language. An empty table gives an empty one, with every stage's columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, jaccard_join, language_id, secret_scan, sentence_pieces
from quillspark.llm.common import stored, table


#: Words that the last stage's store holds: half as many as by default, as memory is what the stages share.
STORE = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, most_words=STORE)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("encoding", encoded),
]

#: SQL can't express language identification and the search for segmentations; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
