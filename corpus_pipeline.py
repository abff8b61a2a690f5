"""The corpus pipeline: five stages over `documents`, each calling one operator of the llm package.

A stage gets what the one before kept, reread from Parquet, with the columns of `documents`; its
decisions take effect on rows or texts. Rows without doc_id go through like others; rows that repeat
doc_id and text leave with the exact copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatterscope.llm import exact, langid, minhash, packing, suffix
from chatterscope.llm.shared import documents, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Cosine with its language from which a text is taken for language at all; less for short ones. Measured
#: at sf 0.1: see README, Choices.
LEAST_LANGUAGE = 0.2
#: Five words, 0.8.
NEAR = minhash.Likeness(5, 80)
#: Bytes of a repeated passage: fifty words have some 300, and hardly ever fewer than this.
REPEATED = 250


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the corpus; gibberish, other scripts and texts
    without a letter go."""
    return langid.accepted(docs, LEAST_LANGUAGE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact.distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return minhash.representatives(docs, NEAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of `REPEATED` bytes and more that occur elsewhere too, wherever they
    occur: what several documents share is in none of them alone. No document goes as a whole."""
    return suffix.without_repeats(docs, REPEATED)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 ids: a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("sequences", sequences),
]
#: No SQL: learned profiles, near copies and packing are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each gives is written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
