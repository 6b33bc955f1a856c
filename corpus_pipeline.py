"""A training corpus in four stages: toxic documents go, one of each group of near copies stays, personal data is redacted, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's ``docs``.
Every stage but the last returns all columns of its input, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feuillet.llm import chosenpath, packing, pii, toxicity
from feuillet.llm.common import stash, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain, fitted on the labels, doesn't call toxic.

    A null or empty text has no words and gets the base rate, so it stays; repeated rows share their fate. Without labels
    of both classes all stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Texts without words and rows without doc_id stay; rows that share a doc_id stay or go together.
    """
    return chosenpath.without_copies(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, repeated rows stay repeated."""
    return pii.redact(docs, pii.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they go to; a null or empty text is its end mark alone, each repeated row is packed for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicates_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]

#: Fitted models and tokenizers can't be put in SQL; the tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
    return docs
