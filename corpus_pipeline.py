"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a DataFrame; all but the last return
the columns of ``docs``. Null or empty texts have no language and go in the second stage at the latest; an empty
table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import byte_cnn, chosen_path, language_id, packing
from twinsieve.llm.base import kept, table

# A text of a known language is all but certain of it; below an even chance no language stands out.
LEAST_SCORE = 0.5
NEAR = chosen_path.Rule(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts."""
    net = byte_cnn.learn(docs, byte_cnn.labelled(table(spark, sf_dir, "labels")))
    return byte_cnn.accepted(docs, net)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a clear language."""
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(language_id.learnable(docs), vocabulary)
    return language_id.accepted(docs, model, vocabulary, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return chosen_path.without_near_duplicates(docs, NEAR)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packed)]

# Two stages learn and one packs by a heuristic; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
