"""The registered queries of the operators: production parameters, whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import brown, byte_cnn, chosen_path, kneser_ney, language_id, licences, packing, prefix_free, sentencepieces, spelling_trie, syncmers, top_k, warc
from .base import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
# Queries that SQL can express.
SQL: dict[str, str] = {}
# Pages have no date of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark, sf_dir):
    return sentencepieces.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_brown(spark, sf_dir):
    return brown.score_split(table(spark, sf_dir, "documents"))


@query
def op3_top_k(spark, sf_dir):
    return top_k.search_hundredths(table(spark, sf_dir, "embeddings"))


SQL["op3_top_k"] = top_k.SQL


@query
def op4_byte_cnn(spark, sf_dir):
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_syncmers(spark, sf_dir):
    return syncmers.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op7_chosen_path(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), chosen_path.Rule(words=3, percent=85))


@query
def op8_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_licences(spark, sf_dir):
    return licences.scan_known(table(spark, sf_dir, "documents"))


SQL["op9_licences"] = licences.scan_sql()


@query
def op10_warc(spark, sf_dir):
    return warc.page_derivatives(table(spark, sf_dir, "pages"), PAGE_DATE)


SQL["op10_warc"] = warc.page_derivatives_sql(PAGE_DATE)


@query
def op11_prefix_free(spark, sf_dir):
    return prefix_free.collocations(table(spark, sf_dir, "documents"))


SQL["op11_prefix_free"] = prefix_free.SQL


@query
def op12_kneser_ney(spark, sf_dir):
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_spelling_trie(spark, sf_dir):
    return spelling_trie.variants(table(spark, sf_dir, "documents"))
