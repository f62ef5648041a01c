"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, automaton, chat, hostpaths, mips, packing, pii, piece_prefix, prefix_bpe, quality, simhash, tokenstore, treaps
from .common import table


def op1_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    return chat.chat_digests(table(spark, sf_dir, "conversations").select(*columns).union(chat.planted(spark)))


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.search(table(spark, sf_dir, "embeddings"))


def op3_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.score_documents(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_documents(table(spark, sf_dir, "documents"))


def op6_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostpaths.extract_pages(table(spark, sf_dir, "pages"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.token_digests(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digests(table(spark, sf_dir, "documents"))


def op11_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.document_alignment(table(spark, sf_dir, "documents"))


def op13_piece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_prefix.token_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_round_trip, op2_anisotropic_search, op3_suffix_quality, op4_backoff_automaton, op5_token_store, op6_host_consensus, op7_prefix_bpe, op8_best_fit_packing, op9_simhash, op10_contextual_pii, op11_inverted_treaps, op12_token_alignment, op13_piece_prefix)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_round_trip": chat.ORACLE, "op11_inverted_treaps": treaps.ORACLE}
