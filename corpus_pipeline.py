"""The training-data pipeline, part of ``brightloom.llm``: quality rules, SimHash near-dedup, PII, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``. Rows may have null ids or texts; the operators say what they do then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import packing, pii, quality, simhash
from brightloom.llm.common import cut, noted, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the repetition limits keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("personal data", remove_personal_data), ("best-fit packing", best_fit_packing)]
#: SQL can't express fingerprints, learned contexts or packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with noted() as used:
            out = stage(spark, docs, sf_dir)
        docs = cut(out, name.replace(" ", "-"))
        release(spark, used)  # what the stage cut for its own use; its rows are written now
    return STAGES[-1][1](spark, docs, sf_dir)
