"""Small tables with every kind of awkward row."""

from __future__ import annotations

import pytest
from conftest_llm import AWKWARD


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and long texts, ties, repeats, and extra columns whose names clash with
    what operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("row", "fp", "length", "piece", "spans", "n", "_0", "_kept", "kind", "word", "host", "rank")])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
