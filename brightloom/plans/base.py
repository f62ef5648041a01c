"""The registry: every query is a function of session and table folder, with DuckDB SQL where it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder as attributes; a scan is planned only for those that a query touches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    """Queries by name, with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(Tables(spark, sf_dir))

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = query
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register
