"""Paged record sources. A page is a JSON file with ``results`` and the cursor of the ``next`` page;
pages are read through Spark, so they may lie in any store that Spark reads, and may come as a stream.
Many pages are better packed: files of JSON lines, each a page that also tells its name as ``page``, as a
file for each page costs the driver and the store more than what is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.crawl import crawl, running

PAGE = "results array<struct<id:string,title:string,year:int>>, next string"


def _parsed(files: DataFrame) -> DataFrame:
    """``page`` (its file's name), ``next`` and ``results`` of whole-text files; a byte-order mark goes."""
    parsed = F.from_json(F.regexp_replace("value", "^﻿", ""), PAGE)
    return _whole(files.select(F.col("_metadata.file_name").alias("page"), parsed.alias("p")).select("page", "p.next", "p.results"))


def _whole(found: DataFrame) -> DataFrame:
    return found.select("page", "next", F.coalesce("results", F.array().cast("array<struct<id:string,title:string,year:int>>")).alias("results"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a folder of ``*.json`` files; a file that is no page has no results."""
    return _parsed(spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path))


def pack(found: DataFrame, path: str, pages_a_file: int = 1000) -> None:
    """Write pages (page, results, next) as packed files of at most so many."""
    found.select("page", "results", "next").write.option("maxRecordsPerFile", pages_a_file).json(path)


def packed(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a folder of packed files; a line that is no page has no results."""
    return _whole(spark.read.schema(f"page string, {PAGE}").json(path))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("page", F.explode("results").alias("r")).select("page", "r.id", "r.title", "r.year")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page, id, title, year`` of the records of all pages."""
    return _records(pages(spark, path))


def followed(found: DataFrame, first: str, most: int | None = None) -> DataFrame:
    """Records of ``pages`` in the order of their cursors from page ``first`` on, numbered from 1 over
    all pages as ``n``; with ``most``, the first so many. A cursor that leads nowhere, or back, ends it;
    so does an empty page."""
    edges = found.where(F.size("results") > 0).select("page", F.col("next").alias("to"))
    start = found.where(F.col("page") == first).select(F.col("page").alias("node"))
    chain = crawl(edges, start).withColumnRenamed("node", "page")
    ordered = running(found.join(chain, "page"), ["depth"], F.size("results"), "_end")
    if most is not None:
        ordered = ordered.where(F.col("_end") - F.size("results") < most)
    rows = ordered.select("page", (F.col("_end") - F.size("results")).alias("_before"), F.posexplode("results").alias("_i", "r"))
    rows = rows.select((F.col("_before") + F.col("_i") + 1).alias("n"), "page", "r.id", "r.title", "r.year")
    return rows if most is None else rows.where(F.col("n") <= most)


def stream(spark: SparkSession, path: str, files_a_batch: int = 1000, packed: bool = False) -> DataFrame:
    """The records of a folder's pages, a file each or packed, as a stream. The query's checkpoint remembers
    which files were read, so a query that is started again goes on with the others and reads each record once."""
    files = spark.readStream.option("maxFilesPerTrigger", files_a_batch)
    if packed:
        return _records(_whole(files.schema(f"page string, {PAGE}").json(path)))
    return _records(_parsed(files.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)))
