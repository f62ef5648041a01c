"""Readers of the formats that evidence and terminology files come in."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx


def manifest(spark: SparkSession, path: str, field: str = "documents") -> DataFrame:
    """The entries of a JSON manifest; a byte-order mark is ignored by the reader."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("d")).select("d.*")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Cells trimmed, nulls as empty strings, no byte-order mark in the first name."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.lstrip("﻿").strip()) for c in raw.columns])


def headerless(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """RRF files: ``_c0`` and so on."""
    return spark.read.csv(path, sep=separator, header=False)


def rf2(spark: SparkSession, folder: str, token: str) -> DataFrame:
    """The release files whose name has a token, such as ``Concept``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{token}*.txt").csv(folder, sep="\t", header=True, quote="")


def quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quotes, doubled quotes, line ends inside cells."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def claml(spark: SparkSession, path: str) -> DataFrame:
    """ClaML classes: code, preferred, definition, parent (attribute or child element), up to
    six other rubrics as aliases. The XML source splits files by element, so one large file is many tasks."""
    schema = "_code string, _superclass string, SuperClass array<struct<_code: string>>, Rubric array<struct<_kind: string, Label: string>>"
    raw = spark.read.format("xml").option("rowTag", "Class").schema(schema).load(path)

    def rubric(kind: str) -> Column:
        return F.get(F.filter("Rubric", lambda r: r["_kind"] == kind), F.lit(0))["Label"]

    aliases = F.slice(F.transform(F.filter("Rubric", lambda r: r["_kind"] != "preferred"), lambda r: tx.collapse(r["Label"])), 1, 6)
    return raw.select(F.trim("_code").alias("code"), tx.collapse(rubric("preferred")).alias("preferred"), tx.collapse(rubric("definition")).alias("definition"), F.coalesce("_superclass", F.get("SuperClass", F.lit(0))["_code"]).alias("parent"), aliases.alias("aliases"))


def ucum(spark: SparkSession, path: str) -> DataFrame:
    """Units; HTML answers are rejected and bare ampersands repaired before parsing."""
    whole = spark.read.text(path, wholetext=True)
    sound = whole.where(~F.lower(F.substring(F.trim("value"), 1, 200)).rlike("<!doctype html|<html"))
    repaired = F.regexp_replace("value", r"&(?!#?\w+;)", "&amp;")
    units = F.explode(F.regexp_extract_all(repaired, F.lit(r"(?s)<unit\b.*?</unit>"), F.lit(0)))
    parsed = F.from_xml("u", "_Code string, name string, printSymbol string")
    return sound.select(units.alias("u")).select(parsed.alias("x")).select(F.col("x._Code").alias("code"), F.col("x.name").alias("name"), F.col("x.printSymbol").alias("symbol"))


def pattern_lines(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Groups of the lines that match, such as ``^([A-HJ-NP-Z0-9]{7})\\s+(.+)$``."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def files(spark: SparkSession, folder: str, endings: Sequence[str] = (), exclude: Sequence[str] = (), largest: int | None = None, content: bool = False) -> DataFrame:
    """Files below a folder by ending, without excluded path parts and large ones. Without
    ``content`` the bytes aren't read; the digest needs them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    for part in exclude:
        found = found.where(~F.contains("path", F.lit(part)))
    if endings:
        found = found.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))
    if largest is not None:
        found = found.where(F.col("length") <= largest)
    columns = ["path", "length", "modificationTime"]
    return found.select(*columns, "content", F.sha2("content", 256).alias("sha256")) if content else found.select(*columns)


#: Fixed values (S20): how sound files begin.
SIGNATURES = {"pdf": "25504446", "zip": "504B0304", "gz": "1F8B", "xml": "3C3F786D6C"}


def signature_ok(content: str, kind: str) -> Column:
    """The content begins as its kind does."""
    return F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(SIGNATURES[kind]))


def zip_members(files_: DataFrame, suffix: str) -> DataFrame:
    """Lines of the members of ZIP files that end with ``suffix``; a member is read as it streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not name.lower().endswith(suffix.lower()):
                            continue
                        with archive.open(name) as member:
                            lines: list[str] = []
                            for line in io.TextIOWrapper(member, "utf-8", errors="replace"):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield pd.DataFrame({"path": path, "member": name, "line": lines})
                                    lines = []
                            if lines:
                                yield pd.DataFrame({"path": path, "member": name, "line": lines})

    return files_.select("path", "content").mapInPandas(run, "path string, member string, line string")


def tar_members(files_: DataFrame, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """Names and sizes of the members of TGZ files, with the kind that a name begins with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    found = [(path, m.name, m.size) for m in archive if m.isfile()]
                yield pd.DataFrame(found, columns=["path", "member", "size"])

    base = F.element_at(F.split("member", "/"), -1)
    kind = F.coalesce(*[F.when(F.startswith(base, F.lit(start)), F.lit(name)) for start, name in kinds], F.lit("other"))
    return files_.select("path", "content").mapInPandas(run, "path string, member string, size long").withColumn("kind", kind)


def markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """Headings, definitions and inline code of Markdown, with line numbers from 1."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    parts = F.concat(
        F.when(F.col("line").rlike(r"^#{1,6}\s"), F.array(F.struct(F.lit("heading").alias("kind"), F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*$", 1).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        F.when(F.col("line").rlike(r"^\s*[-*]?\s*\*\*[^*]+\*\*\s*:"), F.array(F.struct(F.lit("definition").alias("kind"), F.regexp_extract("line", r"\*\*([^*]+)\*\*", 1).alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        F.transform(F.regexp_extract_all("line", F.lit("`([^`]+)`"), F.lit(1)), lambda v: F.struct(F.lit("code").alias("kind"), v.alias("value"))),
    )
    return lines.select(key, (F.col("n") + 1).alias("line_number"), F.explode(parts).alias("p")).select(key, "line_number", "p.kind", "p.value")


def described(paths: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """What file names say: layer by the first pattern, type by ending, version hint."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.select("path", name.alias("name"), tx.first_pattern(name, rules, "unclassified").alias("layer"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("type"), F.nullif(F.regexp_extract(name, r"(?i)\bv\d+(?:\.\d+)?\b", 0), F.lit("")).alias("version_hint"))


def json_fields(df: DataFrame, key: str, json: str, most: int = 4) -> DataFrame:
    """Paths and scalar values of a JSON column, level by level down to ``most``."""
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("v"))
    out = None
    for _ in range(most):
        level.createOrReplaceTempView("_json_level")
        step = df.sparkSession.sql(f"SELECT {key}, l.path AS parent, e.pos, e.key AS name, e.value AS v FROM _json_level l, LATERAL variant_explode(l.v) e")
        path = F.concat_ws(".", F.nullif("parent", F.lit("")), F.coalesce("name", F.col("pos").cast("string")))
        level = step.select(key, path.alias("path"), "v")
        scalar = level.where(~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select(key, "path", F.try_variant_get("v", "$", "string").alias("value"))
        out = scalar if out is None else out.unionByName(scalar)
        level = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
    return out
