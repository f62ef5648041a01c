"""Writers: tables with fixed headers, feeds, bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.crawl import numbered


def fixed_header(df: DataFrame, header: Sequence[str]) -> DataFrame:
    """The columns of ``header`` in order, missing ones and nulls as empty strings."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in header])


def tsv(df: DataFrame, path: str, header: Sequence[str], append: bool = False) -> None:
    """Tab-separated files, each with its header."""
    fixed_header(df, header).write.mode("append" if append else "overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def buckets(df: DataFrame, keys: str, path: str) -> None:
    """Rows once for each of their keys, in one folder a key."""
    df.withColumn("bucket", F.explode(keys)).drop(keys).write.mode("overwrite").partitionBy("bucket").parquet(path)


def both(df: DataFrame, path: str) -> None:
    """CSV and Parquet."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    flat(df).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def flat(df: DataFrame, separator: str = "; ") -> DataFrame:
    """Arrays of strings joined, structs as JSON."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(F.array_join(f.name, separator).alias(f.name) if kind == "array<string>" else F.to_json(f.name).alias(f.name) if kind.startswith(("array", "struct", "map")) else F.col(f.name))
    return df.select(*out)


def feed(df: DataFrame) -> DataFrame:
    """Each row as a line of JSON with its nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def code_systems(concepts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """A FHIR CodeSystem fragment for each concept, to be written as lines. A whole system isn't put
    into one row; readers that need one document concatenate the fragments."""
    first = descriptions.where("type = 'preferred'").groupBy("concept_id").agg(F.min("term").alias("display"))
    joined = concepts.join(first, concepts["id"] == first["concept_id"], "left")
    return joined.select("system", F.to_json(F.struct(F.lit("CodeSystem").alias("resourceType"), F.col("system").alias("url"), "version", F.array(F.struct("code", F.coalesce("display", "code").alias("display"))).alias("concept"))).alias("value"))


def concept_maps(mappings: DataFrame) -> DataFrame:
    """A FHIR ConceptMap group for each source concept with its targets."""
    targets = F.array_sort(F.collect_list(F.struct(F.col("target_code").alias("code"), F.col("mapping_type").alias("relationship"))))
    grouped = mappings.groupBy("system", "target_system", "source_concept_id").agg(targets.alias("target"))
    return grouped.select("system", F.to_json(F.struct(F.lit("ConceptMap").alias("resourceType"), F.col("system").alias("sourceUri"), F.col("target_system").alias("targetUri"), F.array(F.struct(F.col("source_concept_id").alias("code"), "target")).alias("element"))).alias("value"))


def bundle(rows: DataFrame, order: Sequence[str], head: dict, array: str, path: str) -> str:
    """One JSON document at ``path``: the fields of ``head``, and the rows' ``value`` texts in order as
    the elements of ``array``. Tasks write the elements; the driver passes their files on, some bytes at a
    time, so the document may have any size."""
    spark = rows.sparkSession
    lines = numbered(rows.select(*dict.fromkeys(["value", *order])), order, "_n").select("_n", F.when(F.col("_n") == 1, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    lines.repartitionByRange("_n").sortWithinPartitions("_n").select("value").write.text(f"{path}.parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    folder, target = files.Path(f"{path}.parts"), files.Path(path)
    system = target.getFileSystem(conf)
    out = system.create(target, False)
    try:
        out.write(bytearray(f"{json.dumps(head)[:-1]}{', ' if head else ''}{json.dumps(array)}: [\n".encode()))
        for name in sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")):
            part = system.open(files.Path(folder, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.write(bytearray(b"]}\n"))
    finally:
        out.close()
    system.delete(folder, True)
    return path


def code_system_bundle(concepts: DataFrame, descriptions: DataFrame, system: str, version: str, base: str, path: str) -> str:
    """A whole FHIR CodeSystem: all concepts of a system's version by code, with their preferred
    terms, else their codes; ``base`` begins its address."""
    first = descriptions.where((F.col("type") == "preferred") & (F.col("system") == system)).groupBy("concept_id").agg(F.min("term").alias("display"))
    mine = concepts.where((F.col("system") == system) & (F.col("version") == version))
    joined = mine.join(first, mine["id"] == first["concept_id"], "left")
    rows = joined.select("code", F.to_json(F.struct("code", F.coalesce("display", "code").alias("display"))).alias("value"))
    return bundle(rows, ["code", "value"], {"resourceType": "CodeSystem", "url": f"{base}/CodeSystem/{system.lower()}", "version": version, "status": "draft", "content": "complete"}, "concept", path)


def concept_map_bundle(mappings: DataFrame, system: str, version: str, base: str, path: str) -> str:
    """A whole FHIR ConceptMap: a group for each mapping of a system."""
    target = F.array(F.struct(F.col("target_code").alias("code"), F.col("mapping_type").alias("equivalence")))
    group = F.struct(F.col("system").alias("source"), F.col("target_system").alias("target"), F.array(F.struct(F.col("source_concept_id").alias("code"), target.alias("target"))).alias("element"))
    rows = mappings.where(F.col("system") == system).select("source_concept_id", F.to_json(group).alias("value"))
    return bundle(rows, ["source_concept_id", "value"], {"resourceType": "ConceptMap", "url": f"{base}/ConceptMap/{system.lower()}-{version}", "status": "draft"}, "group", path)
