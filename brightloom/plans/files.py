"""Queries over files and terminologies: tables are written in a format, read back by its reader, and held
against what the tables say.

A query's files are new ones in the shared folder. They are made of the small tables, so that one file
with a chosen name is one task's work; readers take any number of files.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import lineage, relational as op, terminology
from ..operators.linkage import new_path
from ..sources import paged, readers, writers
from .base import Registry, Tables

R = Registry()


def text_file(rows: DataFrame, value: Column, folder: str, name: str, head: str | None = None) -> str:
    """Write one line for each row (after a first line) to a file of that name; returns its path."""
    spark = rows.sparkSession
    lines = rows.select(F.lit(1).alias("o"), value.alias("value"))
    if head is not None:
        lines = spark.createDataFrame([(0, head)], "o int, value string").unionByName(lines)
    made = f"{folder}/.made-{name}"
    lines.coalesce(1).sortWithinPartitions("o", "value").select("value").write.text(made)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = files.Path(f"{folder}/{name}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in system.listStatus(files.Path(made)) if f.getPath().getName().startswith("part-")]
    system.rename(part, target)
    system.delete(files.Path(made), True)
    return f"{folder}/{name}"


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@R.add("SELECT n_nationkey AS id, n_name AS title FROM nation")
def manifest_entries(t: Tables) -> DataFrame:
    """A JSON manifest that begins with a byte-order mark."""
    folder = new_path(t.spark)
    entries = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")).groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("documents"))
    path = text_file(entries, text_of("﻿", F.to_json(F.struct("documents"))), folder, "manifest.json")
    return readers.manifest(t.spark, path).select("id", "title")


@R.add("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, '' AS note FROM nation")
def tsv_cells(t: Tables) -> DataFrame:
    """Byte-order mark, spaces around cells, empty cells."""
    path = text_file(t.nation, text_of(" ", F.col("n_nationkey"), "\t ", F.col("n_name"), " \t"), new_path(t.spark), "t.tsv", "﻿id\ttitle\tnote")
    return readers.tsv(t.spark, path)


@R.add("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS title, '' AS more FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, '' FROM region")
def tsv_appends(t: Tables) -> DataFrame:
    """A fixed header, missing keys as empty cells; appended rows have the same header."""
    path, header = new_path(t.spark), ["id", "title", "more"]
    writers.tsv(t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("title")), path, header)
    writers.tsv(t.region.select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("id")), path, header, append=True)
    return readers.tsv(t.spark, path).select(*header)


def _folder(t: Tables) -> str:
    folder = new_path(t.spark)
    for name in ("a/one-v1.2.txt", "a/two.csv", "b/three.txt", "b/skip/four.txt"):
        text_file(t.region, F.col("r_name"), folder, name)
    return folder


@R.add("SELECT name, (SELECT sum(length(r_name) + 1) FROM region) AS length FROM (VALUES ('one-v1.2.txt'), ('three.txt')) v(name)")
def found_files(t: Tables) -> DataFrame:
    """Files below a folder by ending, without an excluded part, up to a size."""
    found = readers.files(t.spark, _folder(t), [".txt"], exclude=["/skip/"], largest=10_000)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@R.add("SELECT name, (SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) FROM region) AS sha256 FROM (VALUES ('one-v1.2.txt'), ('two.csv'), ('three.txt'), ('four.txt')) v(name)")
def snapshot_listing(t: Tables) -> DataFrame:
    """Path, size and digest of each file."""
    return readers.files(t.spark, _folder(t), content=True).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


@R.add("SELECT * FROM (VALUES ('one-v1.2.txt', 'first', 'txt', 'v1.2'), ('two.csv', 'unclassified', 'csv', NULL), ('three.txt', 'third', 'txt', NULL), ('four.txt', 'unclassified', 'txt', NULL)) v(name, layer, type, version_hint)")
def described_files(t: Tables) -> DataFrame:
    """Layer, type and version by file names."""
    return readers.described(readers.files(t.spark, _folder(t)), [("^one", "first"), ("^three", "third")]).select("name", "layer", "type", "version_hint")


def _claml(t: Tables) -> str:
    """Nations as classes below regions; parents are an attribute or a child element in turn."""
    code, parent = text_of("N", F.col("n_nationkey")), text_of("R", F.col("n_regionkey"))
    odd = F.col("n_nationkey") % 2 == 1
    line = F.concat(
        F.when(odd, text_of('<Class code="', code, '" superclass="', parent, '">')).otherwise(text_of('<Class code="', code, '"><SuperClass code="', parent, '"/>')),
        text_of('<Rubric kind="preferred"><Label> ', F.col("n_name"), '  x</Label></Rubric><Rubric kind="inclusion"><Label>also ', F.col("n_name"), "</Label></Rubric>"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit('<Rubric kind="definition"><Label>fifth</Label></Rubric>')).otherwise(""), F.lit("</Class>"))
    path = text_file(t.nation, line, new_path(t.spark), "classes.xml", "<ClaML>")
    return path


@R.add("SELECT 'N' || n_nationkey AS code, n_name || ' x' AS preferred, CASE WHEN n_nationkey % 5 = 0 THEN 'fifth' END AS definition, 'R' || n_regionkey AS parent, 'also ' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN '|fifth' ELSE '' END AS aliases FROM nation")
def claml_classes(t: Tables) -> DataFrame:
    """Classes with preferred terms, definitions, parents of either form, aliases."""
    return readers.claml(t.spark, _claml(t)).select("code", "preferred", "definition", "parent", F.array_join("aliases", "|").alias("aliases"))


@R.add("""SELECT 'concept' AS kind, 'ICD10::N' || n_nationkey AS id, 'v1' AS value FROM nation UNION ALL SELECT 'description', 'ICD10::N' || n_nationkey || '::preferred::' || n_name || ' x', n_name || ' x' FROM nation
UNION ALL SELECT 'description', 'ICD10::N' || n_nationkey || '::definition::fifth', 'fifth' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'relationship', 'ICD10::N' || n_nationkey || '::is-a::R' || n_regionkey, 'ICD10::R' || n_regionkey FROM nation""")
def icd10_terms(t: Tables) -> DataFrame:
    """K01 over S07."""
    return _terms(terminology.icd10(readers.claml(t.spark, _claml(t)), "v1"))


def _terms(terms: terminology.Terms) -> DataFrame:
    """All rows of a vocabulary's tables as kind, id, value."""
    out = terms.concepts.select(F.lit("concept").alias("kind"), "id", F.col("version").alias("value"))
    out = out.unionByName(terms.descriptions.select(F.lit("description").alias("kind"), "id", F.col("term").alias("value")))
    out = out.unionByName(terms.relationships.select(F.lit("relationship").alias("kind"), "id", F.col("target_concept_id").alias("value")))
    return out if terms.mappings is None else out.unionByName(terms.mappings.select(F.lit("mapping").alias("kind"), "id", F.col("target_code").alias("value")))


@R.add("SELECT 'concept' AS kind, 'UCUM::u' || n_nationkey AS id, 'v2' AS value FROM nation UNION ALL SELECT 'description', 'UCUM::u' || n_nationkey || '::preferred::' || n_name || ' & co', n_name || ' & co' FROM nation")
def ucum_terms(t: Tables) -> DataFrame:
    """Units; an HTML answer beside them is rejected, bare ampersands are repaired."""
    folder = new_path(t.spark)
    text_file(t.nation, text_of('<unit Code="u', F.col("n_nationkey"), '"><name>', F.col("n_name"), " & co</name><printSymbol>s</printSymbol></unit>"), folder, "ucum.xml", "<root>")
    text_file(t.region, text_of('<unit Code="bad"><name>x</name></unit>'), folder, "error.xml", "<!DOCTYPE html><html>")
    return _terms(terminology.ucum(readers.ucum(t.spark, f"{folder}/*.xml"), "v2"))


def _archive(rows: DataFrame, line: Column, pack: Callable[[list[str]], bytes]) -> DataFrame:
    """``path, content``: the lines of all rows packed into one archive (of a small table)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = sorted(x for b in batches for x in b["line"])
        if lines:
            yield pd.DataFrame({"path": ["archive"], "content": [pack(lines)]})

    return rows.select(line.alias("line")).coalesce(1).mapInPandas(run, "path string, content binary")


def _zipped(lines: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("rrf/RXNCONSO.RRF", "\n".join(lines) + "\n")
        z.writestr("readme.txt", "none of it\n")
    return out.getvalue()


def _tarred(lines: list[str]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for line in lines:
            info = tarfile.TarInfo(f"package/{line}.json")
            info.size = len(line)
            tar.addfile(info, io.BytesIO(line.encode()))
    return out.getvalue()


@R.add("SELECT 'rrf/RXNCONSO.RRF' AS member, n_nationkey || '|ENG|' || n_name AS line FROM nation")
def zipped_lines(t: Tables) -> DataFrame:
    """Lines of members inside ZIP files."""
    return readers.zip_members(_archive(t.nation, text_of(F.col("n_nationkey"), "|ENG|", F.col("n_name")), _zipped), ".rrf").select("member", "line")


@R.add("SELECT 'package/' || CASE WHEN n_nationkey % 2 = 0 THEN 'CodeSystem-' ELSE 'Other-' END || n_name || '.json' AS member, length(n_name) + CASE WHEN n_nationkey % 2 = 0 THEN 11 ELSE 6 END AS size, CASE WHEN n_nationkey % 2 = 0 THEN 'code-system' ELSE 'other' END AS kind FROM nation")
def tarred_members(t: Tables) -> DataFrame:
    """Members of TGZ files, with the kind their names begin with."""
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "CodeSystem-").otherwise("Other-"), F.col("n_name"))
    return readers.tar_members(_archive(t.nation, name, _tarred), [("CodeSystem", "code-system")]).select("member", "size", "kind")


@R.add("""SELECT 'concept' AS kind, 'RXNORM::' || n_nationkey AS id, 'v3' AS value FROM nation UNION ALL SELECT 'description', 'RXNORM::' || n_nationkey || '::in::' || n_name, n_name FROM nation
UNION ALL SELECT 'relationship', 'RXNORM::' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '::is-a::' ELSE '::rn::' END || n_regionkey, 'RXNORM::' || n_regionkey FROM nation UNION ALL SELECT 'mapping', 'RXNORM::' || n_nationkey || '::ATC::A' || n_nationkey, 'A' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0""")
def rxnorm_terms(t: Tables) -> DataFrame:
    """RRF files by position."""
    folder, key = new_path(t.spark), F.col("n_nationkey")
    conso = text_file(t.nation, text_of(key, "|ENG|||||||||||IN||", F.col("n_name"), "|"), folder, "RXNCONSO.RRF")
    rel = text_file(t.nation, text_of(key, "|||RN|", F.col("n_regionkey"), "|||", F.when(key % 2 == 0, "isa").otherwise(""), "|"), folder, "RXNREL.RRF")
    sat = text_file(t.nation, text_of(key, "||||||||", F.when(key % 3 == 0, "ATC").otherwise("NDC"), "||A", key, "|"), folder, "RXNSAT.RRF")
    return _terms(terminology.rxnorm(*[readers.headerless(t.spark, p) for p in (conso, rel, sat)], "v3"))


@R.add("""SELECT 'concept' AS kind, 'SNOMED::' || n_nationkey AS id, 'v4' AS value FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'description', 'SNOMED::' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '::preferred::' ELSE '::synonym::' END || n_name, n_name FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'relationship', 'SNOMED::' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '::is-a::' ELSE '::part-of::' END || n_regionkey, 'SNOMED::' || n_regionkey FROM nation WHERE n_nationkey % 5 <> 0""")
def snomed_terms(t: Tables) -> DataFrame:
    """Release files by a token of their name; active rows only."""
    folder, key = new_path(t.spark), F.col("n_nationkey")
    active = F.when(key % 5 == 0, "0").otherwise("1")
    kind = lambda a, b: F.when(key % 2 == 0, a).otherwise(b)
    text_file(t.nation, text_of(key, "\t", active), folder, "sct2_Concept_x.txt", "id\tactive")
    text_file(t.nation, text_of(key, "\t", active, "\t", F.col("n_name"), "\t", kind(terminology.PREFERRED, "9")), folder, "sct2_Description_x.txt", "conceptId\tactive\tterm\ttypeId")
    text_file(t.nation, text_of(key, "\t", active, "\t", F.col("n_regionkey"), "\t", kind(terminology.IS_A, "1")), folder, "sct2_Relationship_x.txt", "sourceId\tactive\tdestinationId\ttypeId")
    return _terms(terminology.snomed(*[readers.rf2(t.spark, folder, x) for x in ("Concept", "Description", "Relationship")], "v4"))


@R.add("""WITH l AS (SELECT n_nationkey AS k, 'a, "' || n_name || '"' || chr(10) || 'b' AS term, 'C' || n_regionkey AS c FROM nation)
SELECT 'concept' AS kind, 'LOINC::' || k AS id, 'v5' AS value FROM l UNION ALL SELECT DISTINCT 'concept', 'LOINC::' || c, 'v5' FROM l UNION ALL SELECT 'description', 'LOINC::' || k || '::preferred::' || trim(term), term FROM l
UNION ALL SELECT DISTINCT 'description', 'LOINC::' || c || '::preferred::' || c, c FROM l UNION ALL SELECT 'relationship', 'LOINC::' || k || '::part-of::' || c, 'LOINC::' || c FROM l UNION ALL SELECT 'mapping', 'LOINC::' || k || '::SNOMED::7' || k, '7' || k FROM l WHERE k % 4 = 0""")
def loinc_terms(t: Tables) -> DataFrame:
    """CSV with quotes, doubled quotes and line ends inside cells."""
    key = F.col("n_nationkey")
    line = text_of(key, ',"a, ""', F.col("n_name"), '""\nb",C', F.col("n_regionkey"), ",", F.when(key % 4 == 0, text_of("SNOMED CT: 7", key)).otherwise("none"))
    path = text_file(t.nation, line, new_path(t.spark), "Loinc.csv", "LOINC_NUM,LONG_COMMON_NAME,CLASS,RELATEDNAMES2")
    return _terms(terminology.loinc(readers.quoted_csv(t.spark, path), "v5"))


@R.add("SELECT 'ABC' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def pattern_line_scan(t: Tables) -> DataFrame:
    """Lines of a fixed pattern; others are passed over."""
    key = F.col("n_nationkey")
    line = F.concat(F.when(key % 2 == 0, "ABC").otherwise("IO-"), F.lpad(key.cast("string"), 4, "0"), F.lit("   "), F.col("n_name"))
    return readers.pattern_lines(t.spark, text_file(t.nation, line, new_path(t.spark), "pcs.txt"), r"^([A-HJ-NP-Z0-9]{7})\s+(.+)$", ["code", "name"])


@R.add("""SELECT p_partkey, 1 AS line_number, 'heading' AS kind, p_name AS value FROM part UNION ALL SELECT p_partkey, 2, 'definition', p_type FROM part UNION ALL SELECT p_partkey, 2, 'code', CAST(p_size AS VARCHAR) FROM part""")
def markdown_scan(t: Tables) -> DataFrame:
    """S17."""
    text = text_of("## ", F.col("p_name"), " ##\n- **", F.col("p_type"), "**: has `", F.col("p_size"), "`\nplain")
    return readers.markdown(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text").select("p_partkey", "line_number", "kind", "value")


@R.add("SELECT 'p' || n_regionkey || '.json' AS page, CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, 2000 + n_nationkey AS year FROM nation")
def paged_records(t: Tables) -> DataFrame:
    """Pages of records, one file a page."""
    folder = new_path(t.spark)
    for r in range(5):  # one page for each of the five regions
        rows = t.nation.where(F.col("n_regionkey") == r).groupBy().agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), (2000 + F.col("n_nationkey")).alias("year"))).alias("results"))
        text_file(rows, F.to_json(F.struct("results")), folder, f"p{r}.json")
    return paged.read(t.spark, folder)


@R.add("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS pdf, p_partkey % 4 = 2 AS zip FROM part")
def file_signatures(t: Tables) -> DataFrame:
    """How sound files begin."""
    begins = F.unhex(F.get(F.array(*map(F.lit, ("255044462D31", "25504446", "504B030400", "3C68746D"))), F.col("p_partkey") % 4))
    return t.part.select("p_partkey", begins.alias("content")).select("p_partkey", readers.signature_ok("content", "pdf").alias("pdf"), readers.signature_ok("content", "zip").alias("zip"))


@R.add("SELECT bucket, count(*) AS n FROM (SELECT doc_id, unnest(['lang-' || lang, 'source-' || source]) AS bucket FROM documents) GROUP BY 1")
def bucket_folders(t: Tables) -> DataFrame:
    """Rows once for each of their buckets, in a folder each."""
    path = new_path(t.spark)
    writers.buckets(t.documents.select("doc_id", F.array(F.concat(F.lit("lang-"), "lang"), F.concat(F.lit("source-"), "source")).alias("keys")), "keys", path)
    return t.spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("n"))


@R.add("SELECT 'parquet' AS made, n_nationkey AS id, n_name || ', ' || n_regionkey AS tags FROM nation UNION ALL SELECT 'csv', n_nationkey, n_name || '; ' || n_regionkey FROM nation")
def both_formats(t: Tables) -> DataFrame:
    """The same rows as Parquet and, flattened, as CSV."""
    path = new_path(t.spark)
    writers.both(t.nation.select(F.col("n_nationkey").alias("id"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags")), path)
    a = t.spark.read.parquet(f"{path}/parquet").select(F.lit("parquet").alias("made"), "id", F.array_join("tags", ", ").alias("tags"))
    return a.unionByName(t.spark.read.csv(f"{path}/csv", header=True).select(F.lit("csv").alias("made"), F.col("id").cast("long"), "tags"))


@R.add("""SELECT '{"resourceType":"CodeSystem","url":"N","version":"v1","concept":[{"code":"' || n_nationkey || '","display":"' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END || '"}]}' AS value FROM nation
UNION ALL SELECT '{"resourceType":"ConceptMap","sourceUri":"N","targetUri":"R","element":[{"code":"N::' || n_nationkey || '","target":[{"code":"' || n_regionkey || '","relationship":"exact"}]}]}' FROM nation""")
def fhir_fragments(t: Tables) -> DataFrame:
    """Code systems and concept maps."""
    rows = t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("term"), F.col("n_regionkey").cast("string").alias("target_code"))
    systems = writers.code_systems(terminology.concepts(rows, "N", "v1"), terminology.descriptions(rows, "N", F.lit("preferred")))
    return systems.select("value").unionByName(writers.concept_maps(terminology.mappings(rows, "N", "R", "exact")).select("value"))


@R.add("SELECT p_type, p_partkey, CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_size END AS size FROM part WHERE p_type <> 'PROMO' OR p_size > 25")
def replaced_partitions(t: Tables) -> DataFrame:
    """What a partition held is replaced, other partitions stay."""
    path = new_path(t.spark)
    rows = t.part.select("p_type", "p_partkey", F.col("p_size").alias("size"))
    lineage.replace_partitions(rows, path, "p_type")
    lineage.replace_partitions(rows.where("p_type = 'PROMO' AND size > 25").withColumn("size", F.lit(0).cast(dict(rows.dtypes)["size"])), path, "p_type")
    return t.spark.read.parquet(path).select("p_type", "p_partkey", "size")


@R.add("SELECT 'S' || n_nationkey AS system, CASE WHEN n_nationkey % 3 = 0 THEN 'SKIPPED' WHEN n_nationkey % 2 = 0 THEN 'UNCHANGED' ELSE 'PROCESSED' END AS status FROM nation")
def ingest_statuses(t: Tables) -> DataFrame:
    """By the content's hash."""
    key, system = F.col("n_nationkey"), text_of("S", F.col("n_nationkey"))
    found = t.nation.select(system.alias("system"), F.when(key % 3 != 0, F.sha2("n_name", 256)).alias("digest"))
    known = t.nation.where(key % 4 != 1).select(system.alias("system"), F.sha2(F.when(key % 2 == 0, F.col("n_name")).otherwise("old"), 256).alias("digest"))
    return terminology.ingest_status(found, known).select("system", "status")


@R.add("SELECT 'N::' || n_nationkey AS id, n_name AS term FROM nation WHERE contains(lower(n_name), '_1') ORDER BY id, term LIMIT 50")
def vocabulary_search(t: Tables) -> DataFrame:
    """A text in any of several columns, in any case, at most 50 rows."""
    return terminology.search(t.nation.select(text_of("N::", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("term")), "Nation_1", ["id", "term"])


@R.add("SELECT 'N::' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'R' || n_regionkey END AS target, CASE WHEN n_nationkey % 2 <> 0 THEN 'no mapping' END AS error FROM nation")
def translated_batch(t: Tables) -> DataFrame:
    """Codes with their targets, or an error each."""
    rows = t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, text_of("R", F.col("n_regionkey"))).alias("target_code"))
    items = rows.select(terminology.concept_id("N", F.col("code")).alias("source_concept_id"))
    out = terminology.translate(items, terminology.mappings(rows, "N", "R", "exact"))
    return out.select(F.col("source_concept_id").alias("id"), F.col("target_code").alias("target"), "error")


@R.add("""SELECT 'K::' || n_nationkey AS child, 'K::R' || n_regionkey AS parent FROM nation WHERE n_nationkey % 2 = 0""")
def parent_lookup(t: Tables) -> DataFrame:
    """A parent's id without asking whether it exists; edges without an end are left out."""
    rows = t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, text_of("R", F.col("n_regionkey"))).otherwise("").alias("parent"))
    return terminology.relationships(rows, "K", F.lit("is-a")).select(F.col("source_concept_id").alias("child"), F.col("target_concept_id").alias("parent"))


@R.add("SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), '|' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def ordered_set_digest(t: Tables) -> DataFrame:
    """One hash of each group's ordered names and digests, as rows stream by: no group is held."""
    rows = t.documents.select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return op.streamed_digest(rows, "source", "doc_id", "sha").select("source", "digest")

