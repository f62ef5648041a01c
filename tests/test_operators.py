"""Linkage, lineage, terminology, sources, streaming on small tables, with nulls, ties and empty input."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from brightloom.operators import lineage, linkage, relational, terminology
from brightloom.sources import readers, writers
from brightloom.streaming import windows


def test_modes_of_resolution_differ_on_a_bridge(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "a", "x"), (4, None, "x"), (5, None, None)], "i int, p string, q string")
    ordered = {r.ordinal: r.cluster for r in linkage.resolve(rows, ["p", "q"], "i", mode="ordered").collect()}
    joined = {r.ordinal: r.cluster for r in linkage.resolve(rows, ["p", "q"], "i").collect()}
    assert ordered == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5}
    assert joined == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert linkage.resolve(rows.limit(0), ["p", "q"], "i").count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("z", "z")], "a string, b string")
    got = linkage.link_components(edges).collect()
    assert len(got) == 61 and len({r.root for r in got}) == 1


def test_survivors(spark):
    rows = spark.createDataFrame([("c", 1, "short", None, ["b", "a"], "restricted"), ("c", 2, "longer one", "v", ["a", "c"], "open")], "k string, o int, t string, f string, l array<string>, s string")
    r = linkage.survivors(rows, "k", "o", longest=["t"], first=["f"], union=["l"], access="s").first()
    assert (r.t, r.f, r.l, r.s) == ("longer one", "v", ["b", "a", "c"], "open")


def test_by_key_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([("https://doi.org/10.1/A", 1), ("doi:10.1/a", 2), (None, 3), (None, 4)], "d string, o int")
    got = linkage.by_key(rows, __import__("brightloom.functions.text", fromlist=["doi"]).doi("d"), ["o"])
    assert sorted(r.o for r in got.collect()) == [1, 3, 4]


def test_overlay_and_pages(spark):
    a = spark.createDataFrame([(1, "x", "l"), (2, "y", "l")], "id int, v string, w string")
    b = spark.createDataFrame([(1, "z"), (3, "q")], "id int, v string")
    assert {(r.id, r.v) for r in relational.overlay(a, b, "id", "full").collect()} == {(1, "z"), (2, "y"), (3, "q")}
    assert relational.page(a, ["id"], 1, 5).collect()[0].total == 2
    assert relational.search_columns(a, "%", ["v"], escape=True).count() == 0
    assert [r.v for r in spark.createDataFrame([("b",), ("10",), ("9",)], "v string").orderBy(*relational.mixed_order("v")).collect()] == ["9", "10", "b"]


def test_vocabularies(spark):
    icd = spark.createDataFrame([("I21", "Infarct", "Def", "I20-I25"), ("I22", "Again", None, ""), ("", "none", None, "x")], "code string, preferred string, definition string, parent string")
    t = terminology.icd10(icd, "2019")
    assert t.concepts.count() == 2 and t.descriptions.count() == 3 and t.relationships.first().target_concept_id == "ICD10::I20-I25"
    loinc = spark.createDataFrame([("1-8", "Name", "CHEM", "SNOMED:CT:123"), ("2-6", "Other", "CHEM", None)], "LOINC_NUM string, LONG_COMMON_NAME string, CLASS string, RELATEDNAMES2 string")
    t = terminology.loinc(loinc, "2.7")
    assert t.concepts.count() == 3 and t.mappings.first().target_code == "123"
    s = terminology.snomed(spark.createDataFrame([("1", "1"), ("2", "0")], "id string, active string"), spark.createDataFrame([("1", "1", "T", terminology.PREFERRED)], "active string, conceptId string, term string, typeId string"), spark.createDataFrame([("1", "1", "9", "5")], "active string, sourceId string, destinationId string, typeId string"), "x")
    assert s.concepts.count() == 1 and s.descriptions.first().type == "preferred" and s.relationships.first().relationship_type == "part-of"
    out = terminology.translate(spark.createDataFrame([("LOINC::1-8",), ("LOINC::9",)], "source_concept_id string"), t.mappings).collect()
    assert {r.source_concept_id: r.error for r in out} == {"LOINC::1-8": None, "LOINC::9": "no mapping"}


def test_descendants_end_on_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, child string")
    got = {r.node: r.depth for r in terminology.descendants(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_readers(spark, tmp_path):
    (tmp_path / "icd.xml").write_text('<ClaML><Class code="I21" superclass="I20"><Rubric kind="preferred"><Label>Acute  infarct</Label></Rubric><Rubric kind="inclusion"><Label>heart attack</Label></Rubric></Class><Class code="I22"><SuperClass code="I2"/><Rubric kind="preferred"><Label>Later</Label></Rubric></Class></ClaML>')
    rows = {r.code: r for r in readers.claml(spark, str(tmp_path / "icd.xml")).collect()}
    assert rows["I21"].parent == "I20" and rows["I21"].preferred == "Acute infarct" and rows["I21"].aliases == ["heart attack"] and rows["I22"].parent == "I2"
    (tmp_path / "u.xml").write_text("<root><unit Code='m&g'><name>metre & gram</name></unit></root>")
    assert readers.ucum(spark, str(tmp_path / "u.xml")).first().code == "m&g"
    (tmp_path / "t.tsv").write_text("﻿id\tname\n1\t x \n2\t\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "x"), ("2", "")]
    (tmp_path / "q.csv").write_text('a,b\n"x ""y""","line\nend"\n')
    assert tuple(readers.quoted_csv(spark, str(tmp_path / "q.csv")).first()) == ('x "y"', "line\nend")
    (tmp_path / "m.json").write_text('{"documents": [{"id": "d1"}, {"id": "d2"}]}')
    assert readers.manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "pcs.txt").write_text("0210093 Bypass one\nnot a code\n")
    assert readers.pattern_lines(spark, str(tmp_path / "pcs.txt"), r"^([A-HJ-NP-Z0-9]{7})\s+(.+)$", ["code", "name"]).first().name == "Bypass one"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("rrf/RXNCONSO.RRF", "1|ENG\n2|SPA\n")
        z.writestr("x.txt", "no")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as tar:
        data = gzip.compress(b"x")
        info = tarfile.TarInfo("p/CodeSystem-x.json")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    found = readers.files(spark, str(tmp_path), [".zip", ".tgz"], content=True)
    assert readers.zip_members(found.where(F.col("path").endswith(".zip")), "rxnconso.rrf").count() == 2
    assert readers.tar_members(found.where(F.col("path").endswith(".tgz")), [("CodeSystem", "code-system")]).first().kind == "code-system"
    assert found.where(F.col("path").endswith(".zip")).select(readers.signature_ok("content", "zip").alias("ok")).first().ok


def test_markdown_and_writers(spark, tmp_path):
    md = spark.createDataFrame([("d", "# Title\n**Term**: means `code`\ntext")], "k string, t string")
    assert [(r.line_number, r.kind, r.value) for r in readers.markdown(md, "k", "t").orderBy("line_number", "kind").collect()] == [(1, "heading", "Title"), (2, "code", "code"), (2, "definition", "Term")]
    df = spark.createDataFrame([(1, None, ["a", "b"])], "id int, n string, l array<string>")
    writers.tsv(df.drop("l"), str(tmp_path / "o"), ["id", "n", "extra"])
    assert spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).columns == ["id", "n", "extra"]
    assert writers.flat(df).first().l == "a; b"
    writers.buckets(df, "l", str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    lineage.replace_partitions(df.select("id", F.lit("x").alias("p")), str(tmp_path / "r"), "p")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "events"
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(source))
    stream = windows.event_stream(spark, str(source), batch.schema)
    query = windows.tumbling_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = windows.tumbling_counts(batch, "ts", "event_type")
    got = spark.table("counted")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).agg(F.sum("n")).first()[0] in (None, 0)


def test_dice_pairs_at_the_threshold(spark):
    """All 15 words of an item are the most frequent of another's 85, so their Dice is 0.3 exactly."""
    shared, own = [f"s{i:02}" for i in range(15)], [f"u{i:02}" for i in range(70)]
    items = spark.createDataFrame([(1, shared + own), (2, shared)], "a long, tokens array<string>")
    rows = linkage.dice_pairs(items, items.withColumnRenamed("a", "b"), "a", "b", 0.3).where("a < b").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0.3)]
