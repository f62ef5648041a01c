"""Recommendations from guideline lines, glossary terms, paged records."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from brightloom.functions import text as tx
from brightloom.operators import extraction as ex
from brightloom.sources import paged

TABLE = [
    "Recommendations for Revascularization", "COR", "LOE", "Recommendations", "1", "A", "1. In patients with STEMI, PCI should be performed", "to improve survival.", "3: No", "Benefit", "B-", "NR", "2. In stable patients, PCI should not be performed", "without ischemia.", "Synopsis", "1", "A", "1. Not in a table should be performed here",
]
ROWS = ["2A B-NR 3. In patients with diabetes, CABG is reasonable", "over PCI.", "1 A 4. A Heart Team approach is recommended for all patients.", "4.2. Another Section", "ignored text"]
CLASS = ["Class IIb, Level of Evidence C: PCI may be considered in older patients", "with frailty.", "References"]


def lines(spark, doc, texts):
    return spark.createDataFrame([(doc, 1, i, t) for i, t in enumerate(texts)], "doc string, page int, n int, line string")


def rows(df):
    return [(r.cor, r.loe, r.text) for r in df.orderBy("n").collect()]


def test_line_table(spark):
    assert rows(ex.line_tables(lines(spark, "d", TABLE))) == [("1", "A", "In patients with STEMI, PCI should be performed to improve survival."), ("3: NO BENEFIT", "B-NR", "In stable patients, PCI should not be performed without ischemia.")]
    assert ex.line_tables(lines(spark, "d", TABLE).limit(0)).count() == 0


def test_pattern_rows(spark):
    assert rows(ex.pattern_rows(lines(spark, "d", ROWS), ex.COMPACT_ROW, "x")) == [("2A", "B-NR", "In patients with diabetes, CABG is reasonable over PCI."), ("1", "A", "A Heart Team approach is recommended for all patients.")]
    assert rows(ex.pattern_rows(lines(spark, "d", CLASS), ex.CLASS_LEVEL_ROW, "x")) == [("2B", "C", "PCI may be considered in older patients with frailty.")]


def test_pipes_and_sentences(spark):
    bar = lines(spark, "d", ["x | 1 | A | 1. PCI should be performed | in STEMI. | 2a | B-R | 2. CABG is reasonable | Synopsis | more"])
    assert rows(ex.pipe_tables(bar)) == [("1", "A", "PCI should be performed in STEMI."), ("2A", "B-R", "CABG is reasonable")]
    inline = lines(spark, "d", ["Before. In patients with STEMI it is recommended (COR 1, LOE A)."])
    assert rows(ex.inline_rows(inline)) == [("1", "A", "In patients with STEMI it is recommended")]
    assert ex.numbered_rows(lines(spark, "d", ["1. One should act | 2. Two as well"])).count() == 2


def test_first_extractor_wins(spark):
    got = ex.extract_guidelines(lines(spark, "d", TABLE[:8] + ["Synopsis"] + ROWS)).collect()
    texts = [tx_ for tx_ in (r.text for r in got)]
    assert len({t.lower() for t in texts}) == len(texts)
    assert next(r for r in got if "STEMI" in r.text).source == "line-table"
    assert {r.statement_id for r in got} == {f"d:S{i + 1:03}" for i in range(len(got))}
    f = ex.facts(spark.createDataFrame([("In patients with STEMI, PCI should be performed to improve survival.",)], "text string")).first()
    assert f.execution.action == "PCI should be performed" and f.topic == "STEMI" and f.population == "STEMI"


def test_lines(spark):
    got = spark.createDataFrame([("2A",), ("doi:10.1/x",), ("a sentence that says something",)], "t string").select(tx.structural_line("t").alias("s"), tx.noise_line("t").alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False)]


def test_glossary(spark):
    finds = spark.createDataFrame([("**Heart Team**", "heading", "a.md"), ("heart team", "code", "b.md"), ("v1.2", "heading", "c"), ("lonely", "text", "d"), ("ICU", "acronym", "e"), ("ICU", "acronym", "f")], "term string, kind string, source string")
    got = {r.term.lower(): (r.score, r.confidence, r.category) for r in ex.glossary(finds).collect()}
    assert got == {"heart team": (7, "medium", "technical"), "icu": (4, "medium", "technical")}


def test_literals_and_queries(spark):
    code = spark.createDataFrame([("f", "const x = [{code: 'A1', name: \"One\"}, {code: 'B2'}, {z: 1}]")], "k string, t string")
    assert [(r.code, r.name) for r in ex.object_literals(code, "k", "t", ["code", "name"]).orderBy("code").collect()] == [("A1", "One"), ("B2", None)]
    assert ex.search_query(["cabg"], ["x", "y"], 2000) == '"cabg" AND ("x" OR "y") AND 2000:2100[dp]'


def test_paged_records(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"results": [{"id": f"{i}-{j}", "title": "t", "year": 2000 + j} for j in range(2)]}))
    got = paged.read(spark, str(tmp_path))
    assert got.count() == 6 and got.agg(F.max("year")).first()[0] == 2001


def test_statements_are_finished_once(spark):
    """In the plan the steps of a statement are there once, whatever reads it; pages without grades in brackets
    are left out of the search for them."""
    lines = spark.createDataFrame([(1, 1, 0, "PCI is recommended in adults with angina (COR I, LOE A).")], "doc long, page long, n long, line string")
    found = ex.extract_guidelines(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Downloaded from") == 2  # cleaned before and after the cut
    assert ("inline-cor-loe", "PCI is recommended in adults with angina", "1", "A") in [(r.source, r.text, r.cor, r.loe) for r in found.collect()]
