"""Whole bundles, preferred rows and their challengers, ingestion that goes on after errors."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from brightloom.operators import relational, terminology
from brightloom.sources import writers


def test_bundles_are_one_document(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"code": f"c{i}", "text": 'a "quoted"\nline é'})) for i in range(500)], "k long, value string").repartition(7)
    path = writers.bundle(rows, ["k"], {"kind": "x", "n": 1}, "items", str(tmp_path / "bundle.json"))
    made = json.loads((tmp_path / "bundle.json").read_text(encoding="utf-8"))
    assert path.endswith("bundle.json") and made["kind"] == "x" and [i["code"] for i in made["items"]] == [f"c{i}" for i in range(500)]
    writers.bundle(rows.limit(0), ["k"], {}, "items", str(tmp_path / "empty.json"))
    assert json.loads((tmp_path / "empty.json").read_text()) == {"items": []}
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".parts")]


def test_challengers(spark):
    rows = [("t", "for", 5.0, 1), ("t", "for", 9.0, 2), ("t", "against", 9.0, 3), ("t", "against", 7.0, 4), ("t", "mixed", 8.0, 5), ("t", None, 10.0, 6), ("u", "for", 1.0, 7), ("u", "mixed", 3.0, 8), (None, "for", 1.0, 9), (None, "against", 2.0, 10)]
    df = spark.createDataFrame(rows, "topic string, stance string, score double, id long")
    got = {(r.topic, r.preferred, r.challenger) for r in relational.challenges(df, "topic", "stance", "score", "id").collect()}
    assert got == {("t", 2, 3), ("t", 2, 4), ("t", 2, 5), (None, 10, 9)}
    first = relational.challenges(df, "topic", "stance", "score", "id", 2).where("topic = 't'").orderBy("place").collect()
    assert [(r.place, r.challenger, r.challenger_stance) for r in first] == [(1, 3, "against"), (2, 5, "mixed")]
    assert relational.challenges(df.limit(0), "topic", "stance", "score", "id").collect() == []


def test_ingestion_goes_on_after_errors(spark):
    rows = spark.createDataFrame([("1", "one"), ("2", "two")], "code string, term string")

    def parsed(df, system):
        return terminology.Terms(terminology.concepts(df, system, "v"), terminology.descriptions(df, system, F.lit("preferred")), df.limit(0))

    def missing():
        raise FileNotFoundError("gone")

    late = rows.withColumn("term", F.raise_error(F.lit("late")).cast("string"))
    parsers = {"A": lambda: parsed(rows, "A"), "B": missing, "C": lambda: parsed(late, "C"), "D": lambda: parsed(rows, "D"), "E": lambda: parsed(rows, "E")}
    found = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x"), ("D", None)], "system string, digest string")
    known = spark.createDataFrame([("A", "x"), ("B", "old")], "system string, digest string")
    terms, states, errors = terminology.ingest(spark, parsers, found, known)
    assert [(r.system, r.status, r.rows) for r in states.orderBy("system").collect()] == [("A", "UNCHANGED", 4), ("B", "ERROR", 0), ("C", "ERROR", 0), ("D", "SKIPPED", 0), ("E", "SKIPPED", 0)]
    assert {r.system: r.error_type for r in errors.collect()}["B"] == "FileNotFoundError" and "late" in {r.system: r.message for r in errors.collect()}["C"]
    assert set(terms) == {"A"} and terms["A"].concepts.count() == 2
