"""Contains joins with lexicon tables, and the impact index, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brightloom.functions import scoring, text as tx
from brightloom.operators import impacts, lexicon

TEXTS = [(1, "The Heart valve"), (2, "art"), (3, None), (4, ""), (5, "valve valve"), (6, "é" * 3000 + "VALVE"), (5, "valve valve"), (None, "heart")]
WORDS = [("heart", "a", 5), ("ART", "b", 7), ("valve", "c", 6), ("heart valve replacement", "d", 1), (None, "n", 0), ("the", "e", 5)]


def first(text, words):
    hits = [(place, w.lower(), label) for w, label, place in words if w is not None and text is not None and w.lower() in text.lower()]
    return min(hits)[2] if hits else None


@pytest.mark.parametrize("block", [1 << 17, 2])
def test_first_contained(spark, monkeypatch, block):
    monkeypatch.setattr(lexicon, "WORDS", block)
    df, lex = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(WORDS, "word string, label string, place int")
    got = lexicon.first_contained(df.withColumns({"best": F.lit(1), "row": F.lit(2)}), "text", lex)
    assert sorted(((r.id, r.text, r.label) for r in got.collect()), key=repr) == sorted(((i, t, first(t, WORDS)) for i, t in TEXTS), key=repr)
    everywhere = [*WORDS, ("", "z", 6)]
    got = lexicon.first_contained(df, "text", spark.createDataFrame(everywhere, "word string, label string, place int"))
    assert sorted(((r.id, r.text, r.label) for r in got.collect()), key=repr) == sorted(((i, t, first(t, everywhere)) for i, t in TEXTS), key=repr)
    assert lexicon.first_contained(df.limit(0), "text", lex).collect() == []
    assert {r.label for r in lexicon.first_contained(df, "text", lex.limit(0)).collect()} == {None}


@pytest.mark.parametrize("block", [1 << 17, 2])
def test_contained_either_way(spark, monkeypatch, block):
    monkeypatch.setattr(lexicon, "WORDS", block)
    df, lex = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(WORDS, "word string, label string, place int")
    words = {w.lower() for w, _, _ in WORDS if w is not None}
    want = {(i, w) for i, t in TEXTS if t is not None for w in words if w in t.lower() or t.lower() in w}
    assert {(r.id, r.word) for r in lexicon.contained_either_way(df, "id", "text", lex).collect()} == want
    assert lexicon.contained_either_way(df, "id", "text", lex.limit(0)).collect() == []


def test_the_plan_does_not_grow_with_the_lexicon(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    sizes = []
    for n in (10, 20_000):
        lex = spark.range(n).select(F.concat(F.lit("word"), "id").alias("word"), F.lit("x").alias("label"), F.col("id").alias("place"))
        out = lexicon.first_contained(df, "text", lex)
        assert {r.label for r in out.collect()} == {None}
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 200


def made(seed, n):
    r = random.Random(seed)
    words = ["heart", "valve", "art", "aortic", "repair", "1a", "x", "stent", "graft", "ring"]
    return [(i, " ".join(r.choices(words, k=r.randint(0, 3))) if i % 17 else None, " ".join(r.choices(words, k=r.randint(0, 9))), i % 5 == 0, i % 7 == 0, i % 40) for i in range(n)]


QUERIES = [(1, "Heart valve"), (2, "art"), (3, "nothing here"), (4, None), (5, "---"), (6, "ring stent graft"), (7, "aortic aortic repair"), (8, "x heart"), (9, "x")]


@pytest.mark.parametrize("block", [1024, 8])
def test_search_equals_a_full_scan(spark, monkeypatch, block):
    monkeypatch.setattr(impacts, "BLOCK", block)
    df = spark.createDataFrame(made(3, 400), "key long, label string, rest string, ready boolean, candidate boolean, priority int").withColumn("text", F.concat_ws(" ", "label", "rest"))
    queries = spark.createDataFrame(QUERIES, "id long, text string")
    asked = queries.select("id", tx.fold("text").alias("phrase"), tx.tokens("text").alias("words")).where("size(words) > 0")
    pairs = df.withColumn("label", F.coalesce("label", F.lit(""))).crossJoin(asked)  # a test's brute force
    for weights, extra, score in (
        (impacts.INDEX_SEARCH, F.when(F.col("ready"), 6).otherwise(0) - F.when(F.col("candidate"), 8).otherwise(0), scoring.index_score(F.col("label"), F.lower("text"), tx.tokens("text"), F.col("words"), F.col("ready"), F.col("candidate"))),
        (impacts.BROWSER_SEARCH, F.least(F.col("priority"), F.lit(200)) / 20 - F.when(F.col("candidate"), 52).otherwise(0), scoring.browser_score(F.col("label"), F.lower("text"), F.col("words"), F.col("phrase"), F.col("candidate"), F.col("priority"))),
    ):
        full: dict = {}
        for r in pairs.select("id", "key", score.alias("s")).where("s IS NOT NULL AND s > 0" if weights.least else "s IS NOT NULL").collect():
            full.setdefault(r.id, []).append((-float(r.s), r.key))
        want = sorted((q, k, key, -s) for q, rows in full.items() for k, (s, key) in enumerate(sorted(rows)[:5], 1))
        found, report = impacts.search(impacts.write_index(df, "key", "label", "text", extra), queries, "id", "text", 5, weights)
        assert sorted((r.id, r["rank"], r.key, r.score) for r in found.collect()) == want
        blocks = {r.id: (r.blocks, r.read) for r in report.collect()}
        assert all(read <= n for n, read in blocks.values())
        if block == 8 and weights.all:
            assert any(read < n for n, read in blocks.values())


def test_an_index_is_read_again(spark, tmp_path):
    df = spark.createDataFrame(made(4, 50), "key long, label string, rest string, ready boolean, candidate boolean, priority int")
    queries = spark.createDataFrame(QUERIES, "id long, text string")
    a = impacts.search(impacts.write_index(df, "key", "label", "rest", F.lit(None), str(tmp_path / "index")), queries, "id", "text", 3)[0]
    b = impacts.search(impacts.read_index(spark, str(tmp_path / "index")), queries, "id", "text", 3)[0]
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
    assert impacts.search(impacts.write_index(df.limit(0), "key", "label", "rest", F.lit(0)), queries, "id", "text", 3)[0].collect() == []


def test_postings_are_packed_and_texts_are_not_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "heart", "heart valve heart"), (2, None, "valve")], "key long, label string, text string").coalesce(1)
    index = impacts.write_index(df, "key", "label", "text", F.lit(0), str(tmp_path / "index"))
    assert {r.term: sorted(r.postings) for r in index.postings.collect()} == {"heart": [7], "valve": [4, 12]}
    assert "text" not in index.concepts.columns and not (tmp_path / "index" / ".made").exists()
