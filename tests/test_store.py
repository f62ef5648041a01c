"""The document store: versions, conflicts, retries; chains verified by segments."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from brightloom.operators import lineage
from brightloom.sources.store import Conflict, DocumentStore, upserted


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store, other = DocumentStore(spark, str(tmp_path)), DocumentStore(spark, f"file:{tmp_path}/")
    a, b = (spark.createDataFrame([(k, v)], "k long, v string") for k, v in ((1, "a"), (2, "b")))
    assert store.version() == 0 and store.commit({"c": a}, 0, note="first") == 1
    seen, other_seen = store.version(), other.version()
    assert other.commit({"c": b}, other_seen) == 2
    with pytest.raises(Conflict):
        store.commit({"c": a, "d": a}, seen)
    assert rows(store.read("c")) == [(2, "b")] and rows(store.read("c", 1)) == [(1, "a")]
    assert store.collections() == ["c"] and store.entry(1)["note"] == "first"
    assert len(list((tmp_path / "data").iterdir())) == 2  # the refused writer's folders are gone


def test_a_race_for_the_commit_itself(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "a")], "k long, v string")
    store.commit({"c": a}, 0)
    with pytest.raises(Conflict):
        store._publish({"version": 1, "time": 0, "note": "", "collections": {}})
    assert rows(store.read("c")) == [(1, "a")] and not [p for p in (tmp_path / "commits").iterdir() if not p.name.endswith(("json", "crc"))]


def test_updates_are_made_anew_after_a_conflict(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path))
    one = lambda k, v: spark.createDataFrame([(k, v)], "k long, v string")
    store.update("c", lambda base: upserted(base, one(1, "a"), ["k"]))
    calls = []

    def change(base):
        calls.append(1)
        if len(calls) == 1:
            DocumentStore(spark, str(tmp_path)).update("c", lambda b: upserted(b, one(2, "b"), ["k"]))
        return upserted(base, one(1, "c"), ["k"])

    assert store.update("c", change) == 3 and len(calls) == 2
    assert rows(store.read("c")) == [(1, "c"), (2, "b")]
    with pytest.raises(KeyError):
        store.read("none")
    store.commit({"d": one(5, "d")}, 3, removed=["c"])
    assert store.collections() == ["d"] and store.clear(1) == 3 and store.versions() == [0, 4]
    assert len(list((tmp_path / "data").iterdir())) == 1


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_planted_breaks_are_found(spark, monkeypatch, bits):
    monkeypatch.setattr(lineage, "SEGMENT_BITS", bits)
    stored = []
    for chain in ("hot", "b", None):
        last = ""
        for n in range(200 if chain == "hot" else 5):
            payload = None if n == 3 else f"{chain}{n}"
            last = hashlib.sha256(f"{last}|{payload or ''}".encode()).hexdigest()
            stored.append((chain, n, payload, last))
    df = spark.createDataFrame(stored, "chain string, n long, payload string, hash string")
    assert lineage.verified_chain(df, "chain", ["n"], "payload", "hash").where("NOT valid").count() == 0
    bad = df.where("NOT (chain <=> 'hot' AND n = 150)").withColumn("payload", F.when(F.expr("chain = 'hot' AND n = 20"), "changed").otherwise(F.col("payload"))).withColumn("hash", F.when(F.expr("chain = 'b' AND n = 2"), "0").otherwise(F.col("hash")))
    got = {(r.chain, r.n) for r in lineage.verified_chain(bad, "chain", ["n"], "payload", "hash").where("NOT valid").collect()}
    assert got == {("hot", 20), ("hot", 151), ("b", 2), ("b", 3)}
    first = {r.chain: (r.n, r.broken, r.first_break) for r in lineage.first_breaks(lineage.verified_chain(bad, "chain", ["n"], "payload", "hash"), "chain", "n").collect()}
    assert first == {"hot": (199, 2, 20), "b": (5, 2, 2), None: (5, 0, None)}
