"""Crawls against a plain breadth-first search; running sums over all rows."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from brightloom.operators import crawl


def searched(edges, roots):
    depth, queue = {r: 0 for r in roots}, deque(roots)
    while queue:
        n = queue.popleft()
        for a, b in edges:
            if a == n and b not in depth:
                depth[b] = depth[n] + 1
                queue.append(b)
    return depth


def crawled(spark, edges, roots, most=None):
    got = crawl.crawl(spark.createDataFrame(edges, "node string, child string"), spark.createDataFrame([(r,) for r in roots], "node string"), most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("direct", [1, 8])
def test_random_graphs(spark, monkeypatch, direct):
    monkeypatch.setattr(crawl, "DIRECT", direct)
    r = random.Random(direct)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(75)] + [(f"n{i}", f"p{i}0") for i in range(5)] + [(f"p{i}{j}", f"p{i}{j + 1}") for i in range(5) for j in range(9)] + [("p19", "n7"), ("x1", "x2"), ("x2", "x1")]
    want = searched(edges, ["n1", "n2"])
    assert crawled(spark, edges, ["n1", "n2"]) == want
    for most in (1, 7, 30):
        first = sorted(want.items(), key=lambda x: (x[1], x[0]))[:most]
        assert crawled(spark, edges, ["n1", "n2"], most) == dict(first)


def test_a_long_path_ends_complete(spark):
    edges = spark.range(10_000).select(F.col("id").alias("node"), (F.col("id") + 1).alias("child"))
    got = crawl.crawl(edges, spark.createDataFrame([(0,)], "node long"))
    assert got.agg(F.count("*"), F.max("depth"), F.count_if(F.col("node") != F.col("depth"))).first() == (10_001, 10_000, 0)


def test_nothing_to_crawl(spark):
    assert crawled(spark, [], ["a"]) == {"a": 0}
    assert crawled(spark, [("a", "a"), ("b", None), (None, "a")], ["b", "b", None]) == {"b": 0}
    assert crawled(spark, [("a", "b")], ["a"], 0) == {}


def test_running_sums(spark):
    rows = [(r % 7, f"k{r}", r) for r in range(500)]
    df = spark.createDataFrame(rows, "a long, b string, v long").repartition(7)
    total, want = 0, {}
    for a, b, v in sorted(rows):
        total += v
        want[b] = total
    assert {r.b: r.total for r in crawl.running(df, ["a", "b"], F.col("v"), "total").collect()} == want
    assert sorted(r.n for r in crawl.numbered(df, ["a", "b"]).collect()) == list(range(1, 501))
