"""Inverted treaps: their shape, exact ranks against counting all postings, and what the search skips."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from compare import connect, rows
from conftest_llm import AWKWARD
from hypothesis import given, settings, strategies as st

from brightloom.llm import catalog, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(documents, items):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(i, Counter(words(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, size in docs:
            m = 10 + (90 * size * n) // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(words(text)) if w in c), i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(x for x in scores if x[0])[:10], 1)]
    return sorted(out, key=repr)


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=30), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_preorder(lists):
    impacts, counts = np.array(sum(lists, [])), np.array([len(x) for x in lists])
    ends = np.cumsum(counts)
    to, sizes = treaps.preorder(impacts, np.repeat(ends - counts, counts), np.repeat(ends, counts))

    def walk(a, b, place):
        if a < b:
            top = max(range(a, b), key=lambda i: (impacts[i], -i))
            assert (to[top], sizes[top]) == (place, top - a)
            walk(a, top, place + 1)
            walk(top + 1, b, place + 1 + top - a)

    for end, count in zip(ends, counts, strict=True):
        walk(end - count, end, end - count)


def test_long_sorted_lists_need_few_rounds():
    n = 200_000
    for impacts in (np.arange(n), np.arange(n)[::-1], np.zeros(n, np.int64)):
        to, _ = treaps.preorder(impacts, np.zeros(n, np.int64), np.full(n, n))
        assert sorted(to.tolist()) == list(range(n))


def test_equals_scoring_everything(spark, awkward, monkeypatch):
    items = [(1, "The lazy dog and the WORD"), (1, "tie"), (2, "tie tie"), (3, None), (4, "..."), (None, "word 10 é🎉"), (2, "tie tie"), (5, "x" * 5000), (6, "日本語 id id only no")]
    df = spark.createDataFrame(items, "item_id long, text string")
    for shard, few in ((treaps.SHARD, treaps.FEW), (200, 1)):
        monkeypatch.setattr(treaps, "SHARD", shard)
        monkeypatch.setattr(treaps, "FEW", few)
        got = treaps.search_documents(awkward, df.selectExpr("*", "7 AS term", "1 AS shard", "2 AS item"))
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(AWKWARD, items)


def test_very_long_texts_and_many_blocks(spark, monkeypatch):
    documents = [(i, f"common w{i % 7} w{i % 11} " + "filler " * (i % 5)) for i in range(300)] + [(300, "common rare " * 400_000), (301, "a" * 3_000_000)]
    items = [(i, f"common w{i} w{i + 3} rare") for i in range(20)]
    monkeypatch.setattr(treaps, "BLOCK", 3)
    got = treaps.search_documents(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(documents, items)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert treaps.search_documents(empty, items).collect() == []
    assert treaps.search_documents(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_documents_equal_sql(spark, sf_dir):
    got, want = catalog.queries()["op11_inverted_treaps"](spark, sf_dir).toPandas(), connect(sf_dir).sql(treaps.ORACLE).df()
    assert len(want) and rows(got) == rows(want)


def test_most_postings_are_skipped():
    """One rare heavy term beside a common one: the common one's treap is hardly read."""
    n = 100_000
    rng = np.random.default_rng(3)

    def treap(weight, documents, impacts):
        to, sizes = treaps.preorder(impacts, np.zeros(len(documents), np.int64), np.full(len(documents), len(documents)))
        lefts = np.empty(len(documents), "<i4")
        lefts[to] = sizes
        return treaps.Treap(weight, documents.astype("<i4").tobytes(), impacts.astype("<i4").tobytes(), lefts.tobytes())

    lists = {w: (np.sort(rng.choice(n, size, replace=False)), rng.integers(1, 1000, size)) for w, size in ((1, n), (3000, 50))}
    best, added = treaps.best_of_shard([treap(w, d, i.astype(np.int64)) for w, (d, i) in lists.items()], n, 1)
    scores = defaultdict(int)
    for w, (d, i) in lists.items():
        for document, impact in zip(d.tolist(), i.tolist(), strict=True):
            scores[document] += w * impact
    assert sorted(best, reverse=True) == sorted(((s, -d) for d, s in scores.items()), reverse=True)[:10]
    assert added < n / 3
