"""Search, language model, near-duplicates and the pipeline against brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import AWKWARD, plain
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import automaton, components, mips, packing, pii, quality, simhash


def test_search_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))
    rows = mips.search(df).collect()
    data = df.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = v @ v[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert np.allclose([g[2] for g in got], [score[ids == g[1]][0] for g in got])
        hits += len({g[1] for g in got} & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_search_in_a_crowd(spark):
    """A third of all rows are near-copies of one vector: more than any fixed depth would score."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6000, 32))
    v[::3] = v[0] + rng.normal(size=(2000, 32)) * 0.05
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = v.astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in mips.search(rows).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    wide = v.astype(float)
    for q in range(0, 6000, 20):
        score = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(6000), -score))[:21] if i != q][:20]
        hits += len(found[q] & set(order))
    assert hits / (300 * 20) >= 0.97


def test_search_with_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 5.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [])]
    got = mips.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert plain((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == plain([(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (0, 4, 3, -1.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (20, 4, 3, -1.0)])
    assert mips.search(got.select(F.col("query_id").alias("vec_id"), F.array("score").alias("embedding")).limit(0)).count() == 0


def test_copies_are_ranked_by_id(spark):
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(100)]
    got = mips.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 20]


def test_parallel_error_weighs_more():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = mips.Quantiser.train(x)
    assert q.eta > 1 and mips.parallel_weight(2) > 1 and mips.parallel_weight(512) > mips.parallel_weight(64)
    strong = mips.Quantiser(16, q.centres, 8.0)
    shown = {e: e_.centres[np.arange(8), e_.encode(x)].reshape(-1, 16) for e, e_ in (("plain", mips.Quantiser(16, q.centres, 1.0)), ("strong", strong))}
    along = {k: np.abs(((x - s) * x).sum(1)).mean() for k, s in shown.items()}
    assert along["strong"] < along["plain"]
    scan = strong.scan(x[:5], mips.pack(strong.encode(x)))
    assert np.allclose(scan, x[:5] @ shown["strong"].T, atol=1e-4)


def plain_model(rows):
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, (_, t) in enumerate(rows)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    counts, pairs = Counter(), Counter()
    for i, own in tokens.items():
        if not held[i]:
            counts.update(own)
            pairs.update(zip(own, own[1:], strict=False))
    n, types = sum(counts.values()), len(counts)
    return tokens, held, counts, pairs, n, types


def plain_scores(rows):
    """Scores by a plain walk over the automaton, read left to right."""
    tokens, held, counts, pairs, n, types = plain_model(rows)
    seen, paired = Counter(counts.values()), Counter(pairs.values())
    d1, d2 = automaton._discount(seen[1], seen[2]), automaton._discount(paired[1], paired[2])
    used, taken = Counter(), Counter()
    for (a, w), c in pairs.items():
        if c > 1:
            used[a] += (c - d2) / counts[a]
            taken[a] += (counts[w] - d1) / n
    for h in sorted(used, key=lambda a: (-counts[a], a))[::50]:  # what can follow a state sums to one
        arcs = {w for (a, w), c in pairs.items() if a == h and c > 1}
        backed = sum((c - d1) / n for w, c in counts.items() if w not in arcs) + d1 * types / n
        assert abs(used[h] + backed * (1 - used[h]) / (1 - taken[h]) - 1) < 1e-9
    out = []
    for i, (doc, _) in enumerate(rows):
        base = score = 0.0
        before = None
        for w in tokens[i]:
            c = counts[w]
            base += math.log10((c + 1) / (n + types + 1))
            root = math.log10((c - d1) / n if c else d1 * types / n)
            if pairs[before, w] > 1:
                score += math.log10((pairs[before, w] - d2) / counts[before])
            else:
                score += root + (math.log10((1 - used[before]) / (1 - taken[before])) if before in counts else 0.0)
            before = w
        out.append((doc, held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, round(base, 5), round(score, 5)))
    return out


def scored(df):
    return plain((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in automaton.score_documents(df).collect())


def test_automaton(awkward, documents, empty):
    for df in (awkward, documents):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert scored(df) == plain(plain_scores(rows))
    out = [r for r in automaton.score_documents(documents).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert automaton.score_documents(empty).count() == 0
    # Without training texts all is unknown.
    only = documents.where(automaton.is_held_out())
    assert {r.score for r in automaton.score_documents(only).collect()} == {0.0}


@pytest.mark.parametrize("cached", [0, 40, 400])
def test_automaton_with_few_words_broadcast(documents, monkeypatch, cached):
    """Parts of few tokens and states dealt over several: scores are those of all words and pairs."""
    for name, value in (("CACHED_WORDS", cached), ("PART_TOKENS", 3000), ("SLICE_BYTES", 20_000)):
        monkeypatch.setattr(automaton, name, value)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert scored(documents) == plain(plain_scores(rows))


def test_automaton_carries_its_state():
    """Words a, b, c and an unknown one: an arc a b; after the unknown word the root is the state."""
    a, b, c, unknown = range(4)
    reader = automaton.Reader([-1.0, -2.0, -3.0, -4.0], [-0.5, -0.25, 0.0, -9.0, 0.0], {a * 4 + b: -0.125, 4 * 4 + c: -0.75}, [True, True, True, False])
    assert reader.leads == [a, b, c, reader.size]
    assert reader.read([]) == 0.0
    assert reader.read([a, b]) == -1.0 - 0.125  # the arc
    assert reader.read([b, a]) == -2.0 - 0.25 - 1.0  # b's failure arc, then the root's
    assert reader.read([unknown, c]) == -4.0 - 0.75  # state root, not the unknown word
    assert reader.read([a, unknown, b]) == -1.0 - 0.5 - 4.0 - 2.0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=3):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in own}


def near_rows():
    base = " ".join(f"word{i % 97} x{i}" for i in range(400))
    return [(100 + i, base + (f" tail{i}" if i else "")) for i in range(25)] + [(200 + i, base) for i in range(10)]


def test_near_duplicates(spark, awkward, documents, empty):
    near = spark.createDataFrame(near_rows(), "doc_id long, text string")
    for df in (awkward, documents.select("doc_id", "text").unionByName(near)):
        rows = df.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in rows]
        root = plain_components(prints)
        least = {}
        for r, p in zip(rows, prints, strict=True):
            if r.doc_id is not None:
                least[root[p]] = min(least.get(root[p], r.doc_id), r.doc_id)
        want = [(r.doc_id, f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints, strict=True)]
        assert plain(simhash.near_duplicates(df).collect()) == plain(want)
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
        assert kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize(("block", "kept"), [(16, simhash.HISTOGRAM_BITS), (simhash.BLOCK, simhash.HISTOGRAM_BITS), (16, 5)])
def test_links_within_dense_and_far_values(spark, block, kept):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 4, dtype=np.int64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(700):
            x = c
            for b in rng.integers(0, 62, rng.integers(1, 6)).tolist():
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.fp: r.root for r in simhash.classes_of(df, block=block, kept=kept).collect()}
    want = plain_components(fps)
    groups, expect = {}, {}
    for x in fps:
        groups.setdefault(roots[x], set()).add(x)
        expect.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_block_counts_of_wide_parts(spark):
    """Parts of 32 bits with 16 bits counted: values are expected to be as rare as all 32 bits make them,
    but for those that are known to be common."""
    bits = [list(range(32)), list(range(32, 64))]
    counts = [np.full(1 << 16, 10**9 >> 16, np.int64)] * 2  # 10 ** 9 fingerprints of even bits
    hot = 0xABCD0123
    crowds = simhash.Crowds(bits, counts, [{hot: 5_000_000}, {}])
    values = np.random.default_rng(1).integers(0, 2**32, 10_000)
    for g in (0, 1):
        rows, probes = crowds.blocks(g, values, simhash.BLOCK)
        assert rows.max() == probes.max() == 1
    near = np.array([hot, hot ^ 1, hot ^ 1 << 31, hot ^ 3])
    rows, probes = crowds.blocks(0, near, simhash.BLOCK)
    many = 1 + 5_000_000 // simhash.BLOCK
    assert rows.tolist() == [many, 1, 1, 1] and probes.tolist() == [many, many, many, 1]
    # The counts of common values are those of all rows; the histogram alone would take them as rare.
    fps = np.unique(np.concatenate([(np.arange(300) << 32) | 0x70001, np.arange(300) * 0x1E3779B97F4A7B]))
    values = simhash._values(fps, bits)
    tables = [np.bincount(values[:, g] & 0xFFFF, minlength=1 << 16) for g in (0, 1)]
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    assert simhash.hot_values(df, bits, tables, 100) == [{0x70001: 300}, {}]
    assert simhash.hot_values(df, [[0]], [np.zeros(2, np.int64)], 100) == [{}]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert len(got) == 83 and len({got[i] for i in range(81)}) == 1 and got[500] == got[501] != got[0]


def test_pipeline(spark, sf_dir, documents):
    """Each stage against its own brute force, on what the stage before kept."""
    quality_kept = corpus_pipeline.STAGES[0][1](spark, documents, sf_dir).cache()
    verdicts = {r.doc_id: r.kept for r in quality.quality(documents).collect()}
    assert {r.doc_id for r in quality_kept.collect()} == {d for d, k in verdicts.items() if k}
    one = corpus_pipeline.STAGES[1][1](spark, quality_kept, sf_dir).cache()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in quality_kept.collect()}
    root = plain_components(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(least.get(root[p], d), d)
    assert {r.doc_id for r in one.collect()} == set(least.values())
    clean = corpus_pipeline.STAGES[2][1](spark, one, sf_dir).cache()
    assert clean.columns == documents.columns
    before = {r.doc_id: r for r in one.collect()}
    spans = {r.doc_id: r.spans for r in pii.personal_digests(one).collect()}
    for r in clean.collect():
        text, at, out = before[r.doc_id].text, 0, []
        for s in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x)):
            if s[0] >= at:
                out += [text[at : s[0]], f"[{s[2].upper()}]"]
            at = max(at, s[1])
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[3][1](spark, clean, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(least.values())
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert plain(got.select(*key).collect()) == plain(packed.select(*key).collect())


def test_pipeline_with_awkward_rows(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == awkward.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in out} == {1, None, 11} and len(AWKWARD) == 16
    assert packing.pack_documents(docs.limit(0)).count() == 0
