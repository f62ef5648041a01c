"""Token store, prefix BPE and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import AWKWARD, plain
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from brightloom.llm import encoding, packing, prefix_bpe, tokenstore

BYTE, WORD = encoding.tokenizer_path("byte_bpe_50k.json"), encoding.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


texts = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdtrevml0123aAéÉßΣσ.,!-\x1c\x85 　")), max_size=60)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_lookup_equals_library(text):
    for path in (BYTE, WORD):
        assert encoding.pieces(path).encode(text).tolist() == Tokenizer_of(path).encode(text, add_special_tokens=False).ids


@given(texts)
@settings(max_examples=300, deadline=None)
def test_prefix_encoder_equals_library(text):
    own, library = prefix_bpe.prefix_encoder(WORD), Tokenizer_of(WORD)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_prefix_encoder_without_a_letter(tmp_path):
    file = json.loads(Path(WORD).read_text(encoding="utf-8"))
    model = file["model"]
    model["vocab"] = {t: i for t, i in model["vocab"].items() if "q" not in t}
    model["merges"] = [m for m in model["merges"] if "q" not in "".join(m)]
    (tmp_path / "vocabulary.json").write_text(json.dumps(file), encoding="utf-8")
    encoder = prefix_bpe.PrefixEncoder(str(tmp_path / "vocabulary.json"))
    assert len(encoder.encode("plain words")) and encoder.encode("") == b""
    with pytest.raises(ValueError, match="queue"):
        encoder.encode("a queue")


_cache: dict = {}


def Tokenizer_of(path):
    if path not in _cache:
        _cache[path] = Tokenizer.from_file(path)
    return _cache[path]


@given(st.lists(st.integers(0, 2**41), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    code = tokenstore.EliasFano.encode(np.array(values, np.uint64))
    assert code.decode().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    code = tokenstore.EliasFano.encode(ends)
    assert 8 * (len(code.low) + len(code.high) + len(code.samples)) / len(ends) < 2.5 + np.log2(1000)


def test_prefix_digests(awkward, libraries, empty):
    got = plain(prefix_bpe.token_digests(awkward).collect())
    want = []
    for doc, text in AWKWARD:
        ids = libraries[WORD].encode(text or "", add_special_tokens=False).ids
        said = libraries[WORD].decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == plain(want)
    assert prefix_bpe.token_digests(empty).count() == 0
    assert prefix_bpe.encode_documents(awkward).where("doc_id = 1").first().ids == libraries[WORD].encode(AWKWARD[0][1]).ids


@pytest.mark.parametrize("shard", [1, 200, 1 << 21])
def test_store_reads_back(spark, awkward, libraries, shard, tmp_path):
    tokenstore.write_tokens(awkward, str(tmp_path / "s"), BYTE, shard_ids=shard)
    got = tokenstore.read_tokens(spark, str(tmp_path / "s")).collect()
    known = {}
    for doc, text in AWKWARD:
        ids = np.array([*libraries[BYTE].encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        known.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
    ordered = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in known.items()}


def test_empty_store(empty):
    assert tokenstore.store_documents(empty).count() == 0


def check_packing(rows, capacity):
    lanes = defaultdict(list)
    for r in rows:
        lanes[r.sequence_id].append((r.offset, r.length))
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= capacity
    return len(lanes)


def best_fit_decreasing(sizes, capacity):
    from bisect import bisect_left, insort

    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        if gap > s:
            insort(gaps, gap - s)
    return n


@given(st.lists(st.integers(1, 40), max_size=120), st.just(40))
@settings(max_examples=200, deadline=None)
def test_sweep_equals_best_fit_decreasing(sizes, capacity):
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    seen, lanes = defaultdict(list), defaultdict(list)
    for size, lo, hi, each, first, base in packing.sweep(counts, capacity):
        seen[size] += range(lo, hi)
        for r in range(lo, hi):
            lanes[first + (r - lo) // each].append((base + (r - lo) % each * size, size))
    assert {k: sorted(v) for k, v in seen.items()} == {s: list(range(n)) for s, n in counts.items()}
    for lane in lanes.values():
        at = 0
        for offset, size in sorted(lane):
            assert offset == at
            at += size
        assert at <= capacity
    # Gaps of one size are interchangeable, so the number of sequences is that of the plain rule.
    assert len(lanes) == best_fit_decreasing(sizes, capacity)


def test_pack_documents(awkward, documents, libraries, empty):
    for df in (awkward, documents):
        rows = packing.pack_documents(df).collect()
        n = check_packing(rows, 2048)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*libraries[WORD].encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(r.doc_id, i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
        assert plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == plain(want)
        assert n == best_fit_decreasing([w[3] for w in want], 2048)
    assert packing.pack_documents(empty).count() == 0


def test_pack_keeps_columns_of_clashing_names(spark):
    rows = [(i, 0, 1 + i % 7, i, f"a{i}", i, i, -1) for i in range(60)] + [(None, 0, 3, 9, None, None, None, -1)] * 3
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long, _salt string, _rank long, lo long, offset long")
    got = packing.pack(items, 10)
    assert sorted(got.columns) == sorted([*items.columns, "sequence_id"])
    done = got.collect()
    check_packing(done, 10)
    assert {(r.doc_id, r["_salt"], r["_rank"], r.lo) for r in done} == {(r[0], r[4], r[5], r[6]) for r in rows}
