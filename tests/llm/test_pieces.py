"""SentencePiece encoding by prefix tables against the sentencepiece library."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import sentencepiece
from conftest_llm import AWKWARD, plain
from hypothesis import given, settings, strategies as st

from brightloom.llm import encoding, piece_prefix

PATH = encoding.tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LONG = ["word " * 200_000, "x" * 300_000, " " * 5000, "ab\n\n  cd " * 40_000, "日本語🎉" * 50_000]

texts = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("   \n\t▁aeinorst'.é日🎉\x1c\x85　")), max_size=60)


@given(texts)
@settings(max_examples=500, deadline=None)
def test_encoder_equals_library(text):
    own = piece_prefix.piece_encoder(PATH)
    ids = LIBRARY.encode(text)
    assert own.encode(text).tolist() == ids
    assert own.decode(own.encode(text)) == LIBRARY.decode(ids)


@given(st.lists(st.sampled_from([i for i in range(32000) if not LIBRARY.is_byte(i)]), max_size=8))
@settings(max_examples=500, deadline=None)
def test_joined_pieces_merge_as_in_the_library(ids):
    text = "".join(LIBRARY.id_to_piece(i) for i in ids).replace("▁", " ")
    assert piece_prefix.piece_encoder(PATH).encode(text).tolist() == LIBRARY.encode(text)


@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, 31999)), max_size=8))
@settings(max_examples=500, deadline=None)
def test_any_ids_decode_as_in_the_library(ids):
    assert piece_prefix.piece_encoder(PATH).decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_very_long_texts(text):
    own = piece_prefix.piece_encoder(PATH)
    ids = own.encode(text)
    assert ids.tolist() == LIBRARY.encode(text) and own.decode(ids) == text


def test_pairs_merged_in_full_give_the_same(monkeypatch):
    """Tokens whose merges don't come in order of rank are tested pair by pair by merging."""
    own, full = piece_prefix.PieceEncoder(PATH), piece_prefix.PieceEncoder(PATH)
    full.left = dict.fromkeys(full.left)
    for text in ("An unmerged sentence, with  spaces\nand words.", " " * 40 + "indented", "ththere onandth"):
        assert full.encode(text).tolist() == own.encode(text).tolist() == LIBRARY.encode(text)


def digest(text):
    ids = [*LIBRARY.encode(text or ""), LIBRARY.eos_id()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


def test_digests(awkward, empty):
    got = piece_prefix.token_digests(awkward)
    assert plain(got.collect()) == plain((i, *digest(t)) for i, t in AWKWARD)
    assert piece_prefix.token_digests(empty).collect() == []


def test_digests_of_documents(documents):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_prefix.token_digests(documents).collect()}
    assert got == {r.doc_id: digest(r.text) for r in documents.collect()}


def test_documents_round_trip(awkward):
    encoded = piece_prefix.encode_documents(awkward)
    assert all(r.ids[-1] == LIBRARY.eos_id() for r in encoded.collect())
    assert plain(piece_prefix.decode_documents(encoded).collect()) == plain((i, t or "") for i, t in AWKWARD)
