"""Alignment of two tokenizers against quadratic interval comparisons in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import sentencepiece
from conftest_llm import AWKWARD, plain
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from brightloom.llm import alignment, encoding

BYTE, PIECE = encoding.tokenizer_path("byte_bpe_50k.json"), encoding.tokenizer_path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
A.encode_special_tokens = True
BACK = {c: b for b, c in encoding.byte_symbols().items()}


def intervals(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def aligned(text):
    """A's ids, B's ids, groups and links of a text, or None where it has no tokens."""
    if not text:
        return None
    a = [(i, bytes(BACK[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return None
    a, b = intervals(a), intervals(b)
    links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 3000 else swept(a, b)
    common, groups, last = sorted({e for _, _, e in a} & {e for _, _, e in b}), [], 0
    i = j = 0
    for end in common:
        xs, ys = [], []
        while i < len(a) and a[i][2] <= end:
            xs.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= end:
            ys.append(str(b[j][0]))
            j += 1
        groups.append(",".join(xs) + "|" + ",".join(ys))
        last = end
    assert last == a[-1][2]
    return len(a), len(b), groups, links


def swept(a, b):
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


def digests(documents):
    found = [(i, aligned(t)) for i, t in documents]
    counts = Counter(pair for _, f in found if f for pair in f[3])
    top: dict = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        best = sum(counts[p] == top[p[1]] for p in links)
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return plain(out)


texts = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("   \n\taeinorst'.é日🎉<|endoftext|>\x1c\x85　")), max_size=50)


@given(st.lists(texts, max_size=6))
@settings(max_examples=150, deadline=None)
def test_groups_of_slices(batch):
    part = alignment.Slice()
    for k, text in enumerate(batch):
        part.add(k, text)
    found = alignment.align(part, alignment.aligner(BYTE, PIECE))
    for k, text in enumerate(batch):
        want = aligned(text)
        got = "".join(found["texts"][c] for c in found["occurrences"][k])
        assert got == ("".join(g + ";" for g in want[2]) if want else "")


def test_digests(awkward, empty, monkeypatch):
    want = digests(AWKWARD)
    assert plain(alignment.document_alignment(awkward).collect()) == want
    assert alignment.document_alignment(empty).collect() == []
    monkeypatch.setattr(alignment, "SLICE", 20)
    monkeypatch.setattr(alignment, "WINDOW", 3)
    assert plain(alignment.document_alignment(awkward).collect()) == want


def test_odd_texts(spark):
    documents = [(1, "a ▁ b"), (2, " leading and trailing "), (3, "<|endoftext|> <s> </s> <0x41>"), (4, "x" * 200_000), (5, "many words " * 30_000), (6, " " * 3000), (7, "日本語🎉" * 10_000), (8, "\n\n a\t b")]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert plain(alignment.document_alignment(df).collect()) == digests(documents)


def test_documents(documents):
    want = digests([(r.doc_id, r.text) for r in documents.collect()])
    assert plain(alignment.document_alignment(documents).collect()) == want


def test_alignments_and_counts(awkward):
    got = {(r.doc_id, r.groups) for r in alignment.alignments(awkward).collect()}
    assert got == {(i, ";".join(f[2]) if (f := aligned(t)) else "") for i, t in AWKWARD}
    counts = Counter(p for _, t in AWKWARD if (f := aligned(t)) for p in f[3])
    assert {(r.a, r.b): r["count"] for r in alignment.pair_counts(alignment.slice_rows(awkward)).collect()} == counts
