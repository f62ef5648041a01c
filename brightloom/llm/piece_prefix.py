"""SentencePiece encoding by a prefix table of last tokens, and decoding.

A model of merge type joins the best-scored adjacent pair whose joined text is a piece, the leftmost of
equals. Two tokens may stand side by side if their joined text merges back to just them, and a sequence
is the encoding of its text exactly if each token is its own encoding and each neighbouring pair may
stand so: before the first merge across a border, each token merges as if it stood alone. Hence every
prefix of a text has one last token. An automaton over the pieces lists the tokens that end at each
place; one becomes the prefix's last token if it begins the text or fits the last token of the prefix
before it. The ids are recovered backwards, in time linear in the text.

No piece goes on past white space (checked when a model is read), so texts are cut at single spaces and
known chunks are looked up. Characters without a piece are written as bytes and never merge.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass
from .encoding import tokenizer_path

SPACE = "▁"
NEVER = float("inf")
#: A worker's lookups are cleared at so many entries; only chunks of at most so many characters enter.
ENTRIES, SHORT = 400_000, 64
#: Ids of a text that are turned into digests at once.
BLOCK = 1 << 20
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))
_double_space = re.compile(r"\s\s")
_inner_space = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut at each single space between other characters; all but the first are without it."""
    return _inner_space.split(text) if _double_space.search(text) else text.split(" ") if text[:1] != " " != text[-1:] else _inner_space.split(text)


class PieceEncoder:
    """Encoder and decoder of a SentencePiece model of merge type with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        if model.normalize(f"Åﬁ  {SPACE}\x00\n ") != f"{SPACE}Åﬁ{SPACE * 3}\x00\n{SPACE}":
            raise ValueError("only models that change nothing but spaces are read")
        self.end = model.eos_id()
        self.byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(count) if model.is_byte(i)}
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        if any(model.is_unused(i) for i in plain) or any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.text.values()) or len(self.byte) < 256:
            raise ValueError("only models with byte fallback, without unused pieces and without inner spaces are read")
        self.id = {t: i for i, t in self.text.items()}
        self.rank = {t: -model.get_score(i) for t, i in self.id.items()}
        letters = {c for t in self.id for c in t}
        if not letters <= self.id.keys():
            raise ValueError("the model lacks pieces of single letters")
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(letters)))}]+)")
        # A token's pieces at its right and left edge, each with the rank of the merge that ends it;
        # None where merges don't come in order of rank, so that pairs are merged in full.
        self.right: dict[int, list | None] = {}
        self.left: dict[int, list | None] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            final, left, right, ordered = self.merged(t)
            if final == [t]:
                self.left[i], self.right[i] = (left, right) if ordered else (None, None)
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        surface = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.surface = [surface.get(i, " ⁇ ".encode() if model.is_unknown(i) else b"") for i in range(count)]
        self.decimal = [str(i) for i in range(count)]

    def merged(self, text: str) -> tuple[list[str], list, list, bool]:
        """Merge a short text pair by pair: its tokens, the pieces at both edges with their ends, and
        whether the merges came in order of rank."""
        parts, left, right, last, ordered = list(text), [], [], -NEVER, True
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NEVER:
                break
            ordered &= best >= last
            last = best
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, [*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)], ordered

    def fits(self, a: int, b: int) -> bool:
        """Nothing merges across the border of the two tokens."""
        if len(self.pairs) > 2 * ENTRIES:
            self.pairs.clear()
        x, y = self.right[a], self.left[b]
        if x is None or y is None:
            apart = self.merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        else:
            i = j = 0
            while True:
                (p, p_ends), (q, q_ends) = x[i], y[j]
                rank = self.rank.get(p + q, NEVER)
                # Of equal ranks the left merge comes first: those inside the left token, then the one across.
                if rank < p_ends and rank <= q_ends:
                    apart = False
                    break
                if p_ends == q_ends == NEVER:
                    apart = True
                    break
                if p_ends <= q_ends:
                    i += 1
                else:
                    j += 1
        self.pairs[a << 20 | b] = apart
        return apart

    def run(self, text: str) -> array:
        """The ids of a text of known letters."""
        n, known = len(text), self.pairs
        last, size = (array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)) if n > 4096 else ([-1] * (n + 1), [0] * (n + 1))
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if length != end:
                before = last[end - length]
                if before < 0:
                    continue
                ok = known.get(before << 20 | token)
                if ok is None:
                    ok = self.fits(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        ids, at = array("H"), n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def chunk(self, text: str) -> bytes:
        """The ids of a chunk whose spaces are written as in the model, 16 bits each."""
        if (found := self.known.get(text)) is not None:
            return found
        ids = array("H")
        for k, part in enumerate(self.unknown.split(text)):
            ids += array("H", map(self.byte.__getitem__, part.encode())) if k % 2 else self.run(part)
        found = ids.tobytes()
        if len(text) <= SHORT:
            if len(self.known) > ENTRIES:
                self.known.clear()
            self.known[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text without an end id; the empty text has none."""
        if not text:
            return np.zeros(0, np.uint16)
        known, parts = self.known, []
        for part in chunks(text):
            part = SPACE + part
            found = known.get(part)
            parts.append(self.chunk(part.replace(" ", SPACE)) if found is None else found)
        return np.frombuffer(b"".join(parts), np.uint16)

    def pieces(self, ids: np.ndarray):
        """The bytes of the ids' texts, some at a time; the first space is none of the text's."""
        first = True
        for at in range(0, len(ids), BLOCK):
            block = ids[at : at + BLOCK].tolist()
            data = b"".join(map(self.surface.__getitem__, block))
            if first and data:
                spaced = next(i for i in block if self.surface[i]) in self.text and data[:1] == b" "
                data, first = data[spaced:], False
            yield data

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD each."""
        return b"".join(self.pieces(np.asarray(ids))).decode("utf-8", "each_byte")


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ids of every text (null: empty) with the end id, as ``doc_id long, ids array<int>``."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def rows(columns: list[list]) -> dict:
        encoder = piece_encoder(path)
        return {"doc_id": columns[0], "ids": [np.append(encoder.encode(t or "").astype(np.int32), np.int32(encoder.end)) for t in columns[1]]}

    return arrow_pass(_needed(docs), "doc_id long, ids array<int>", rows)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The text of every row of ``encode_documents`` (null ids: empty), as ``doc_id long, text string``."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def rows(columns: list[list]) -> dict:
        encoder = piece_encoder(path)
        return {"doc_id": columns[0], "text": [encoder.decode(np.array(ids or [], np.int64)) for ids in columns[1]]}

    return arrow_pass(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), "doc_id long, text string", rows)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text with its end id and decode it again; digests of both. Null and empty texts have
    the end id alone and decode to the empty text; a null doc_id stays null; repeated rows each give a
    row; other columns are ignored; texts of any length are taken whole."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def rows(columns: list[list]) -> dict:
        encoder = piece_encoder(path)
        out = {"doc_id": columns[0], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in columns[1]:
            ids = encoder.encode(text or "")
            numbers, decoded = hashlib.sha256(), hashlib.sha256()
            for at in range(0, len(ids), BLOCK):
                numbers.update((" ".join(map(encoder.decimal.__getitem__, ids[at : at + BLOCK].tolist())) + " ").encode())
            numbers.update(encoder.decimal[encoder.end].encode())
            for data in encoder.pieces(ids):
                decoded.update(data)
            out["n_tokens"].append(len(ids) + 1)
            out["ids_sha256"].append(numbers.hexdigest())
            out["decoded_sha256"].append(decoded.hexdigest())
        return out

    return arrow_pass(_needed(docs), DIGESTS, rows)


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
