"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is exactly one token that its encoding ends with. An automaton over the
vocabulary lists, at each position, the tokens that end there, longest first; a token is the prefix's
last one if it starts the word, or if the last token of the prefix before it may stand left of it. Two
tokens may stand side by side if merging their joined text yields just them again; that depends on the
two alone and is remembered. Back-pointers from the word's end then give the ids, in time linear in the
word's length for any word.

A word's last symbol carries the end-of-word mark, so symbols are characters: a byte's own number, plus
256 at a word's end.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass
from .encoding import CACHE_ENTRIES, ODD_SPACE, WORD_PATTERN, byte_symbols, normal, recent, tokenizer_path, vocabulary

MARK = "</w>"
NEVER = 1 << 40
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Chunks(dict):
    """Text without white space -> its ids, 32 bits each."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        value = self[chunk] = self.make(chunk)
        return value


class PrefixEncoder:
    """Encoder and decoder of a vocabulary file with end-of-word marks."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        vocab, merges, self.special = vocabulary(path)
        back = {c: b for b, c in byte_symbols().items()}
        self.path, self.back, self.whole = path, back, None

        def symbols(token: str) -> str:
            ends = token.endswith(MARK)
            body = [back[c] for c in (token[: -len(MARK)] if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        words = {i: symbols(t) for t, i in vocab.items() if t not in self.special}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks, parents = {}, {}
        for rank, (a, b) in enumerate(merges):
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            parents[vocab[a + b]] = (vocab[a], vocab[b], rank)
        # A token's pieces at its right and at its left edge, from the single symbol to the token
        # itself, each with the rank of the merge that ends it.
        self.right_edge: dict[int, list] = {}
        self.left_edge: dict[int, list] = {}
        self.automaton = ahocorasick.Automaton()
        for token in sorted(words, key=lambda t: parents[t][2] if t in parents else -1):
            if token in parents:
                left, right, rank = parents[token]
                if left not in self.left_edge or right not in self.right_edge or self.meets(left, right) != "whole":
                    continue
                self.right_edge[token] = [*self.right_edge[right][:-1], (right, rank), (token, NEVER)]
                self.left_edge[token] = [*self.left_edge[left][:-1], (left, rank), (token, NEVER)]
            elif len(words[token]) == 1:
                self.right_edge[token] = self.left_edge[token] = [(token, NEVER)]
            else:
                continue
            self.automaton.add_word(words[token], (token, len(words[token])))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks = Chunks(self.chunk)
        self.find = regex.compile(WORD_PATTERN).findall
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.spaces = re.compile(r"[^\S\x1c-\x1f]+")

    def meets(self, left: int, right: int) -> str:
        """What merging by rank does across the border of two tokens: it crosses it before both are
        made ("early"), merges just the two ("whole"), or leaves them ("apart")."""
        a, b, i, j = self.right_edge[left], self.left_edge[right], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.ranks.get(x << 20 | y, NEVER)
            if x_ends == y_ends == NEVER:
                return "apart" if rank == NEVER else "whole"
            # Of equal pairs the left one merges first.
            if rank < x_ends and rank <= y_ends:
                return "early"
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        if len(self.pairs) > CACHE_ENTRIES:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self.meets(left, right) == "apart"
        return known

    def word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word's bytes."""
        text = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        last, size, known = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.pairs
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if n != end:
                left = last[end - n]
                if left < 0:
                    continue
                fits = known.get(left << 20 | token)
                if fits is None:
                    fits = self.fits(left, token)
                if not fits:
                    continue
            last[end], size[end] = token, n
        ids, at = [], len(text)
        if last[at] < 0 < at:
            raise ValueError(f"no tokens of the vocabulary make up {word!r}")
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return tuple(ids)

    def chunk(self, chunk: str) -> bytes:
        """The ids of text without white space."""
        ids: list[int] = []
        for word in self.split(chunk) if recent(chunk) else self.find(normal(chunk)):
            if (found := self.known.get(word)) is None:
                if len(self.known) > CACHE_ENTRIES:
                    self.known.clear()
                found = self.known[word] = self.word(word.encode())
            ids += found
        return array("I", ids).tobytes()

    def split(self, chunk: str) -> list[str]:
        """Words by the library's own tables, for characters that Python's don't have."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        whole = self.whole
        parts = whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(chunk))
        return [bytes(self.back[c] for c in p).decode() for p, _ in parts]

    def plain(self, text: str) -> bytes:
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        parts = self.spaces.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """All ids of a text, little-endian, 32 bits each. Special tokens' strings are special tokens."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(int(self.special[part]).to_bytes(4, "little") if part in self.special else self.plain(part) for part in self.between.split(text))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as a file without a decoder says; unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in tokens])


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    """One encoder per worker process."""
    return PrefixEncoder(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The token ids of every text (null: empty) as ``doc_id long, ids array<int>``."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def rows(columns: list[list]) -> dict:
        encode = prefix_encoder(path).encode
        return {"doc_id": columns[0], "ids": [np.frombuffer(encode(t or ""), "<u4").astype(np.int32) for t in columns[1]]}

    return arrow_pass(_needed(docs), "doc_id long, ids array<int>", rows)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text; digests of both. Null and empty texts have no ids and decode to
    the empty text; a null doc_id stays null; repeated rows each give a row; other columns are ignored."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def rows(columns: list[list]) -> dict:
        encoder = prefix_encoder(path)
        ids = [encoder.encode(t or "") for t in columns[1]]
        return {
            "doc_id": columns[0],
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids],
        }

    return arrow_pass(_needed(docs), DIGESTS, rows)


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
