"""Token ids of whole texts from public vocabulary files, for the operators that count or store ids.

Both vocabularies merge inside pieces that never cross white space, so each distinct piece is encoded
once per worker and then looked up. A missing piece is merged by tiktoken's core over the ranks of the
same vocabulary file; tests hold the ids against the tokenizers library. A text that holds a special
token's string goes to the tokenizers library as a whole, and so does every ``CHECK_EVERY``-th new piece,
where a difference is an error. The lookup is cleared at ``CACHE_ENTRIES``
pieces, which bounds a worker's memory; it affects speed only.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_ENTRIES = 500_000
#: Of the pieces that a worker merges, every so many-th is held against the tokenizers library.
CHECK_EVERY = 256

#: The pre-tokeniser patterns that the two vocabulary files name.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Stands for the mark at a word's end; this byte never occurs in UTF-8.
END_BYTE = b"\xff"

ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_double_space = re.compile(r"\s\s")
_inner_space = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Tokens with ids, merges in order, and special tokens with ids of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in data["model"]["merges"]]
    return data["model"]["vocab"], merges, {t["content"]: t["id"] for t in data["added_tokens"]}


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    vocab, _, special = vocabulary(path)
    back = {c: b for b, c in byte_symbols().items()}
    suffix = "</w>" if "a</w>" in vocab else ""
    ranks = {}
    for token, i in vocab.items():
        if token in special:
            continue
        ends = bool(suffix) and token.endswith(suffix)
        body = token[: -len(suffix)] if ends else token
        ranks[bytes(back[c] for c in body) + END_BYTE * ends] = i
    pattern = WORD_PATTERN if suffix else BYTE_PATTERN
    core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return bool(suffix), core, whole, special


class Pieces(dict):
    """Piece -> its ids as little-endian 16-bit numbers (both vocabularies have fewer than 65,536)."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import regex

        self.words, self.core, self.whole, self.special = _encoder(path)
        self.find = regex.compile(WORD_PATTERN).findall
        self.met = 0

    def __missing__(self, piece: str) -> bytes:
        if recent(piece):
            ids = self.whole.encode(piece, add_special_tokens=False).ids
        elif self.words:
            single, ids = self.core._core_bpe.encode_single_piece, []
            for word in self.find(normal(piece)):
                ids += single(word.encode() + END_BYTE)
        else:
            ids = self.core.encode_ordinary(piece)
        self.met += 1
        if self.met % CHECK_EVERY == 0 and ids != self.whole.encode(piece, add_special_tokens=False).ids:
            raise ValueError(f"the libraries differ on {piece!r}")
        value = self[piece] = array("H", ids).tobytes()
        return value

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, as 32-bit little-endian numbers."""
        if any(s in text for s in self.special) or (self.words and ODD_SPACE.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self) > CACHE_ENTRIES:
            self.clear()
        if self.words:
            data = b"".join(map(self.__getitem__, text.split()))
        else:
            # A space between two other characters begins a piece; each keeps the space before it.
            cut = _inner_space.split(text) if _double_space.search(text) else text.split(" ")
            if len(cut) == 1:
                data = self[text] if text else b""
            else:
                data = (self[cut[0]] if cut[0] else b"") + b"".join(map(self._spaced, cut[1:]))
        return np.frombuffer(data, "<u2").astype("<u4")

    def _spaced(self, piece: str) -> bytes:
        return self[" " + piece]


def recent(piece: str) -> bool:
    """It holds characters that Python's Unicode tables don't have; the libraries' tables differ on them."""
    return not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece)


def normal(text: str) -> str:
    """NFC and lower case, each character alone (so no final sigma)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One lookup per worker process and vocabulary file."""
    return Pieces(path)
