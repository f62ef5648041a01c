"""Quality rules over whole texts, with repetition found in the buckets of a suffix array.

The symbols of a text are its characters other than ASCII white space, for every text alike. Suffixes that
share their first characters form an interval of the suffix array; those intervals are found by the first
``min_chars`` characters (by hash, then compared), which leaves only suffixes that begin a long repeat, and
are deepened by prefix doubling until none is left. The spans of the intervals at the first depth unite to
the text's repeated part. The longest repeat is the greatest depth at which an interval still holds two
suffixes: it lies between the last two doublings, where two overlapping buckets tell it by bisection. No
depth is a limit, and memory grows with a batch's characters alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, free

#: Limits of the verdict and of the base rules.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20
#: A repeat counts from so many characters on; white space is no character here.
MIN_CHARS = 30
#: The share of the characters in repeats is the limit that Rae et al. (2021) set for repeated 5-grams.
MAX_COVERED = 0.15
MAX_LONGEST = 250

SYMBOLS = "#*$%&|<>"
BATCH = 2_400_000  # characters

COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "covered_fraction": "double", "longest_repeat": "long"}


#: A number that is odd and its inverse, modulo 2^64, for hashes of windows.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def recurring(symbols: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``width`` symbols begin that occur again in their document, ascending, and the class
    of equal ones that each is of. ``ends`` has the end of each symbol's document."""
    n = len(symbols)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.append(np.uint64(0), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), dtype=np.uint64))
    hashes = (sums[width:] - sums[:-width]) * _powers(INVERSE, n - width + 1)
    hashes = (hashes ^ (ends[: n - width + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    places = np.flatnonzero(np.arange(width, n + 1) <= ends[: n - width + 1])
    # Most windows occur once; only those that share a cell of a table with another are sorted.
    cells = (hashes[places] >> np.uint64(64 - 23)).astype(np.int64)
    places = places[np.bincount(cells, minlength=1 << 23)[cells] > 1]
    places = places[np.argsort(hashes[places], kind="stable")]
    while True:
        own = hashes[places]
        new = np.append(True, own[1:] != own[:-1])[: len(own)]
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
        places, group = places[many], group[many]
        if not len(places):
            return places, group
        first = places[np.append(True, group[1:] != group[:-1])][np.cumsum(np.append(True, group[1:] != group[:-1])) - 1]
        other = ends[first] != ends[places]
        for k in range(width):
            other |= symbols[first + k] != symbols[places + k]
        if not other.any():
            order = np.argsort(places, kind="stable")
            return places[order], group[order]
        hashes[places[other]] += np.uint64(0x9E3779B97F4A7C15)  # another text of the same hash: a class of its own
        places = places[np.argsort(hashes[places], kind="stable")]


def _class(places: np.ndarray, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The classes of the places ``at``, -1 for those that recur nowhere."""
    found = np.minimum(np.searchsorted(places, at), len(places) - 1)
    return np.where(places[found] == at, classes[found], -1)


def _paired(places: np.ndarray, classes: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places whose own class and ``second`` recur as a pair: the places, ascending, and the pairs' classes."""
    on = np.flatnonzero(second >= 0)
    pairs, inverse, counts = np.unique(classes[on] * np.int64(max(int(second.max(initial=0)), int(classes.max(initial=0))) + 1) + second[on], return_inverse=True, return_counts=True)
    many = counts[inverse] > 1
    return places[on][many], inverse[many].astype(np.int64)


def longest(places: np.ndarray, classes: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """For each of as many documents as ``docs`` (a document's number by place of a symbol) has: the length
    of its longest repeat, given where ``width`` symbols recur; 0 without any."""
    out = np.zeros(int(docs[-1]) + 1 if len(docs) else 0, np.int64)
    while len(places):
        deeper = _paired(places, classes, _class(places, classes, places + width))
        own = np.unique(docs[places])
        ended = np.setdiff1d(own, docs[deeper[0]])
        # These have a repeat of ``width`` and none of twice that: bisect, all at once.
        low, high = np.full(len(out), width), np.full(len(out), 2 * width)
        here = np.isin(docs[places], ended)
        p, c = places[here], classes[here]
        while len(p):
            middle = (low + high) // 2
            reach = middle[docs[p]] - width
            found = np.unique(docs[_paired(p, c, _class(p, c, p + reach))[0]])
            open_ = ended[high[ended] - low[ended] > 1]
            if not len(open_):
                break
            good = np.isin(open_, found)
            low[open_[good]], high[open_[~good]] = middle[open_[good]], middle[open_[~good]]
            still = np.isin(docs[p], ended[high[ended] - low[ended] > 1])
            if not still.all():
                p, c = p[still], c[still]
        out[ended] = low[ended]
        places, classes = deeper
        width *= 2
    return out


def _covered(n: int, places: np.ndarray, width: int) -> np.ndarray:
    """Running counts, from 0, of the symbols in the spans of ``width`` that begin at ``places``."""
    steps = np.bincount(places, minlength=n + 1) - np.bincount(places + width, minlength=n + 1)
    return np.append(0, np.cumsum(np.cumsum(steps)[:n] > 0))


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents' symbols: where each document ends, from 0 on, and the end of each symbol's."""
    borders = np.append(0, np.cumsum(counts))
    return borders, np.repeat(borders[1:], counts)


def _measure(texts: list[str], min_chars: int, max_covered: float, max_longest: int) -> dict[str, list]:
    split = [t.encode().split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64, int(n_words.sum()))
    borders, ends = _ends(n_words)
    windows = np.diff(_covered(len(ids), recurring(ids, ends, WINDOW)[0], WINDOW)[borders])
    del number, ids
    letters = [b"".join(s).decode() for s in split]
    del split
    n_chars = np.fromiter(map(len, letters), np.int64, len(letters))
    symbols = np.frombuffer("".join(letters).encode("utf-32-le"), "<u4")
    del letters
    borders, ends = _ends(n_chars)
    places, classes = recurring(symbols, ends, min_chars)
    part = np.diff(_covered(len(symbols), places, min_chars)[borders])
    docs = np.repeat(np.arange(len(texts)), n_chars)
    deepest = np.zeros(len(texts), np.int64)
    found = longest(places, classes, docs, min_chars)
    deepest[: len(found)] = found
    out: dict[str, list] = {k: [] for k in COLUMNS}
    for text, n, total, repeated, inside, most in zip(texts, n_words.tolist(), n_chars.tolist(), windows.tolist(), part.tolist(), deepest.tolist(), strict=True):
        share = inside / total if total else 0.0
        lines = [x for x in text.encode().split(b"\n") if x.strip()]
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
        row = (n, total, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, not failed and share <= max_covered and most <= max_longest, share, most)
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out


def quality(docs: DataFrame, min_chars: int = MIN_CHARS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``doc_id`` and the measures of each text, one row for each row of ``docs``, in its order.

    Words are runs of characters other than ASCII white space. ``kept`` is false if the base rules fail
    (fewer than 10 words, or over 20 % of the words lie in windows of 5 words that occur twice), if
    repeats of ``min_chars`` characters or more cover over ``max_covered`` of the characters in words, or
    if one repeat has more than ``max_longest`` of them. ``longest_repeat`` (in characters) is 0 if no
    repeat has ``min_chars``. Null and empty texts have no words and fail; a null doc_id stays null; repeated
    rows each give a row; other columns are ignored.
    """
    schema = "doc_id long, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items())

    def rows(columns: list[list]) -> dict:
        texts = [t or "" for t in columns[1]]
        out: dict[str, list] = {k: [] for k in COLUMNS}
        start = size = 0
        for i, text in enumerate([*texts, None]):
            size += len(text) if text is not None else 0
            if text is None or size >= BATCH:
                for k, v in _measure(texts[start : i + 1], min_chars, max_covered, max_longest).items():
                    out[k] += v
                start, size = i + 1, 0
        return {"doc_id": columns[0]} | out

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, rows)


def keep(docs: DataFrame, min_chars: int = MIN_CHARS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def verdict(texts: pd.Series) -> pd.Series:
        values, out, start, size = [t if isinstance(t, str) else "" for t in texts], [], 0, 0
        for i, t in enumerate(values):
            size += len(t)
            if size >= BATCH or i == len(values) - 1:
                out += _measure(values[start : i + 1], min_chars, max_covered, max_longest)["kept"]
                start, size = i + 1, 0
        return pd.Series(out, dtype=bool)

    (kept,) = free(docs, "_kept")
    marked = docs.withColumn(kept, F.pandas_udf(verdict, "boolean")(F.col("text").cast("string")))
    return marked.where(F.col(kept)).drop(kept)
