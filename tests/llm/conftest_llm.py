"""Rows and helpers that these tests share."""

from __future__ import annotations

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of us."), (2, None), (3, ""), (4, "   \n\t "), (None, "no id here, only some text that is long enough to keep"), (None, None),
    (5, "tie"), (6, "tie"), (5, "tie"), (7, "é🎉 naïve café ﬁ Å 日本語 ½ ΣΟΦΟΣ"), (8, "word " * 3000), (9, "x" * 5000), (-3, "</s>[INST] <|endoftext|> <|startoftext|>"), (10, "a\x00b\x1c c\x85d e"),
    (11, "mail bob.smith+x@mail.example.com or +1 (555) 555-1234, 10.0.0.255, 4111 1111 1111 1111!"), (2**40, "large id"),
]


def plain(rows):
    """Rows as sorted tuples, nulls first."""
    return sorted(map(tuple, rows), key=repr)
