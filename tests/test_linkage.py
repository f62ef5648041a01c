"""Resolution of records that arrive in order against a plain fold."""

from __future__ import annotations

import random

import pytest

from brightloom.operators import linkage

SCHEMA = "ordinal long, d string, p string, t string"


def folded(rows):
    known, out = {}, {}
    for ordinal, *values in sorted(rows):
        keys = [f"{n}:{v}" for n, v in zip("dpt", values, strict=True) if v is not None]
        out[ordinal] = next((known[k] for k in keys if k in known), ordinal)
        known |= dict.fromkeys(keys, out[ordinal])
    return out


def resolved(spark, rows):
    got = linkage.resolve(spark.createDataFrame(rows, SCHEMA), ["d", "p", "t"], "ordinal", mode="ordered")
    return {r.ordinal: r.cluster for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_records(spark, seed):
    r = random.Random(seed)
    rows = [(i * 3 - 100, *[r.choice([None, *map(str, range(n))]) for n in (30, 12, 5)]) for i in range(300)]
    assert resolved(spark, rows) == folded(rows)


def test_a_late_key_takes_over(spark):
    """The third record is decided by d, so its p points to the first cluster from then on."""
    rows = [(1, "a", None, None), (2, None, "x", None), (3, "a", "x", None), (4, None, "x", None), (5, None, None, None)]
    assert resolved(spark, rows) == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5} == folded(rows)


def test_one_component_of_all_records(spark):
    """A key that half of all hold, and a chain in which each record's keys differ from its neighbour's."""
    chain = [(i, f"d{i // 2}" if i % 2 else f"d{i // 2}", f"p{(i + 1) // 2}", "hot" if i % 2 else None) for i in range(20_000)]
    assert resolved(spark, chain) == folded(chain)


def test_no_records(spark):
    assert linkage.resolve(spark.createDataFrame([], SCHEMA), ["d"], "ordinal", mode="ordered").collect() == []
