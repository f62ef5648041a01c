"""State machines with refused steps and single-use overrides against a plain fold."""

from __future__ import annotations

import random

import pytest

from brightloom.operators import states

MOVES = {"pre": ["intra", "closed"], "intra": ["icu"], "icu": ["ward"], "ward": ["closed", "icu"], "closed": []}
STEPS = "case_id string, n long, to string, override string"
OVERRIDES = "case_id string, override_id string, status string, signed_by string, justification string"


def folded(steps, overrides):
    good = {(c, i) for c, i, status, signed, why in overrides if status == "active" and signed and why}
    state, used, out = {}, set(), []
    for c, n, to, o in sorted(steps, key=lambda s: (s[0] or "", s[1], s[2] or "", s[3] or "")):
        before = after = state.get(c, "pre")
        if to in MOVES.get(before, ()):
            outcome, after = "moved", to
        elif to is None or o is None:
            outcome = "refused"
        elif (c, o) in good and (c, o) not in used:
            used.add((c, o))
            outcome, after = "overridden", to
        else:
            outcome = "invalid-override"
        state[c] = after
        out.append((c, n, to, o, before, outcome, after))
    return sorted(out, key=repr)


def made(seed, cases, steps):
    r = random.Random(seed)
    names = [*[f"o{i}" for i in range(6)], *[None] * 8]
    rows = [(r.choice(cases), n, r.choice([*MOVES, "nowhere", None]) if r.random() < 0.6 else r.choice(["intra", "icu", "ward"]), r.choice(names) if r.random() < 0.7 else f"once{n}") for n in range(steps)]
    given = [(c, o, r.choice(["active", "active", "consumed"]), r.choice(["lead", "lead", "", None]), r.choice(["why", "why", ""])) for c in cases if c for o in [*[f"o{i}" for i in range(6)], *[f"once{n}" for n in range(0, steps, 3)]]]
    return rows, given


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_equals_a_fold(spark, monkeypatch, bits):
    monkeypatch.setattr(states, "SEGMENT_BITS", bits)
    rows, given = made(bits, ["hot"] * 6 + ["a", "b", None], 300)
    out = states.replay(spark.createDataFrame(rows, STEPS), "case_id", ["n"], "to", "pre", MOVES, spark.createDataFrame(given, OVERRIDES), "override")
    assert sorted(map(tuple, out.collect()), key=repr) == folded(rows, given)


def test_a_refused_step_changes_nothing(spark):
    steps = spark.createDataFrame([("c", 1, "icu"), ("c", 2, "intra"), ("c", 3, "icu"), ("c", 4, "intra")], "case_id string, n long, to string")
    got = [(r.n, r.from_state, r.outcome, r.state_after) for r in states.replay(steps, "case_id", ["n"], "to", "pre", MOVES).orderBy("n").collect()]
    assert got == [(1, "pre", "refused", "pre"), (2, "pre", "moved", "intra"), (3, "intra", "moved", "icu"), (4, "icu", "refused", "icu")]


def test_an_override_is_not_used_by_an_allowed_step(spark):
    steps = spark.createDataFrame([("c", 1, "intra", "o"), ("c", 2, "closed", "o"), ("c", 3, "pre", "o"), ("d", 1, "icu", "o")], STEPS)
    given = spark.createDataFrame([("c", "o", "active", "lead", "why")], OVERRIDES)
    got = [r.outcome for r in states.replay(steps, "case_id", ["n"], "to", "pre", MOVES, given, "override").orderBy("case_id", "n").collect()]
    assert got == ["moved", "overridden", "invalid-override", "invalid-override"]


def test_no_steps_and_clashing_columns(spark):
    steps = spark.createDataFrame([("c", 1, "intra", "x", "y", 3)], "case_id string, n long, to string, from_state string, _case string, _at int")
    assert states.replay(steps.limit(0), "case_id", ["n"], "to", "pre", MOVES).collect() == []
    row = states.replay(steps, "case_id", ["n"], "to", "pre", MOVES).first().asDict()
    assert row == {"case_id": "c", "n": 1, "to": "intra", "_case": "y", "_at": 3, "from_state": "pre", "outcome": "moved", "state_after": "intra"}
