"""Validators compiled from rules."""

from __future__ import annotations

import json

import pytest

from brightloom.functions import schemas as s

RULE = s.Record(
    {
        "id": s.Text(), "kind": s.Text(("a", "b"), what="kind"), "year": s.Number(1900, 2100, whole=True), "share": s.Number(0, optional=True), "live": s.Flag(optional=True),
        "when": s.Text(pattern=s.ISO_TIME, what="an ISO date-time", optional=True), "owner": s.Record({"name": s.Text()}, optional=True),
        "steps": s.Items(s.Record({"actor": s.Text(), "at": s.Text(pattern=s.ISO_DATE, what="an ISO date")}), least=1, what="step"), "tags": s.Items(s.Text(("x", "y"), what="tag"), optional=True),
    },
    when=[s.When("kind", ["b"], {"reason": s.Text()})],
)
GOOD = {"id": "1", "kind": "a", "year": 2000, "steps": [{"actor": "me", "at": "2020-01-01"}]}
CASES = [
    (GOOD, []),
    ({**GOOD, "kind": "b"}, [("o.reason", "must be a non-empty string")]),
    ({**GOOD, "kind": "b", "reason": "so"}, []),
    ({**GOOD, "id": "  ", "kind": "c"}, [("o.id", "must be a non-empty string"), ("o.kind", "must be a supported kind")]),
    ({**GOOD, "year": 1899}, [("o.year", "must be an integer 1900..2100")]),
    ({**GOOD, "year": 2000.5}, [("o.year", "must be an integer 1900..2100")]),
    ({**GOOD, "year": "2000"}, [("o.year", "must be an integer 1900..2100")]),
    ({**GOOD, "share": -1, "live": "no", "when": "yesterday"}, [("o.share", "must be a number 0.."), ("o.live", "must be true or false"), ("o.when", "must be an ISO date-time")]),
    ({**GOOD, "share": None, "live": True, "when": "2020-01-01T10:00:00Z", "owner": None}, []),
    ({**GOOD, "owner": {}}, [("o.owner.name", "must be a non-empty string")]),
    ({**GOOD, "owner": []}, [("o.owner", "must be an object")]),
    ({**GOOD, "steps": []}, [("o.steps", "must contain at least 1 step")]),
    ({**GOOD, "steps": {}}, [("o.steps", "must be an array")]),
    ({**GOOD, "steps": [{"actor": "me", "at": "2020-01-01"}, 3, {"actor": 1, "at": "x"}]}, [("o.steps[1]", "must be an object"), ("o.steps[2].actor", "must be a non-empty string"), ("o.steps[2].at", "must be an ISO date")]),
    ({**GOOD, "tags": ["x", "z", None]}, [("o.tags[1]", "must be a supported tag"), ("o.tags[2]", "must be a supported tag")]),
    ([1], [("o", "must be an object")]),
]


def test_cases(spark):
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(CASES)] + [(100, None), (101, "{no json"), (102, "null")]
    df = spark.createDataFrame(rows, "i int, j string")
    got = {r.i: [(x.path, x.message) for x in r.issues] for r in df.select("i", s.issues_of_json(RULE, "j", "o").alias("issues")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, CASES[i]
    assert got[100] == got[101] == got[102] == [("o", "must be an object")]


def test_no_python_and_no_growth_with_data(spark):
    df = spark.createDataFrame([("{}",)], "j string").select(s.issues_of_json(RULE, "j", "o").alias("issues"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_unknown_rules_raise(spark):
    with pytest.raises(TypeError):
        s.issues_of(s.Record({"x": "text"}), None, "o")
