"""Scores, classes and gates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brightloom.functions import scoring as sc


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


BUNDLES = [
    ("benefit", "highest", "high", "recommend"), ("mixed", "moderate", "moderate", "defer_to_review"), ("benefit", "high", "moderate", "recommend"), ("mixed", "moderate", "low", "defer_to_review"),
    ("benefit", "high", "high", "recommend"), ("no-benefit", "high", "moderate", "avoid"), ("no-benefit", "high", "moderate", "avoid"),
]


@pytest.mark.parametrize(("direction", "strength", "certainty", "verb"), BUNDLES)
def test_decisions(value, direction, strength, certainty, verb):
    markers = sc.conflict_markers(F.lit(direction), F.lit(1.0), F.lit(0.0), F.lit(0.8), F.lit(certainty))
    got = value(sc.reviewed_decision(sc.decision(F.lit(direction), F.lit(strength)), markers, F.lit(True)))
    assert got.verb == verb
    assert got.review_state == ("needs-human-review" if verb == "defer_to_review" else "specialist-approved")


def test_confident_guideline(value):
    confidence = sc.evidence_confidence(F.lit("high"), F.lit("high"), F.lit(1.0), F.lit("guideline"), F.lit(0.0))
    assert value(confidence) == pytest.approx(0.91)
    uci = sc.residual_uncertainty(F.lit(0.91), F.array().cast("array<string>"))
    none = sc.conflict_markers(F.lit("benefit"), F.lit(1.0), F.lit(0.0), F.lit(0.91), F.lit("high"))
    klass = sc.applicability_class(F.lit(True), none, F.lit(1.0))
    assert value(klass) == "applicable"
    assert value(sc.uncertainty_level(F.lit(True), none, klass, F.lit(91.0), uci, F.lit(True))) == "I"
    assert value(sc.uncertainty_level(F.lit(True), none, klass, F.lit(91.0), uci, F.lit(False))) == "II"
    assert value(sc.uncertainty_level(F.lit(False), none, klass, F.lit(91.0), uci, F.lit(True))) == "IV"


def test_information_weight(value):
    null = F.lit(None).cast("string")
    s = value(sc.information_weight(F.lit("guideline"), F.lit("Cardiologia"), F.lit("ACC-AHA"), F.lit(True), F.lit("1"), F.lit("A")))
    assert s.score == 1.0 and s.reasons[0] == "guideline"
    low = value(sc.information_weight(F.lit("operative-note"), null, null, F.lit(False), null, null))
    assert low.score == pytest.approx(0.35)


def test_small_rules(value):
    assert value(sc.age_penalty(F.lit("2010-12-31").cast("date"), F.lit("2020-01-01").cast("date"))) == 0.25
    assert value(sc.dimension_mean(F.array().cast("array<int>"))) == 0.67
    assert value(sc.dimension_mean(F.array(F.lit(3), F.lit(0)))) == 0.5
    assert value(sc.stance(F.lit(0), F.lit(0))) == "mixed"
    assert value(sc.precedence(F.lit("guideline"), F.lit(0.5), F.lit(0.25))) == 4.75
    assert value(sc.missing(F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"))) == ["a", "b"]
    assert value(sc.valid_code(F.lit("snomed"), F.lit("12x"))) is False
    assert value(sc.audit_resolution(F.lit("approved"), F.lit("approved"))).final is True
    assert value(sc.audit_resolution(F.lit("approved"), F.lit(None).cast("string"))).review == "open"
    assert value(sc.translation_scores(F.lit(0), F.lit(0))).ecs == 91.0
    assert value(sc.reliability(F.lit("validated"), F.lit(1.0))) == pytest.approx(0.98)
    assert value(sc.gates({"a": F.lit(None).cast("boolean"), "b": F.lit(True)})).blocking == ["a"]
    c = value(sc.certification(F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(0.5), F.lit(0.9), F.lit(False)))
    assert c.blocking == [] and c.soft == ["low-parsing"]
    assert value(sc.certification_status(F.array().cast("array<string>"), F.array(F.lit("x")))) == "PARTIAL"
    assert value(sc.query_relevance(F.lit("Heart team"), F.array(F.lit("heart"), F.lit("lung")))) == 0.5
    assert value(sc.strength_label(F.lit("1"), F.lit("A"))) == "strong"
    assert value(sc.drift(F.lit(3.0), F.lit(1.0), F.lit(1.0))).breached is True
