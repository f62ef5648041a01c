"""Weighted rules as single column expressions: scores with their reasons, classes, gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import col

Rule = tuple[Column, float, str]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def additive(base: float, rules: Sequence[Rule], digits: int, low: float, high: float) -> Column:
    """A struct of ``score`` (base plus the weights of the rules that hold, rounded, then clamped) and
    ``reasons`` (their names, in order). A rule that is null doesn't hold."""
    weights = [F.when(test, F.lit(float(w))).otherwise(F.lit(0.0)) for test, w, _ in rules]
    total = reduce(lambda a, b: a + b, weights, F.lit(float(base)))
    return F.struct(clamp(F.round(total, digits), low, high).alias("score"), F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in rules])).alias("reasons"))


def tier(value: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first step that the value reaches; steps from the highest down."""
    return F.coalesce(*[F.when(value >= limit, F.lit(name)) for limit, name in steps], F.lit(below))


def lookup(c: Column | str, table: dict[str, float], default: float) -> Column:
    value = col(c)
    return F.coalesce(*[F.when(value == k, F.lit(float(v))) for k, v in table.items()], F.lit(float(default)))


# Fixed values of the rule tables below.
WEIGHT_TIERS = [(0.85, "critical"), (0.70, "high"), (0.50, "moderate")]
SPECIALTIES = ["cirugia cardiovascular", "cardiologia", "cardiologia intervencionista"]
SOCIETIES = "acc|aha|scai|esc|sts"
CERTAINTY = {"very-high": 1.0, "high": 0.85, "moderate": 0.65, "low": 0.45, "very-low": 0.25}
STRENGTH = {"highest": 1.0, "high": 0.85, "moderate": 0.65, "low": 0.45, "very-low": 0.25}
TYPE_BONUS = {"guideline": 0.12, "consensus": 0.12, "pathway": 0.08, "protocol": 0.08, "order-set": 0.08, "rct": 0.04, "pragmatic-trial": 0.04}
POSITIVE = ["should be performed", "is recommended", "is indicated", "should be considered", "is reasonable", "may be considered"]
NEGATIVE = ["should not be performed", "is not recommended", "harm"]
UNCERTAINTY_LIMITS = {"I": 0.25, "II": 0.4, "III": 0.6, "IV": 0.0}
SEVERITY = {"mild": 0.1, "moderate": 0.3, "severe": 0.6, "life_threatening": 1.0}
RELIABILITY = {"low": 0.58, "moderate": 0.74, "high": 0.88, "validated": 0.97}


def information_weight(kind: Column, specialty: Column, group: Column, recommends: Column, cor: Column, loe: Column) -> Column:
    """Score, reasons; the label comes from ``tier(score, WEIGHT_TIERS, "emerging")``."""
    kind = F.lower(kind)
    guideline = F.contains(kind, F.lit("guideline"))
    synthesis = ~guideline & kind.rlike("meta-analysis|systematic-review")
    trial = ~guideline & ~synthesis & kind.rlike("trial|registry")
    report = ~guideline & ~synthesis & ~trial & kind.rlike("operative-note|surgical-report")
    return additive(0.45, [
        (guideline, 0.35, "guideline"), (synthesis, 0.30, "synthesis"), (trial, 0.20, "trial"), (report, -0.10, "operative"),
        (F.lower(specialty).isin(SPECIALTIES), 0.10, "specialty"), (F.lower(group).rlike(SOCIETIES), 0.08, "society"), (recommends, 0.07, "recommendation"),
        (cor == "1", 0.12, "cor-1"), (cor == "2A", 0.08, "cor-2a"), (cor == "2B", 0.04, "cor-2b"), (F.startswith(cor, F.lit("3")), 0.02, "cor-3"),
        (loe == "A", 0.10, "loe-a"), (F.startswith(loe, F.lit("B")), 0.06, "loe-b"), (F.startswith(loe, F.lit("C")), 0.02, "loe-c"),
    ], 2, 0.05, 1.0)


def extraction_confidence(recommends: Column, cor: Column, loe: Column, population: Column, intervention: Column, locator: Column, times: Column, entities: Column) -> Column:
    """M02."""
    return additive(0.35, [
        (recommends, 0.15, "recommendation-language"), (cor.isNotNull(), 0.12, "cor"), (loe.isNotNull(), 0.08, "loe"), (population.isNotNull(), 0.08, "population-extracted"),
        (intervention.isNotNull(), 0.08, "intervention-extracted"), (locator.isNotNull(), 0.04, "locator"), (F.size(times) > 0, 0.04, "temporal"), (F.size(entities) >= 3, 0.04, "entities"),
    ], 3, 0.0, 0.99)


def strength_label(cor: Column, loe: Column) -> Column:
    """M03."""
    return F.when((cor == "1") & (loe == "A"), "strong").when(cor.isin("1", "2A"), "moderate").when(cor.isNotNull(), "conditional").otherwise("unspecified")


def like_any(c: Column, words: Sequence[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def stance(positive: Column, negative: Column) -> Column:
    """Of counts of positive and negative wordings; none or both is mixed."""
    return F.when((positive > 0) & (negative == 0), "supportive").when((negative > 0) & (positive == 0), "restrictive").otherwise("mixed")


def precedence(kind: Column, weight: Column, confidence: Column) -> Column:
    """Type score plus mean weight and confidence, to 3 places."""
    kind = F.lower(kind)
    base = F.when(F.contains(kind, F.lit("guideline")), 4.0).when(F.contains(kind, F.lit("meta")), 3.0).when(kind.rlike("trial|rct"), 2.5).when(F.contains(kind, F.lit("consensus")), 2.2).otherwise(1.0)
    return F.round(base + weight + confidence, 3)


def age_penalty(published: Column, now: Column) -> Column:
    """By the difference of calendar years."""
    years = F.year(now) - F.year(published)
    return F.when(years >= 10, 0.25).when(years >= 6, 0.12).otherwise(0.0)


def evidence_confidence(certainty: Column, strength: Column, applicability: Column, kind: Column, penalty: Column) -> Column:
    """From 0 to 1, to 2 places; 100 times that is the ecs."""
    raw = 0.40 * lookup(certainty, CERTAINTY, 0.15) + 0.35 * lookup(strength, STRENGTH, 0.15) + 0.15 * applicability + lookup(kind, TYPE_BONUS, 0.0) - penalty
    return F.round(clamp(raw, 0.0, 1.0), 2)


def residual_uncertainty(confidence: Column, uncertainties: Column) -> Column:
    """What is left of confidence, and 0.05 for each distinct uncertainty, 0.35 at most."""
    return F.round(clamp(1 - confidence + F.least(F.lit(0.35), 0.05 * F.size(F.array_distinct(uncertainties))), 0.0, 1.0), 2)


def dimension_mean(scores: Column, most: int = 3, default: float = 0.67) -> Column:
    """Mean of dimension scores over their maximum, a default without any."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / (most * F.size(scores))).otherwise(F.lit(default))


def conflict_markers(direction: Column, applicability: Column, penalty: Column, confidence: Column, certainty: Column) -> Column:
    """Structs of code and severity, for the rules that hold."""
    def mark(code: str, severity: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), severity.alias("severity"))

    return F.array_compact(F.array(
        F.when(direction.isin("mixed", "inconclusive"), mark("direction", F.lit("critical"))),
        F.when(applicability < 0.45, mark("applicability", F.lit("warning"))),
        F.when(penalty >= 0.12, mark("age", F.when(penalty >= 0.25, "critical").otherwise("warning"))),
        F.when((confidence < 0.5) | certainty.isin("insufficient", "unknown"), mark("confidence", F.lit("critical"))),
    ))


def has_severity(markers: Column, severity: str) -> Column:
    """A21."""
    return F.exists(markers, lambda m: m["severity"] == severity)


def missing(required: Column, present: Column) -> Column:
    """Required names that aren't present; a gate is open if there are none."""
    return F.array_except(required, F.coalesce(present, F.array().cast("array<string>")))


def applicability_class(gate_open: Column, markers: Column, applicability: Column) -> Column:
    """M11."""
    return (F.when(~gate_open | has_severity(markers, "critical"), "indeterminate").when(applicability < 0.45, "not-applicable")
            .when((F.size(markers) == 0) & (applicability >= 0.75), "applicable").otherwise("conditional"))


def uncertainty_level(gate_open: Column, markers: Column, klass: Column, ecs: Column, uci: Column, approved: Column) -> Column:
    """I to IV; a level I without a specialist's approval is II."""
    level = (F.when(~gate_open | has_severity(markers, "critical") | (klass == "indeterminate") | (ecs < 50) | (uci > 0.6), "IV")
             .when(has_severity(markers, "warning") | (klass == "conditional") | (ecs < 65) | (uci > 0.4), "III")
             .when((klass == "applicable") & (ecs >= 80) & (uci <= 0.25), "I").otherwise("II"))
    return F.when((level == "I") & ~approved, "II").otherwise(level)


def decision(direction: Column, strength: Column) -> Column:
    """The verb before review."""
    return F.when((direction == "benefit") & strength.isin("highest", "high"), "recommend").when(direction == "benefit", "consider").when(direction.isin("harm", "no-benefit"), "avoid").otherwise("defer_to_review")


def reviewed_decision(verb: Column, markers: Column, approved: Column) -> Column:
    """Verb, readiness and review state after review."""
    needs = has_severity(markers, "critical") | ~approved
    return F.struct(F.when(needs, "defer_to_review").otherwise(verb).alias("verb"), F.when(needs, "not-ready").otherwise("ready").alias("readiness"), F.when(needs, "needs-human-review").otherwise("specialist-approved").alias("review_state"))


def query_relevance(text: Column, query: Column) -> Column:
    """Query words in the text, as a share of them, from 0.35 to 1."""
    hits = F.size(F.filter(query, lambda t: F.contains(F.lower(text), t)))
    return F.when(F.size(query) > 0, clamp(hits / F.size(query), 0.35, 1.0)).otherwise(F.lit(0.35))


def index_score(label: Column, haystack: Column, words: Column, query: Column, ready: Column, candidate: Column) -> Column:
    """For each query word 12 if the label begins with it, 4 if the text has it, 6 if it is a
    word; 0 if nothing matches; then bonuses, at least 1."""
    low = F.lower(label)
    one = lambda t: F.when(F.startswith(low, t), 12).otherwise(0) + F.when(F.contains(haystack, t), 4).otherwise(0) + F.when(F.array_contains(words, t), 6).otherwise(0)
    base = F.aggregate(F.transform(query, one), F.lit(0), lambda a, x: a + x)
    extra = F.when(ready, 6).otherwise(0) - F.when(candidate, 8).otherwise(0) - F.when(F.length(label) > 180, 4).otherwise(0)
    return F.when(base == 0, 0).otherwise(F.greatest(F.lit(1), base + extra))


def browser_score(label: Column, haystack: Column, query: Column, phrase: Column, candidate: Column, priority: Column) -> Column:
    """Every word must occur, else null; prefixes count 55, words of the label 34, others 16; an
    equal label 180, a prefix phrase 30; long labels lose."""
    low = F.lower(label)
    one = lambda t: F.when(F.startswith(low, t), 55).when(F.contains(low, t), 34).otherwise(16)
    base = F.aggregate(F.transform(query, one), F.lit(0), lambda a, x: a + x)
    more = F.when(low == phrase, 180).when(F.startswith(low, phrase), 30).otherwise(0) - F.when(candidate, 52).otherwise(0) - F.when(F.length(label) > 180, 28).when(F.length(label) > 110, 22).otherwise(0)
    return F.when(F.forall(query, lambda t: F.contains(haystack, t)) & (F.size(query) > 0), base + more + F.least(priority, F.lit(200)) / 20)


def certification(mandatory_missing: Column, semantic_ok: Column, unit_ok: Column, term_ok: Column, parsing: Column, reliability: Column, stale: Column) -> Column:
    """M20, for one variable: what blocks, what is soft."""
    return F.struct(
        F.array_compact(F.array(F.when(mandatory_missing, "mandatory-missing"), F.when(~semantic_ok, "semantic-invalid"), F.when(~unit_ok, "unit-invalid"), F.when(~term_ok, "terminology-invalid"))).alias("blocking"),
        F.array_compact(F.array(F.when(parsing < 0.75, "low-parsing"), F.when(reliability < 0.70, "low-reliability"), F.when(stale, "stale"))).alias("soft"))


def certification_status(blocking: Column, soft: Column) -> Column:
    """FAIL if anything blocks, PARTIAL if anything is soft."""
    return F.when(F.size(blocking) > 0, "FAIL").when(F.size(soft) > 0, "PARTIAL").otherwise("PASS")


def stale(observed: Column, evaluated: Column, hours: int = 720) -> Column:
    """Observed more than ``hours`` before."""
    return F.timestamp_diff("HOUR", observed, evaluated) > hours


def reliability(source: Column, confidence: Column) -> Column:
    """M21."""
    return F.round(clamp(0.6 * lookup(source, RELIABILITY, 0.58) + 0.4 * confidence, 0.5, 0.99), 2)


def translation_scores(conflicts: Column, aged: Column) -> Column:
    """M23."""
    return F.struct(clamp(91 - 4.0 * conflicts - 1.5 * aged, 60.0, 95.0).alias("ecs"), F.least(F.lit(0.95), 0.12 + 0.12 * conflicts + 0.03 * aged).alias("uci"))


def gates(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold (null doesn't), and the verdict."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return F.struct(failed.alias("blocking"), F.when(F.size(failed) == 0, "PASS").otherwise("FAIL").alias("verdict"))


def issues(checks: dict[str, tuple[Column, str]]) -> Column:
    """Structs of path and message, for the checks that don't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(said).alias("message"))) for path, (ok, said) in checks.items()]))


def audit_resolution(first: Column, second: Column) -> Column:
    """Two reviewers' verdicts (approved, rejected or null) to level, review and finality."""
    both = (first == "approved") & (second == "approved")
    none = (first == "rejected") | (second == "rejected")
    return F.struct(F.when(both, "validated").when(none, "rejected").otherwise("pending").alias("level"), F.when(both | none, "closed").otherwise("open").alias("review"), both.eqNullSafe(True).alias("final"))


def drift(observed: Column, baseline: Column, limit: Column) -> Column:
    """M31."""
    return F.struct((observed - baseline).alias("delta"), (F.abs(observed - baseline) > limit).alias("breached"))


def valid_code(system: Column, code: Column) -> Column:
    """Not empty; numeric for SNOMED."""
    return (F.trim(code) != "") & ((F.upper(system) != "SNOMED") | code.rlike("^[0-9]+$"))
