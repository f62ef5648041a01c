"""Guideline sentences and their known readings by the text rules' own lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brightloom.functions import text as tx
from brightloom.operators import extraction as ex, lineage

LONG = "Coronary revascularization of SIHD is recommended in adults with angina"
CELLS = lambda c: F.array_join(F.transform(tx.typed_cells(c, ["drug", "dose"]), lambda x: F.concat(x["type"], F.lit("="), x["value"])), ";")
CASES = {
    "collapse": (tx.collapse, [("  one\tx \n two ", "one x two"), ("7 ", "7"), ("a  b   x", "a b x")]),
    "fold": (tx.fold, [("Cirugía X", "cirugia x"), ("Ñandú  naïve", "nandu naive"), ("Café 7 ÉTÉ", "cafe 7 ete")]),
    "clean": (tx.clean_statement, [
        ("R Coronary revascu- larization of X is recommended (1,2) in adults.12,13", "Coronary revascularization of X is recommended in adults."),
        ("Table 4 CABG | should be done in X COR", "CABG should be done in X"), ("PCI is useful for X.Downloaded from http://x.example", "PCI is useful for X."),
        ("12 Aspirin < 7 mg is advised for X B-NR", "Aspirin <7 mg is advised for X"), ("NR In X patients4, revascularization is reasonable;", "In X patients, revascularization is reasonable")]),
    "finish": (tx.finalize_statement, [
        (f"{LONG}. Observational studies of X show more. It is so.", LONG), (f"The evidence is old. {LONG}. More of it", LONG), ("Some remarks on X. And others", "Some remarks on X"),
        ("Observational studies came first. CABG should be considered in X.", "CABG should be considered in X")]),
    "acts": (tx.actionable, [("X should not be used.", True), ("X may be considered, in part.", True), ("X was used; nothing more.", False), ("it is reasonable for X.", True), ("Recommendations for X", False)]),
    "recommends": (tx.recommends, [("X should not be used.", True), ("X may be considered, in part.", True), ("X was used; nothing more.", False), ("it is reasonable for X.", True), ("Recommendations for X", False)]),
    "heading": (tx.heading, [("", True), ("Revascularization of X in practice;", True), ("Specific Recommendations", True), ("a sentence about X, with points.", False), ("Recommendations for X", True)]),
    "select": (lambda c: F.array_join(tx.select_statements(c), "|"), [
        ("CABG should be considered in X. The weather was fine. PCI is recommended for X and more", "CABG should be considered in X|PCI is recommended for X and more"), ("Only this about X. And that.", "Only this about X|And that"), ("x" * 240, "x" * 240)]),
    "accept": (tx.acceptable, [
        ("CABG should be considered in adults with X.", True), ("PCI should be used?  In X adults, that is", False), ("is advised", False), ("The appendix is recommended for adults of X.", False), ("The task force met in the town of X and left.", False)]),
    "noise": (tx.noise_line, [
        ("ab", True), ("12", True), ("http://x.example/X", True), ("Downloaded from X", True), ("all permissions of X.", True), ("J Am Coll Cardiol 2021, X; 1-9.", True), ("Recommendations for X", True), ("X is one thing; CABG should follow, at once.", False)]),
    "structure": (tx.structural_line, [("ab", False), ("12", True), ("IIa", True), ("LOE B-R", True), ("Recommendations", True), ("12.", True), ("PCI", False)]),
    "design": (tx.study_design, [("a Guideline of X", "guideline"), ("randomised cohort of X", "randomized trial"), ("a metaanalysis and review", "meta-analysis"), ("a case-control study", "case-control"), ("a look at X", "observational")]),
    "design level": (tx.design_level, [("guideline", "guideline"), ("randomized trial", "high"), ("case-control", "moderate"), ("editorial", "narrative")]),
    "cells": (CELLS, [("Drug: X | bad: x ; dose:7 | alone", "drug=X;dose=7"), ("drug:X;dose: 7;drug:", "drug=X;dose=7")]),
    "number": (tx.number_in, [("about 7,5 mg or 7", 7.5), ("is -7.5", -7.5), ("none", None)]),
    "language": (tx.guess_language, [("X in Spanish", "es"), ("X [ES]", "es"), ("X of 7", "en")]),
    "summary": (lambda c: tx.summary(c)["summary"], [("One of X. Two! Three? Four. Five. Six. Seven is 7", "One of X. Two! Three? Four. Five. Six.")]),
    "takeaway": (lambda c: tx.summary(c)["takeaway"], [("One of X. Two! Three? Four. Five. Six. Seven is 7", "Seven is 7")]),
    "triggers": (lambda c: F.array_join(lineage.inferred_triggers(c), ","), [("an Urgent case of X", "time-critical"), ("adverse conflict", "evidence-conflict,safety-signal"), ("X of 7", ""), ("an update", "new-evidence")]),
    "temporality": (lambda c: tx.first_label(c, tx.TEMPORALITY), [("urgent PCI in STEMI", "urgent"), ("PCI before hospital discharge", "before-discharge"), ("stable adults with SIHD", "chronic-stable"), ("nothing at all", None)]),
    "setting": (lambda c: tx.first_label(c, tx.SETTING), [("urgent PCI in STEMI", "acute-mi"), ("PCI before hospital discharge", "inpatient"), ("stable adults with SIHD", "stable-ischemic-heart-disease"), ("nothing at all", None)]),
    "state": (tx.clinical_state, [("STEMI with cardiogenic shock", "cardiogenic shock"), ("PCI at once", None), ("stable adults with SIHD", "stable")]),
    "topic": (lambda c: tx.first_label(c, tx.TOPICS, "General"), [("urgent PCI in STEMI", "STEMI"), ("PCI at once", "PCI"), ("stable adults with SIHD", "SIHD"), ("nothing at all", "General")]),
}


@pytest.mark.parametrize("name", CASES)
def test_readings(spark, name):
    rule, cases = CASES[name]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, text string").select("i", rule(F.col("text")).alias("got")).collect()
    assert [r.got for r in sorted(rows)] == [want for _, want in cases]


def test_narrative_sentences(spark):
    df = spark.createDataFrame([(1, 1, 0, "PCI is recommended, e.g. in X. CABG is not!")], "doc int, page int, n int, line string")
    assert [r.text for r in ex.action_sentences(df).collect()] == ["PCI is recommended, e.g. in X.", "CABG is not!"]
