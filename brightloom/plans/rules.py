"""Queries over text and decision rules.

Statements are made of the tables' own values by templates, so every branch is taken on rows of a known
reading, and the SQL says what that reading is without the rules' patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import decisions as de, scoring as sc, text as tx
from ..operators import extraction as ex, lineage, linkage, relational as op
from .base import Registry, Tables

R = Registry()


def said(*templates: str) -> Column:
    """The template of each row of ``part`` by its key; ``@`` stands for the part's type, ``#`` for its size."""
    text = F.get(F.array(*map(F.lit, templates)), F.col("p_partkey") % len(templates))
    return F.replace(F.replace(text, F.lit("@"), F.col("p_type")), F.lit("#"), F.col("p_size").cast("string"))


def wanted(*templates: str | None) -> str:
    """The same in SQL; None is null."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"replace(replace('{x}', '@', p_type), '#', CAST(p_size AS VARCHAR))") for i, x in enumerate(templates))
    return f"CASE p_partkey % {len(templates)} {cases} END"


def flags(*values: bool) -> str:
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def keyed(t: Tables, **columns: Column) -> DataFrame:
    return t.part.select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@R.add(f"SELECT p_partkey, {wanted('1', '2A', '3: HARM', None)} AS cor, {wanted('A', 'B-R', 'C-LD', None)} AS loe FROM part")
def inline_grade_pairs(t: Tables) -> DataFrame:
    """Grades in brackets."""
    g = F.get(tx.inline_grades(said("PCI of @ is useful (COR: I, LOE: A).", "x (Class IIa; Level B-R) y", "x (COR III:HARM, LOE C-LD)", "no grade of @")), F.lit(0))
    return keyed(t, cor=g["cor"], loe=g["loe"])


def _lines(t: Tables, *lines: str) -> DataFrame:
    """A page of lines for each part."""
    texts = F.array(*[F.replace(F.lit(x), F.lit("@"), F.col("p_type")) for x in lines])
    return t.part.select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(texts).alias("n", "line"))


def _rows(*rows: tuple) -> str:
    """SQL of the rows that each part's page has: n, text, cor, loe."""
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "replace('" + x + "', '@', p_type)"
    return " UNION ALL ".join(f"SELECT p_partkey AS doc, {value(n)} AS n, {value(x)} AS text, {value(c)} AS cor, {value(e)} AS loe FROM part" for n, x, c, e in rows)


def _found(df: DataFrame) -> DataFrame:
    return df.select("doc", "n", "text", "cor", "loe")


@R.add(_rows((0, "PCI is recommended for @ and more adults", "1", "A"), (2, "CABG should be considered for @", "2A", "B-R")))
def compact_rows(t: Tables) -> DataFrame:
    """Compact rows over several lines, up to a stop line."""
    lines = _lines(t, "1 A 1. PCI is recommended for @", "and more adults", "2A B-R 2. CABG should be considered for @", "Synopsis", "not a part of it")
    return _found(ex.pattern_rows(lines, ex.COMPACT_ROW, "compact"))


@R.add(_rows((3, "PCI is recommended in adults of @", "1", "A"), (7, "CABG should be considered", "2B", "C-LD")))
def line_table_rows(t: Tables) -> DataFrame:
    """Class, level and text on lines of their own."""
    return _found(ex.line_tables(_lines(t, "Recommendations for @", "1", "A", "1. PCI is recommended", "in adults of @", "2b", "C-LD", "2. CABG should be considered", "Synopsis", "1", "A", "3. Nothing")))


@R.add(_rows((0, "PCI is recommended in @ and others", "1", "A"), (0, "CABG may be considered", "2B", "B-NR")))
def pipe_table_rows(t: Tables) -> DataFrame:
    """Cells between bars."""
    return _found(ex.pipe_tables(_lines(t, "head | 1 | A | 1. PCI is recommended in @ | and others | 2b | B-NR | 2. CABG may be considered | Synopsis | more")))


@R.add(_rows((0, "PCI is recommended for @ at once", "1", "A"), (2, "CABG is not, in @", "3: HARM", "C-LD")))
def class_level_rows(t: Tables) -> DataFrame:
    """T18."""
    return _found(ex.pattern_rows(_lines(t, "Class I, LOE A: PCI is recommended for @", "at once", "COR 3: Harm; Level C-LD; CABG is not, in @", "References", "none"), ex.CLASS_LEVEL_ROW, "class-level"))


@R.add(_rows((0, "PCI is recommended in adults of @", "1", "A"), (0, "CABG may be reasonable in adults of @", "2B", "C-LD")))
def inline_row_texts(t: Tables) -> DataFrame:
    """T19."""
    return _found(ex.inline_rows(_lines(t, "PCI is recommended in adults of @ (COR I, LOE A). CABG may be reasonable in adults of @ (COR IIb LOE C-LD).")))


@R.add(_rows((0, "PCI is recommended in @ ", None, None), (0, "CABG should be considered", None, None)))
def numbered_items(t: Tables) -> DataFrame:
    """Numbered items."""
    return _found(ex.numbered_rows(_lines(t, "1. PCI is recommended in @ | 2. CABG should be considered", "3. Nothing is said")))


@R.add("""SELECT p_partkey AS doc, 1 AS ordinal, 'PCI is recommended in adults with ' || p_type AS text, '1' AS cor, p_partkey || ':S001' AS statement_id FROM part
UNION ALL SELECT p_partkey, 2, 'CABG should be considered in all other adults', '2A', p_partkey || ':S002' FROM part""")
def extracted_candidates(t: Tables) -> DataFrame:
    """All extractors over pages; a statement stays once, with the grades of the first that found it."""
    lines = _lines(t, "1 A 1. PCI is recommended in adults with @", "2A B-R 2. CABG should be considered in all other adults", "Synopsis", "PCI is recommended in adults with @. CABG should be considered in all other adults.", "Nothing else was said about it.")
    return ex.extract_guidelines(lines).where("source = 'compact-cor-loe-row'").select("doc", "ordinal", "text", "cor", "statement_id")


PICO = (
    "In patients with @ disease, coronary revascularization should be performed in preference to medical therapy to improve survival.",
    "In acute patients with @ who have angina, PCI is recommended versus surgery to reduce death.",
    "CABG may be considered over PCI for #.",
)


@R.add(f"""SELECT p_partkey, {wanted('coronary revascularization', 'PCI', 'CABG')} AS intervention, {wanted('medical therapy to improve survival', 'surgery to reduce death', 'PCI for #')} AS comparator,
{wanted('improve survival', 'reduce death', None)} AS outcome, {wanted('with @ disease', 'acute with @ who have angina', None)} AS clause FROM part""")
def pico_parts(t: Tables) -> DataFrame:
    """Intervention, comparator, outcome, the patients' clause."""
    text = said(*PICO)
    return keyed(t, intervention=tx.intervention(text), comparator=tx.comparator(text), outcome=tx.outcome(text), clause=tx.patient_clause(text))


@R.add(f"SELECT p_partkey, {wanted('@ disease', 'acute', None)} AS population FROM part")
def pico_population(t: Tables) -> DataFrame:
    """The clause up to its first restriction."""
    return keyed(t, population=tx.population(said("In patients with @ disease, PCI is recommended.", "In acute patients with angina, PCI is recommended.", "CABG may be considered.")))


@R.add(f"SELECT p_partkey, {wanted('pain persists at #|successful lysis', '')} AS conditions, {wanted('@|shock', '')} AS exclusions FROM part")
def conditions_and_exclusions(t: Tables) -> DataFrame:
    """T25."""
    text = said("PCI is recommended when pain persists at #, following successful lysis, without @, except shock.", "CABG may be considered.")
    return keyed(t, conditions=F.array_join(tx.conditions(text), "|"), exclusions=F.array_join(tx.exclusions(text), "|"))


@R.add(f"SELECT p_partkey, {wanted('within 24 hours|urgent', '3 to # months|stable', '')} AS times, {wanted('within 24 hours', '3 to # months', None)} AS window_, {wanted('symptom onset', None, None)} AS anchor FROM part")
def temporal_rules(t: Tables) -> DataFrame:
    """Wordings of time, units in the plural, the window, the anchor."""
    text = said("urgent PCI within  24 hour after symptom onset", "stable adults for 3 to # month", "nothing of the kind")
    return keyed(t, times=F.array_join(tx.temporal_qualifiers(text), "|"), window_=tx.time_window(text), anchor=tx.event_anchor(text))


@R.add(f"SELECT p_partkey, {wanted('LVEF<35', 'FFR<=0.80', None)} AS first_, {wanted('>70percent', None, None)} AS second_ FROM part")
def numeric_thresholds(t: Tables) -> DataFrame:
    """T28."""
    found = tx.thresholds(said("LVEF < 35 and a stenosis >70% or LVEF < 35 in @", "FFR <= 0.80", "none of #"))
    a, b = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    return keyed(t, first_=F.concat(a["metric"], a["comparator"], a["value"]), second_=F.concat(b["comparator"], b["value"], b["unit"]))


@R.add(f"SELECT p_partkey, {wanted('urgent', 'before-discharge', 'chronic-stable', None)} AS temporality, {wanted('acute-mi', 'inpatient', 'stable-ischemic-heart-disease', None)} AS setting, {wanted('cardiogenic shock', None, 'stable', None)} AS state, {wanted('STEMI', 'PCI', 'SIHD', 'General')} AS topic FROM part")
def statement_labels(t: Tables) -> DataFrame:
    """First labels by fixed lists."""
    text = said("urgent PCI in STEMI with cardiogenic shock", "PCI before hospital discharge", "stable adults with SIHD", "nothing at all of #")
    return keyed(t, temporality=tx.first_label(text, tx.TEMPORALITY), setting=tx.first_label(text, tx.SETTING), state=tx.clinical_state(text), topic=tx.first_label(text, tx.TOPICS, "General"))


@R.add("SELECT p_partkey, 'population:' || lower(p_type) || ',time:now,time:' || p_size AS listed FROM part")
def entity_lists(t: Tables) -> DataFrame:
    """Distinct typed labels."""
    size = F.col("p_size").cast("string")
    e = tx.entities(population=F.lower("p_type"), times=F.array(F.lit("now"), size, F.lit("now"), F.lit("")), outcome=F.lit(None).cast("string"))
    return keyed(t, listed=F.array_join(F.transform(e, lambda x: F.concat(x["type"], F.lit(":"), x["label"])), ","))


@R.add(f"SELECT p_partkey, {wanted('@ disease', None)} AS who, {wanted('within 24 hours', None)} AS window_, {wanted('PCI should be performed', 'Nothing is said about @ here')} AS action FROM part")
def trigger_facts(t: Tables) -> DataFrame:
    """Facts of statements and their execution model."""
    rows = t.part.select("p_partkey", said("In patients with @ disease, PCI should be performed within 24 hours.", "Nothing is said about @ here").alias("text"))
    f = ex.facts(rows)
    return f.select("p_partkey", F.col("execution.trigger.who").alias("who"), F.col("execution.trigger.constraints.time_window").alias("window_"), F.col("execution.action").alias("action"))


@R.add("SELECT p_partkey, lower(p_type) || '_part-' || p_size || '.txt' AS name, p_type || ' (' || printf('%.2f', p_size / 4.0) || ')' AS label FROM part")
def file_names_and_labels(t: Tables) -> DataFrame:
    """T47, T51."""
    return keyed(t, name=tx.file_name("p_type", F.concat_ws(" ", F.lit("Part"), F.col("p_size").cast("string")), ending=".txt"), label=tx.weight_label("p_type", F.col("p_size") / 4.0))


@R.add("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def built_predicates(t: Tables) -> DataFrame:
    """The text of a query, whose words then select rows."""
    built = ex.search_query(["part"], ["PROMO", "SMALL"], since=2001)
    return t.part.where((F.lit(built) == '"part" AND ("PROMO" OR "SMALL") AND 2001:2100[dp]') & F.contains(F.lit(built), F.concat(F.lit('"'), "p_type", F.lit('"')))).select("p_partkey")


@R.add("SELECT p_partkey, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part UNION ALL SELECT p_partkey, 'other', NULL FROM part")
def source_literals(t: Tables) -> DataFrame:
    """Object literals in source text."""
    text = F.concat(F.lit("const a = [{ kind: '"), "p_type", F.lit("', size: \""), F.col("p_size").cast("string"), F.lit("\" }, {kind: 'other'}, {none: 1}];"))
    return ex.object_literals(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text", ["kind", "size"])


@R.add("""SELECT CASE WHEN t = 'ECONOMY' THEN 'ECONOMY' ELSE t END AS term, score, n AS n_sources, CASE WHEN n >= 4 OR score >= 16 THEN 'high' ELSE 'medium' END AS confidence, 'technical' AS category
FROM (SELECT p_type AS t, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 5 ELSE 2 END) AS BIGINT) AS score, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) WHERE n >= 2 OR score >= 5""")
def glossary_scores(t: Tables) -> DataFrame:
    """Terms, the sum of the weights of where they were found, confidence, category."""
    finds = t.part.select(F.concat(F.lit("`"), "p_type", F.lit("`:")).alias("term"), F.when(F.col("p_size") % 2 == 0, "json").otherwise("acronym").alias("kind"), F.col("p_brand").alias("source"))
    return ex.glossary(finds).select("term", "score", "n_sources", "confidence", "category")


@R.add("""SELECT o_orderkey, score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'moderate' ELSE 'emerging' END AS label FROM (
SELECT o_orderkey, least(greatest(round(0.45 + CASE k WHEN 0 THEN 0.35 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 WHEN 3 THEN -0.1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN k < 2 THEN 0.08 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.07 ELSE 0 END
+ CASE o_orderstatus WHEN 'F' THEN 0.12 WHEN 'O' THEN 0.08 ELSE 0.02 END + CASE WHEN k = 4 THEN 0 WHEN k % 2 = 0 THEN 0.1 ELSE 0.06 END, 2), 0.05), 1.0) AS score FROM (SELECT *, o_orderkey % 5 AS k FROM orders))""")
def information_weights(t: Tables) -> DataFrame:
    """M01, A17's inputs: additive weights with their label."""
    k, s = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), k)
    w = sc.information_weight(pick("Guideline", "meta-analysis", "trial", "operative-note", "letter"), F.when(k % 2 == 0, "Cardiologia").otherwise("other"), F.when(k < 2, "ACC/AHA").otherwise("none"), s == "F",
                              F.when(s == "F", "1").when(s == "O", "2A").otherwise("3: HARM"), F.when(k == 4, None).when(k % 2 == 0, "A").otherwise("B-R"))
    return t.orders.select("o_orderkey", w["score"].alias("score")).withColumn("label", sc.tier(F.col("score"), sc.WEIGHT_TIERS, "emerging"))


@R.add("""SELECT o_orderkey, least(round(0.35 + CASE WHEN a THEN 0.15 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END + CASE WHEN c THEN 0.16 ELSE 0 END + 0.04 + CASE WHEN a THEN 0.04 ELSE 0 END + CASE WHEN b THEN 0.04 ELSE 0 END, 3), 0.99) AS confidence,
concat_ws('+', CASE WHEN a THEN 'recommendation-language' END, CASE WHEN b THEN 'cor' END, CASE WHEN b THEN 'loe' END, CASE WHEN c THEN 'population-extracted' END, CASE WHEN c THEN 'intervention-extracted' END, 'locator', CASE WHEN a THEN 'temporal' END, CASE WHEN b THEN 'entities' END) AS reasons,
CASE WHEN NOT b THEN 'unspecified' WHEN o_orderkey % 2 = 0 THEN 'strong' ELSE 'moderate' END AS strength FROM (SELECT *, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS c FROM orders)""")
def extraction_confidences(t: Tables) -> DataFrame:
    """M02 with its reasons, M03."""
    a, b, c = (F.col("o_orderkey") % n == 0 for n in (2, 3, 5))
    cor, loe = F.when(b, "1"), F.when(b, F.when(a, "A").otherwise("B"))
    some = lambda test, n: F.when(test, F.array(*[F.lit(str(i)) for i in range(n)])).otherwise(F.array().cast("array<string>"))
    s = sc.extraction_confidence(a, cor, loe, F.when(c, "x"), F.when(c, "y"), F.lit("p1"), some(a, 1), some(b, 3))
    return t.orders.select("o_orderkey", s["score"].alias("confidence"), F.array_join(s["reasons"], "+").alias("reasons"), sc.strength_label(cor, loe).alias("strength"))


@R.add("""SELECT o_orderkey, round(CASE WHEN k = 0 THEN 0.67 ELSE (k + (k + 1) % 4) / 6.0 END, 6) AS mean, CASE WHEN k IN (1, 3) THEN TRUE ELSE FALSE END AS critical, CASE WHEN k = 0 THEN 'title' WHEN k = 1 THEN 'doi,title' ELSE '' END AS gaps,
round(least(greatest(0.6 * CASE k WHEN 0 THEN 0.58 WHEN 1 THEN 0.74 WHEN 2 THEN 0.88 ELSE 0.97 END + 0.4 * (o_totalprice / 500000), 0.5), 0.99), 2) AS reliability FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def dimension_scores(t: Tables) -> DataFrame:
    """A17, A21, M10, M21."""
    k = F.col("o_orderkey") % 4
    scores = F.when(k == 0, F.array().cast("array<double>")).otherwise(F.array(k.cast("double"), ((k + 1) % 4).cast("double")))
    marks = F.array(F.struct(F.lit("x").alias("code"), F.when(k % 2 == 1, "critical").otherwise("warning").alias("severity")))
    gaps = sc.missing(F.array(F.lit("doi"), F.lit("title")), F.when(k == 0, F.array(F.lit("doi"))).when(k > 1, F.array(F.lit("title"), F.lit("doi"))))
    source = F.get(F.array(*[F.lit(x) for x in sc.RELIABILITY]), k)
    return t.orders.select("o_orderkey", F.round(sc.dimension_mean(scores), 6).alias("mean"), sc.has_severity(marks, "critical").alias("critical"), F.array_join(gaps, ",").alias("gaps"), sc.reliability(source, F.col("o_totalprice") / 500000).alias("reliability"))


@R.add(f"SELECT p_partkey, {wanted('Class I', 'Class IIa', 'Class IIb', 'Class III', 'Class I')} AS level, {wanted('Strong', 'Weak', 'Moderate', 'Weak', 'Strong')} AS strength FROM part")
def recommendation_levels(t: Tables) -> DataFrame:
    """Level from title and synopsis, strength from tags."""
    level = de.recommendation_level(said("A Guideline of @", "Expert consensus", "Review of @", "Trial of @", "Review"), said("", "review", "", "none", "the guideline"))
    tags = F.get(F.array(*[F.array(*map(F.lit, x)) for x in (["Guideline"], ["trial"], ["a", "REVIEW"], ["none"], ["review", "recommendation"])]), F.col("p_partkey") % 5)
    return keyed(t, level=level, strength=de.recommendation_strength(tags))


@R.add(f"SELECT p_partkey, {wanted('highly_sensitive', 'highly_sensitive', 'restricted', 'confidential')} AS class_, {wanted(de.SENSITIVE['highly_sensitive'], de.SENSITIVE['highly_sensitive'], de.SENSITIVE['restricted'], de.SENSITIVE['confidential'])} AS reason FROM part")
def sensitivity_classes(t: Tables) -> DataFrame:
    """M22."""
    s = de.sensitivity(said("consent", "note", "lab", "note"), said("x", "con Firma de @", "y", "z of @"))
    return keyed(t, class_=s["class"], reason=s["reason"])


@R.add("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 900 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 500 WHEN p_size % 3 = 1 THEN 0 ELSE 140 END + CASE p_partkey % 4 WHEN 0 THEN 260 WHEN 1 THEN 210 WHEN 2 THEN 220 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 160 ELSE 100 END
+ CASE WHEN contains(p_name, 'widget') THEN 120 ELSE 0 END - CASE WHEN p_partkey % 7 = 0 THEN 30 ELSE 0 END AS score FROM part""")
def display_priorities(t: Tables) -> DataFrame:
    """M19."""
    key, size = F.col("p_partkey"), F.col("p_size") % 3
    text = F.when(F.contains("p_name", F.lit("widget")), "valve repair").otherwise("thing")
    score = de.display_priority(text, F.when(F.col("p_type") == "PROMO", "route-ready"), F.when(size == 0, "LOCAL_X").when(size == 1, "ICD10_PCS").otherwise("ATC"), F.get(F.array(*map(F.lit, ("diagnosis", "procedure", "outcome", "none"))), key % 4),
                                F.when(key % 2 == 0, "critical-pathway-anchor").otherwise("route-anchor"), F.when(key % 7 == 0, F.repeat(F.lit("x"), F.lit(221))).otherwise("x"), own="LOCAL")
    return keyed(t, score=score)


@R.add("""SELECT c_nationkey, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 1) AS completeness, round(avg(abs(c_acctbal) / 10000), 4) AS reliability,
CASE WHEN avg(abs(c_acctbal) / 10000) >= 0.5 THEN 'Nivel 1 (interno validado)' WHEN avg(abs(c_acctbal) / 10000) >= 0.4 THEN 'Nivel 2 (revisión requerida)' ELSE 'Nivel 3 (confiabilidad limitada)' END AS tier FROM customer GROUP BY 1""")
def reliability_tiers(t: Tables) -> DataFrame:
    """Completeness, mean reliability and its tier."""
    g = t.customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("ok"), F.count("*").alias("n"), F.sum(F.abs("c_acctbal") / 10000).alias("s"))
    r = g.select("c_nationkey", de.reliability_tier(F.col("ok"), F.col("n"), F.col("s"), 0.5, 0.4).alias("r"))
    return r.select("c_nationkey", "r.completeness", F.round("r.reliability", 4).alias("reliability"), "r.tier")


@R.add("""SELECT user_id, round((least(100, 16 * count(*) FILTER (event_type = 'view')) + least(100, 25 * count(*) FILTER (event_type = 'click')) + CASE WHEN bool_and(value > 5) THEN 100 ELSE 40 END + CASE WHEN bool_or(event_type = 'purchase') THEN 78 ELSE 64 END) / 4.0, 2) AS score FROM events GROUP BY 1""")
def traceability_scores(t: Tables) -> DataFrame:
    """The mean of four coverages."""
    kind = F.col("event_type")
    g = t.events.groupBy("user_id").agg(F.count_if(kind == "view").alias("a"), F.count_if(kind == "click").alias("b"), F.bool_and(F.col("value") > 5).alias("c"), F.bool_or(kind == "purchase").alias("d"))
    return g.select("user_id", de.traceability(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("score"))


@R.add("""SELECT s_suppkey, CAST(88 + s_suppkey % 7 AS DOUBLE) AS ecs, round(0.2 + sev * 0.045, 2) AS uci, CASE WHEN sev >= 4 OR round(0.2 + sev * 0.045, 2) > 0.55 THEN 4 WHEN sev >= 3 OR round(0.2 + sev * 0.045, 2) > 0.35 THEN 3 ELSE 2 END AS level FROM (SELECT *, s_suppkey % 5 AS sev FROM supplier)""")
def case_translations(t: Tables) -> DataFrame:
    """Translation scores of a case, and its uncertainty level."""
    severity = F.nullif(F.col("s_suppkey") % 5, F.lit(0))
    s = t.supplier.select("s_suppkey", severity.alias("sev"), de.case_translation(F.col("s_suppkey") % 7, severity).alias("t"))
    return s.select("s_suppkey", "t.ecs", "t.uci", de.case_uncertainty(F.col("sev"), F.col("t.uci")).alias("level"))


def _case(c: str = "s_suppkey") -> dict:
    """Columns of a case, made of a key so that each check fails for some."""
    key = F.col(c)
    some = lambda n: key % n != 0
    return {
        "certificate": some(11), "case_id": F.lit("C1"), "episode_id": F.when(some(13), "E1").otherwise(""), "consent": some(7), "required": F.array(F.lit("age"), F.lit("ef")), "completeness": F.when(some(5), 0.9).otherwise(0.8),
        "codes": dict(zip(("icd10", "snomed", "loinc", "ucum", "rxnorm", "udi"), (key % n for n in (17, 19, 23, 29, 31, 37)), strict=True)), "present": F.when(some(3), F.array(F.lit("ef"), F.lit("age"))).otherwise(F.array(F.lit("ef"))),
        "data_present": F.lit(True), "severity": key % 5, "objects": key % 7, "guideline_active": F.lit(True), "version_active": some(2), "critical_events": F.when(some(4), 0).otherwise(1), "transition": some(6),
    }


@R.add("""SELECT s_suppkey, concat_ws('; ', CASE WHEN s_suppkey % 11 = 0 THEN 'ILC invalid or missing' END, CASE WHEN s_suppkey % 13 = 0 THEN 'Episode ID missing' END, CASE WHEN s_suppkey % 7 = 0 THEN 'Active consent missing' END, CASE WHEN s_suppkey % 5 = 0 THEN 'Data Completeness Index below threshold' END) AS igl,
concat_ws('; ', CASE WHEN s_suppkey % 17 = 0 THEN 'ICD-10 codes missing' END, CASE WHEN s_suppkey % 19 = 0 THEN 'SNOMED CT codes missing' END, CASE WHEN s_suppkey % 23 = 0 THEN 'LOINC codes missing' END, CASE WHEN s_suppkey % 29 = 0 THEN 'UCUM units missing' END, CASE WHEN s_suppkey % 31 = 0 THEN 'RxNorm/ATC terms missing' END, CASE WHEN s_suppkey % 37 = 0 THEN 'UDI/GS1 traceability missing' END) AS tg,
concat_ws('; ', CASE WHEN s_suppkey % 5 = 4 THEN 'EUL must be LEVEL I-III' END, CASE WHEN s_suppkey % 3 = 0 THEN 'DDMO-Gate must pass' END, CASE WHEN s_suppkey % 2 = 0 THEN 'VRN is not active' END) AS kbol FROM supplier""")
def governance_gates(t: Tables) -> DataFrame:
    """IGL, TG, KBOL; RDY-G and LCCB are layers of ``case_layer_runs``."""
    c = _case()
    level = de.case_uncertainty(c["severity"], de.case_translation(c["objects"], c["severity"])["uci"])
    complete = F.size(F.array_except(c["required"], c["present"])) == 0
    g = {"igl": de.information_gate(c), "tg": de.terminology_gate(c["codes"]), "kbol": de.order_gate(level, complete, c["guideline_active"], c["version_active"])}
    return t.supplier.select("s_suppkey", *[F.array_join(x["blocking"], "; ").alias(n) for n, x in g.items()])


@R.add("""SELECT s_suppkey, concat_ws(',', CASE WHEN igl THEN 'IGL' END, CASE WHEN tg THEN 'TG' END, CASE WHEN s_suppkey % 3 = 0 THEN 'ETE' END, CASE WHEN kbol THEN 'KBOL,RO,BOM,TAM' END, CASE WHEN s_suppkey % 4 = 0 THEN 'RDY-G,LCCB' END, CASE WHEN s_suppkey % 6 = 0 THEN 'CCCL' END) AS critical,
NOT (igl OR tg OR kbol OR s_suppkey % 4 = 0 OR s_suppkey % 6 = 0) AS ok, 17 AS layers FROM (SELECT s_suppkey, s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 AS igl,
s_suppkey % 17 = 0 OR s_suppkey % 19 = 0 OR s_suppkey % 23 = 0 OR s_suppkey % 29 = 0 OR s_suppkey % 31 = 0 OR s_suppkey % 37 = 0 AS tg, s_suppkey % 5 = 4 OR s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 AS kbol FROM supplier)""")
def case_layer_runs(t: Tables) -> DataFrame:
    """The 17 layers of a case, their blockers, and whether all is well."""
    rows = t.supplier.select("s_suppkey", de.case_layers(_case()).alias("l"))
    critical = F.transform(F.filter("l", lambda x: x["critical"]), lambda x: x["id"])
    return rows.select("s_suppkey", F.array_join(critical, ",").alias("critical"), de.case_ok(F.col("l")).alias("ok"), F.size("l").alias("layers"))


@R.add("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'p' || o_custkey END AS pmid, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'd' END AS doi, CASE o_orderstatus WHEN 'F' THEN 'validated_primary' WHEN 'O' THEN 'validated_other' ELSE 'open' END AS st, o_orderkey % 5 AS k FROM orders)
SELECT id, 'duplicate-pmid' AS rule FROM (SELECT *, count(*) OVER (PARTITION BY pmid) AS n FROM r) WHERE pmid <> '' AND n > 1 UNION ALL SELECT id, 'validated-without-doi' FROM r WHERE st <> 'open' AND doi = '' UNION ALL SELECT id, 'core-incomplete' FROM r WHERE k = 0 AND (doi = '' OR st = 'open')
UNION ALL SELECT id, 'top10-status' FROM r WHERE id <= 10 AND st <> 'validated_primary' UNION ALL SELECT id, 'guideline-source' FROM r WHERE k = 1 AND doi = ''""")
def record_audit(t: Tables) -> DataFrame:
    """The rules of a quality audit as issue rows."""
    key = F.col("o_orderkey")
    doi = F.when(key % 4 == 0, "").otherwise("d")
    status = F.when(F.col("o_orderstatus") == "F", "validated_primary").when(F.col("o_orderstatus") == "O", "validated_other").otherwise("open")
    records = t.orders.select(
        key.alias("id"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("p"), "o_custkey")).alias("pmid"), doi.alias("doi"), doi.alias("title"), status.alias("validation_status"),
        F.when(key % 5 == 0, "absolute_core").otherwise("other").alias("tier"), key.alias("priority_rank"), F.when(key % 5 == 1, "guideline_trunk").otherwise("x").alias("domain_group"), F.when(key % 4 == 0, None).otherwise("pubmed").alias("source_of_truth"))
    return de.quality_audit(records).select("id", "rule")


@R.add("SELECT 'LINK-GP1-' || p_partkey AS link_id, CAST(p_partkey AS VARCHAR) AS object_id, p_brand AS record_id, upper(p_type) AS group_label FROM part")
def package_link_rows(t: Tables) -> DataFrame:
    """L09."""
    objects = t.part.select(F.col("p_partkey").cast("string").alias("object_id"), F.col("p_brand").alias("record_id"), F.lower("p_type").alias("domain"))
    return de.package_links(objects, "GP1").select("link_id", "object_id", "record_id", "group_label")


@R.add("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 10 AND p_brand = 'Brand#1'")
def active_sets(t: Tables) -> DataFrame:
    """The active set of a system and version."""
    sets = t.part.select("p_partkey", F.col("p_type").alias("system"), F.col("p_brand").alias("version"), (F.col("p_size") > 10).alias("is_active"))
    return de.active_set(sets, "PROMO", "Brand#1").select("p_partkey")


@R.add("SELECT p_partkey, p_brand IN ('Brand#1', 'Brand#2') AND p_type = 'PROMO' AND p_size > 5 AS blocked FROM part")
def blocked_reactivations(t: Tables) -> DataFrame:
    """Changes that a deprecation record blocks; ``raise_if_blocked`` lets the others through."""
    changes = t.part.select("p_partkey", "p_brand", F.when(F.col("p_type") == "PROMO", "ACTIVE").otherwise("DRAFT").alias("status"), (F.col("p_size") <= 5).alias("allow"))
    gone = t.part.where("p_brand IN ('Brand#1', 'Brand#2')").select("p_brand")
    marked = de.reactivated(changes, gone, "p_brand")
    through = de.raise_if_blocked(marked.where("NOT blocked"))
    return through.unionByName(marked.where("blocked")).select("p_partkey", "blocked")


@R.add("SELECT o_orderkey AS recordId, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS outcomes, CASE WHEN o_orderkey % 4 = 0 THEN 'title' ELSE '' END AS missing FROM orders")
def adapted_artefacts(t: Tables) -> DataFrame:
    """Interchange records to the model."""
    a = t.orders.select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise("t").alias("canonical_title"), F.when(F.col("o_orderkey") % 3 != 0, F.array("o_orderstatus")).alias("clinical_outcomes"))
    m = de.adapted(a, {"record_id": "recordId", "canonical_title": "title", "clinical_outcomes": "outcomes"}, ["record_id", "canonical_title"])
    return m.select("recordId", F.array_join("outcomes", ",").alias("outcomes"), F.array_join("missing", ",").alias("missing"))


@R.add("SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand = 'PROMO' OR p_size = 7")
def facet_values(t: Tables) -> DataFrame:
    """the primary value, or any of all values."""
    rows = t.part.withColumn("all", F.array("p_brand", F.when(F.col("p_size") == 7, "PROMO").otherwise("none")))
    return rows.where(op.facet("p_type", "all", "PROMO")).select("p_partkey")


@R.add("SELECT p_partkey FROM part WHERE (contains(lower(p_type), 'mo') OR contains(lower(p_name), 'mo')) AND p_size >= 20")
def preset_filters(t: Tables) -> DataFrame:
    """a preset sets several filters; a type matches in type or subtype."""
    kind = F.contains(F.lower("p_type"), F.lit("mo")) | F.contains(F.lower("p_name"), F.lit("mo"))
    return op.presets(t.part, "large", {"large": [kind, op.at_least("p_size", 20)], "none": [F.lit(False)]}).select("p_partkey")


@R.add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def overlaid_rows(t: Tables) -> DataFrame:
    """A left join whose right rows override."""
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"))
    return op.overlay(t.customer.select("c_custkey", "c_mktsegment"), new, "c_custkey")


@R.add("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT p_partkey AS k, nullif(p_brand, 'Brand#1') AS v FROM part WHERE p_partkey % 3 = 0) b ON a.k = b.k")
def full_overlay(t: Tables) -> DataFrame:
    """Catalogue and state, whichever has a row; the state wins where it has a value."""
    a = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"))
    b = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.nullif("p_brand", F.lit("Brand#1")).alias("v"))
    return op.overlay(a, b, "k", "full")


@R.add("SELECT p_type, p_brand, count(*) AS n, round(avg(p_retailprice), 3) AS mean_weight, round(avg(CAST(p_size AS DOUBLE)), 3) AS mean_confidence FROM part GROUP BY 1, 2")
def topic_ranking(t: Tables) -> DataFrame:
    """A01."""
    r = op.ranking(t.part.withColumn("p_size", F.col("p_size").cast("double")), ["p_type", "p_brand"], "p_retailprice", "p_size")
    n, w, c = [x for x in r.columns if x not in ("p_type", "p_brand")]
    return r.select("p_type", "p_brand", F.col(n).cast("long").alias("n"), F.col(w).alias("mean_weight"), F.col(c).alias("mean_confidence"))


@R.add("SELECT lang, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM documents GROUP BY lang")
def joined_values(t: Tables) -> DataFrame:
    """A26."""
    return t.documents.groupBy("lang").agg(op.joined_set("source").alias("sources"))


@R.add("SELECT v, row_number() OVER (ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), lower(v), v) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS v FROM part)")
def mixed_sort(t: Tables) -> DataFrame:
    """Numbers by value, then texts."""
    from pyspark.sql import Window

    v = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("v")).distinct()
    return v.select("v", F.row_number().over(Window.orderBy(*op.mixed_order("v"), "v")).alias("place"))  # a report's few distinct values


@R.add("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def seen_set(t: Tables) -> DataFrame:
    """The first row of each composite key."""
    return linkage.by_key(t.documents.select("doc_id", "lang", "source"), F.struct("lang", "source"), ["doc_id"]).select("doc_id")


@R.add("SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')")
def normalized_key_dedup(t: Tables) -> DataFrame:
    """By letters and digits alone."""
    return linkage.by_key(t.documents.select("doc_id", "text"), tx.title_key("text"), ["doc_id"]).select("doc_id")


@R.add("SELECT DISTINCT id FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT p_partkey FROM part)")
def united_ids(t: Tables) -> DataFrame:
    """Ids of two sources, each once."""
    return t.lineitem.select(F.col("l_partkey").alias("id")).union(t.part.select("p_partkey")).distinct()


@R.add("SELECT p_partkey, p_type AS name, 1994 + p_partkey % 3 AS year FROM part")
def normalized_ingests(t: Tables) -> DataFrame:
    """Trimmed texts, parsed times, years."""
    raw = t.part.select("p_partkey", F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("name"), F.concat((1994 + F.col("p_partkey") % 3).cast("string"), F.lit("-03-04T05:06:07Z ")).alias("at"))
    return lineage.normalized_ingest(raw, "at").select("p_partkey", "name", "year")


@R.add("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def event_timeline(t: Tables) -> DataFrame:
    """Each event's place in its document's history."""
    return lineage.timeline(t.events, "user_id", "ts").select("event_id", "n")


@R.add("SELECT s_suppkey, 'SUP::' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS term FROM supplier")
def preferred_terms(t: Tables) -> DataFrame:
    """The preferred term of a concept, else its code."""
    concepts = t.supplier.select("s_suppkey", tx.joined_id(F.lit("SUP"), "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("code"))
    terms = t.supplier.where("s_suppkey % 2 = 0").select(tx.joined_id(F.lit("SUP"), "s_suppkey").alias("concept_id"), F.col("s_name").alias("term"), F.lit("preferred").alias("type"))
    out = op.preferred_term(concepts, terms)
    (name,) = [c for c in out.columns if c not in ("s_suppkey", "id", "code")]
    return out.select("s_suppkey", "id", F.col(name).alias("term"))
