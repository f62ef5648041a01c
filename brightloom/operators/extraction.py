"""Recommendations out of the lines of guidelines, by windows over lines instead of cursors.

Input lines are rows of doc, page, n (their order) and line; whatever read the file made them. A table
row begins at a line that fits, goes on over the lines after it, and ends before the next one that fits
or at a stop line: running counts over the ordered lines give each line its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

# How rows begin and end.
COMPACT_ROW = r"(?i)^\s*(3\s*:\s*(?:Harm|No\s+Benefit)|III\s*:\s*(?:Harm|No\s+Benefit)|1|2A|2B|I|IIA|IIB|III)\s+(A|B-NR|B-R|B|C-LD|C-EO|C-LM|C)\s+(\d+)\.\s+(.+)$"
CLASS_LEVEL_ROW = (
    r"(?i)^\s*(?:COR\s*)?(?:Class\s+)?(I{1,3}|IIA|IIB|III(?::\s*(?:Harm|No\s+Benefit))?|1|2A|2B|3(?::\s*(?:Harm|No\s+Benefit))?)()"
    r"\s*[,;/:-]?\s*(?:LOE\s*|Level(?:\s+of\s+Evidence)?\s*)(A|B-NR|B-R|B|C-LD|C-EO|C-LM|C)\s*[,;:-]?\s*(.+)$"
)
STOP = r"(?i)^(?:Synopsis|Recommendation-Specific|Referenced studies|References|Table|Figure)\b"
SECTION = r"^\d+(?:\.\d+){1,3}\.?\s+[A-Z]"
TITLE = r"^[A-Z][A-Za-z0-9/&,\-:\(\)\s]{8,}$"
INLINE = (
    r"(?i)([^.!?;]{24,}?)\s*\((?:class\s+of\s+recommendation\s*\[?COR\]?\s*|COR\s*)(I{1,3}|IIA|IIB|III(?::\s*(?:Harm|No\s+Benefit))?|1|2A|2B|3(?::\s*(?:Harm|No\s+Benefit))?)"
    r"\s*,?\s*(?:level\s+of\s+evidence\s*\[?LOE\]?\s*|LOE\s*)(A|B-NR|B-R|B|C-LD|C-EO|C-LM|C)\)"
)
INLINE_IF = r"(?i)\((?:class\s+of\s+recommendation|COR)"  # a part of every match of INLINE, found in one pass
NUMBERED = r"(?i)(\d+)\.\s+(.+?)(?=(?:\|\s*\d+\.\s+)|(?:\|\s*Recommendation-Specific)|(?:\|\s*Referenced studies)|(?:\|\s*Synopsis)|$)"

FOUND = ["doc", "page", "n", "text", "cor", "loe", "source"]


def by_page():
    return Window.partitionBy("doc", "page").orderBy("n")


def _spans(lines: DataFrame, starts: Column, stops: Column, body: Column, first: Column) -> DataFrame:
    """For each line that starts a row: its number and the body joined with those of the lines after it."""
    marked = lines.withColumn("_start", starts).withColumn("_row", F.sum(F.col("_start").cast("int")).over(by_page())).where("_row > 0")
    inside = Window.partitionBy("doc", "page", "_row").orderBy("n")
    marked = marked.withColumn("_stopped", F.max((stops & ~F.col("_start")).cast("int")).over(inside)).where("_stopped = 0")
    piece = F.struct("n", F.when(F.col("_start"), first).otherwise(body).alias("t"))
    texts = F.array_join(F.filter(F.array_sort(F.collect_list(piece))["t"], lambda t: t.isNotNull() & (t != "")), " ")
    return marked.groupBy("doc", "page", "_row").agg(F.min("n").alias("n"), texts.alias("text"), F.first("cor", ignorenulls=True).alias("cor"), F.first("loe", ignorenulls=True).alias("loe")).drop("_row")


def section_heading(c: str) -> Column:
    """A numbered or title-like line of up to 110 characters."""
    return (F.length(c) <= 110) & (F.col(c).rlike(SECTION) | (F.col(c).rlike(TITLE) & ~tx.recommends(c)))


def pattern_rows(lines: DataFrame, pattern: str, source: str) -> DataFrame:
    """Rows whose first line has class, level and text; ``pattern`` has them as groups 1, 2 or
    3, and 4."""
    fits = F.col("line").rlike(pattern)
    level = F.coalesce(tx.evidence_level(F.regexp_extract("line", pattern, 2)), tx.evidence_level(F.regexp_extract("line", pattern, 3)))
    marked = lines.withColumn("cor", F.when(fits, tx.recommendation_class(F.regexp_replace(F.regexp_extract("line", pattern, 1), r"\s*:\s*", ": ")))).withColumn("loe", F.when(fits, level))
    stops = F.col("line").rlike(STOP) | section_heading("line")
    return _spans(marked, fits, stops, F.trim("line"), F.trim(F.regexp_extract("line", pattern, 4))).withColumn("source", F.lit(source)).select(*FOUND)


def line_tables(lines: DataFrame) -> DataFrame:
    """Tables with a line for the class (or two), one for the level (or two) and numbered text, in
    blocks that a recommendation heading opens and a synopsis closes."""
    low = F.lower("line")
    opens = low.rlike("^recommendations? for ") | low.isin("cor", "loe", "recommendation", "recommendations")
    closes = low.rlike("^(?:synopsis|recommendation-specific)")
    block = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(by_page())
    at = [F.col("line"), *[F.lead("line", i).over(by_page()) for i in range(1, 5)]]
    marked = lines.withColumn("_block", F.coalesce(block, F.lit(False)) & ~opens & ~closes).withColumn("_at", F.array(*at))

    def ahead(i: int) -> Column:
        return F.get("_at", F.lit(i))

    def pair(i: int) -> Column:
        return F.concat_ws(" ", ahead(i), ahead(i + 1))

    one, two = tx.recommendation_class(ahead(0)), tx.recommendation_class(pair(0))
    marked = marked.withColumn("_cor", F.coalesce(one, two)).withColumn("_c", F.when(one.isNotNull(), 1).otherwise(2))
    single = F.when(F.col("_c") == 1, tx.evidence_level(ahead(1))).otherwise(tx.evidence_level(ahead(2)))
    double = F.when(F.col("_c") == 1, tx.evidence_level(pair(1))).otherwise(tx.evidence_level(pair(2)))
    marked = marked.withColumn("_loe", F.coalesce(single, double)).withColumn("_skip", F.col("_c") + F.when(single.isNotNull(), 1).otherwise(2))
    head = F.get("_at", F.col("_skip"))
    marked = marked.withColumn("_head", F.when(F.col("_block") & F.col("_cor").isNotNull() & F.col("_loe").isNotNull() & head.rlike(r"^\d+\.\s*"), F.col("_skip")))
    # The text begins ``_head`` lines on: that line is the row's start.
    starts = F.lit(False)
    cor, loe = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in range(2, 5):
        here = F.coalesce(F.lag("_head", i).over(by_page()) == i, F.lit(False))
        starts, cor, loe = starts | here, F.when(here, F.lag("_cor", i).over(by_page())).otherwise(cor), F.when(here, F.lag("_loe", i).over(by_page())).otherwise(loe)
    rows = marked.withColumn("_first", starts).withColumn("cor", cor).withColumn("loe", loe)
    stops = closes | F.col("_cor").isNotNull() | F.col("line").rlike(r"^\d+\.\d+")
    return _spans(rows, F.col("_first"), stops, F.trim("line"), F.trim(F.regexp_replace("line", r"^\d+\.\s*", ""))).withColumn("source", F.lit("line-table")).select(*FOUND)


def pipe_tables(paragraphs: DataFrame) -> DataFrame:
    """Cells between bars, class, level and numbered text in turn; paragraphs are doc, page, n, line."""
    cells = paragraphs.select("doc", "page", F.col("n").alias("_p"), F.posexplode(F.filter(F.transform(F.split(tx.collapse("line"), r"\|"), lambda t: F.trim(t)), lambda t: t != "")).alias("_i", "line"))
    cells = cells.select("doc", "page", F.struct("_p", "_i").alias("n"), "_p", "line")
    own = Window.partitionBy("doc", "page", "_p").orderBy("n")
    loe, head = tx.evidence_level(F.lead("line", 1).over(own)), F.lead("line", 2).over(own)
    cor = tx.recommendation_class("line")
    begins = F.coalesce(cor.isNotNull() & loe.isNotNull() & head.rlike(r"^\d+\.\s+"), F.lit(False))
    marked = cells.withColumn("_b", begins).withColumn("_cor", cor).withColumn("_loe", loe)
    starts = F.coalesce(F.lag("_b", 2).over(own), F.lit(False))
    marked = marked.withColumn("_first", starts).withColumn("cor", F.when(starts, F.lag("_cor", 2).over(own))).withColumn("loe", F.when(starts, F.lag("_loe", 2).over(own)))
    stops = F.col("_b") | F.col("line").rlike("(?i)Recommendation-Specific|Referenced studies|Synopsis")
    rows = _spans(marked, F.col("_first"), stops, F.trim("line"), F.trim(F.regexp_replace("line", r"^\d+\.\s*", "")))
    return rows.withColumn("n", F.col("n._p")).withColumn("source", F.lit("pipe-table")).select(*FOUND)


def inline_rows(paragraphs: DataFrame) -> DataFrame:
    """Sentences with their grades in brackets."""
    found = paragraphs.where(F.col("line").rlike(INLINE_IF)).select("doc", "page", "n", F.explode(F.regexp_extract_all("line", F.lit(INLINE), F.lit(0))).alias("m"))
    text, cor, loe = (F.regexp_extract("m", INLINE, i) for i in (1, 2, 3))
    return found.select("doc", "page", "n", F.trim(text).alias("text"), tx.recommendation_class(cor).alias("cor"), tx.evidence_level(loe).alias("loe"), F.lit("inline-cor-loe").alias("source"))


def numbered_rows(paragraphs: DataFrame) -> DataFrame:
    """Numbered items of paragraphs that recommend."""
    good = paragraphs.where(F.lower("line").rlike("recommend|should"))
    found = good.select("doc", "page", "n", F.explode(F.regexp_extract_all("line", F.lit(NUMBERED), F.lit(2))).alias("text"))
    none = F.lit(None).cast("string")
    return found.withColumns({"cor": none, "loe": none, "source": F.lit("numbered")}).select(*FOUND)


def action_sentences(paragraphs: DataFrame) -> DataFrame:
    """Every sentence; the accept filter decides."""
    found = paragraphs.select("doc", "page", "n", F.explode(tx.sentences("line", protect=True)).alias("text"))
    none = F.lit(None).cast("string")
    return found.withColumns({"cor": none, "loe": none, "source": F.lit("narrative")}).select(*FOUND)


def candidates(parts: Sequence[DataFrame], most: int | None = None) -> DataFrame:
    """Finished statements of all extractors; of equal ones (letters and digits alone) in
    a document the one of the earlier extractor stays. ``most`` is a report's limit for a document."""
    out = None
    for i, df in enumerate(parts):
        own = df.withColumn("priority", F.lit(i))
        out = own if out is None else out.unionByName(own)
    # Extractors find unlike numbers of statements, so these are dealt anew, by the windows' key. Exploded, a
    # statement is finished once; as a column it would be for the filter and again for each use.
    finished = out.repartition("doc").withColumn("text", F.explode(F.array(tx.finalize_statement("text"))))
    done = finished.where(tx.acceptable("text"))
    best = F.row_number().over(Window.partitionBy("doc", tx.title_key("text")).orderBy("priority", "page", "n"))
    kept = done.withColumn("_r", best).where("_r = 1").drop("_r")
    order = Window.partitionBy("doc").orderBy("priority", "page", "n", "text")
    kept = kept.withColumn("ordinal", F.row_number().over(order)).withColumn("statement_id", F.format_string("%s:S%03d", F.col("doc").cast("string"), "ordinal"))
    return kept if most is None else kept.where(F.col("ordinal") <= most)


def extract_guidelines(lines: DataFrame) -> DataFrame:
    """All extractors over lines (doc, page, n, line); paragraphs are a page's lines joined by bars. Pages are dealt
    before any pattern is tried, as a small table may come in one task."""
    lines = lines.repartition("doc", "page")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], " | ")
    pages = lines.groupBy("doc", "page").agg(F.lit(0).alias("n"), joined.alias("line"))
    prose = pages.withColumn("line", F.replace("line", F.lit(" | "), F.lit(" ")))
    return candidates([line_tables(lines), pattern_rows(lines, COMPACT_ROW, "compact-cor-loe-row"), pipe_tables(pages), pattern_rows(lines, CLASS_LEVEL_ROW, "class-level-row"), inline_rows(prose), numbered_rows(pages), action_sentences(prose)])


def facts(statements: DataFrame) -> DataFrame:
    """What a statement says, with its trigger constraints as one struct."""
    t = F.col("text")
    out = statements.select(
        "*", tx.population(t).alias("population"), tx.intervention(t).alias("intervention"), tx.comparator(t).alias("comparator"), tx.outcome(t).alias("outcome"),
        tx.temporal_qualifiers(t).alias("times"), tx.time_window(t).alias("time_window"), tx.event_anchor(t).alias("event_anchor"), tx.thresholds(t).alias("thresholds"),
        tx.clinical_state(t).alias("clinical_state"), tx.exclusions(t).alias("exclusions"), tx.conditions(t).alias("conditions"), tx.first_label(t, tx.TOPICS, "General").alias("topic"))
    constraints = F.struct("time_window", "event_anchor", "thresholds", "conditions", "exclusions")
    action = F.coalesce(F.nullif(F.concat_ws(" ", "intervention", F.when(F.col("text").rlike("(?i)should not be performed"), "should not be performed").when(F.col("text").rlike("(?i)should be performed"), "should be performed")), F.lit("")), F.substring("text", 1, 120))
    return out.withColumn("execution", F.struct(F.struct(F.col("population").alias("who"), constraints.alias("constraints")).alias("trigger"), action.alias("action")))


# --- Glossary (T45, A11) --------------------------------------------------------------------------

# Categories by words that occur anywhere, and weights of where a term was found.
CATEGORIES = [
    ("medical", ["cabg", "coronary", "cardiac", "cardio", "surgery", "antithrombotic", "bleeding", "colorectal", "eras", "patient", "diagnos", "intervention"]),
    ("governance", ["vrn", "governance", "gobernanza", "review", "audit", "legal", "status"]),
    ("evidence", ["evidence", "evidencia", "ser", "eo", "el", "guideline", "outcome", "certainty", "confidence"]),
]
REASONS = [("json", 5), ("heading", 4), ("definition", 4), ("code", 3), ("acronym", 2)]


def glossary_term(c: Column, stop: Sequence[str] = ()) -> Column:
    """A term without marks, or null if it is none: 2 to 80 characters, no number, version, path or stop
    word."""
    bare = tx.collapse(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]+\]\([^)]+\)", ""), '[`*_#"“”]', ""))
    term = F.regexp_replace(bare, r"^[.:;,\-/\\\s]+|[.:;,\-/\\\s]+$", "")
    bad = ~F.length(term).between(2, 80) | term.rlike(r"(?i)^v?\d+(\.\d+){0,3}$") | F.lower(term).isin(list(stop)) | (F.contains(term, F.lit("/")) & (F.length(term) > 16)) | F.trim(c).rlike("(?i)^/[a-z0-9/_-]+$")
    return F.when(~bad, term)


def glossary(finds: DataFrame, covered: Sequence[str] = (), most: int = 5) -> DataFrame:
    """Terms of (term, kind, source): the sum of the weights of where they were found, up to ``most``
    sources by name, the category, and the confidence; terms of low confidence go."""
    weight = F.coalesce(*[F.when(F.startswith("kind", F.lit(k)), F.lit(w)) for k, w in REASONS], F.lit(1))
    cleaned = finds.withColumn("term", glossary_term(F.col("term"))).where("term IS NOT NULL").withColumn("key", F.lower("term"))
    sums = cleaned.groupBy("key").agg(F.min("term").alias("term"), F.sum(weight).alias("score"), F.count_distinct("source").alias("n_sources"), F.array_sort(F.collect_set("kind")).alias("reasons"), F.array_sort(F.collect_set("source")).alias("sources"))
    category = F.coalesce(*[F.when(F.col("key").rlike("|".join(words)), F.lit(name)) for name, words in CATEGORIES], F.lit("technical"))
    sure = F.when(F.col("key").isin(list(covered)), "covered").when((F.col("n_sources") >= 4) | (F.col("score") >= 16), "high").when((F.col("n_sources") >= 2) | (F.col("score") >= 5), "medium").otherwise("low")
    return sums.withColumn("category", category).withColumn("confidence", sure).withColumn("sources", F.slice("sources", 1, most)).where("confidence <> 'low'").drop("key")


def object_literals(df: DataFrame, key: str, text: str, fields: Sequence[str]) -> DataFrame:
    """Flat object literals in source text, one row each, with the named string fields."""
    blocks = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("b"))
    return blocks.select(key, *[F.nullif(F.regexp_extract("b", rf"\b{f}\b[\"']?\s*:\s*[\"']([^\"']*)[\"']", 1), F.lit("")).alias(f) for f in fields]).where(F.coalesce(*fields).isNotNull())


def search_query(all_of: Sequence[str], any_of: Sequence[str] = (), since: int | None = None, until: int | None = None) -> str:
    """The text of a literature query."""
    parts = [f'"{t}"' for t in all_of]
    if any_of:
        parts.append("(" + " OR ".join(f'"{t}"' for t in any_of) + ")")
    if since or until:
        parts.append(f"{since or 1800}:{until or 2100}[dp]")
    return " AND ".join(parts)
