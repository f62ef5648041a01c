"""Queries of the text rules over whole documents, conversations and pages.

Word lists are parameters of the rules; those here are words of the tables' languages. The SQL states each
rule again with DuckDB's own functions; where a rule looks around a match, the SQL puts back what it took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import extraction as ex, lineage
from .base import Registry, Tables
from .documents import FOLDED

R = Registry()

#: Wording that stands for "recommends" here: these words, whole.
WORDING = r"(?i)(^|[^\p{L}])(the|of|der|und|les|que)([^\p{L}]|$)"
LINES = "(SELECT doc_id, i - 1 AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def replaced(x: str, *steps: tuple[str, str]) -> str:
    """SQL that makes the replacements in turn."""
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


CITED = r"\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*"
SPACES, BROKEN, DOTTED = (r"\s+", " "), (r"(\w)-\s+(\w)", r"\1\2"), (r"([A-Za-z])\.(\d)", r"\1. \2")
MARKS = [
    (r"[\x00-\x08\x0b-\x1f]", " "), ("�", " "), (r"^(?:NR|R|LD|EO|LM)\s+([A-Z])", r"\1"), (r"(?i)\b(?:table|figure|fig)\s+\d+[a-z]?\b", ""), (r"\(\s*\d+(?:\s*,\s*\d+)*\s*\)", ""),
    (rf"([A-Za-z\)]){CITED}([.;,:)]|\s*$)", r"\1\2"), (rf"(\s){CITED}([.;,:)]|\s*$)", r"\1\2"), (rf"^{CITED}\s+", ""), (r"(?i)\bDownloaded from .*?$", ""), (r"\b(?:COR|LOE)\b", ""),
    (r"\b(?:A|B-R|B-NR|C-LD|C-EO|C-LM|C)\b\s*$", ""), (r"\s+\d+\s*$", ""), (r"([<>])\s+", r"\1"),
]


def clean_sql(x: str) -> str:
    """T08 in SQL."""
    x = f"trim({replaced(x, (chr(92) + '|', ' '), BROKEN, DOTTED, SPACES)}, ' ;,.-')"
    return f"trim({replaced(x, *MARKS, SPACES)}, ' ')"


def finish_sql(name: str, source: str, keys: str) -> str:
    """T09 in SQL, as tables: ``name`` has the keys and ``done`` of the source's ``line``."""
    before = [f"regexp_extract(c, '(?s)^(.*?)(?:{m})', 1)" for m in tx.TAIL_MARKERS]
    cut = "coalesce(" + ", ".join(f"CASE WHEN length({x}) > 40 THEN trim({x}, ' ;,.-') END" for x in before) + ", c)"
    parts = f"list_filter(list_transform({split_sql('c', '.?!')}, lambda s: trim(s, ' ;,.-')), lambda s: s <> '')"
    acts = wording_sql("s")
    return f"""{name}_1 AS (SELECT {keys}, {clean_sql('line')} AS c FROM {source}), {name}_2 AS (SELECT {keys}, {cut} AS c FROM {name}_1), {name}_3 AS (SELECT {keys}, c, {parts} AS p FROM {name}_2),
{name} AS (SELECT {keys}, {clean_sql(f"coalesce(list_filter(p, lambda s: NOT {heading_sql('s', acts)} AND {acts})[1], p[1], c)")} AS done FROM {name}_3)"""


def split_sql(x: str, ends: str) -> str:
    """T12 in SQL: trimmed parts after each of ``ends`` and white space, without empty ones."""
    marked = rf"regexp_replace({x}, '([{ends}])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def wording_sql(x: str) -> str:
    return f"regexp_matches({x}, '{WORDING}')"


def heading_sql(x: str, acts: str) -> str:
    """T11 in SQL."""
    low = f"trim(lower({x}), ' ;,.-')"
    known = " OR ".join([f"contains({low}, '{p}')" for p in tx.HEADING_PARTS] + [f"starts_with({low}, '{p.rstrip()}{' ' * p.endswith(' ')}')" for p in tx.HEADING_STARTS])
    titled = rf"(contains({low}, ' recommendation for ') OR regexp_matches({low}, ' recommendations?$') OR regexp_matches(trim({x}), '^[A-Z][A-Za-z0-9/&,\-:\(\)\s]{{8,}}$'))"
    return f"({low} = '' OR {known} OR ({titled} AND NOT {acts}))"


@R.add(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapsed_space(t: Tables) -> DataFrame:
    """T01."""
    return t.documents.select("doc_id", tx.collapse("text").alias("text"))


@R.add(f"SELECT doc_id, {FOLDED.format(c='text')} AS text FROM documents")
def folded_accents(t: Tables) -> DataFrame:
    """T02."""
    return t.documents.select("doc_id", tx.fold("text").alias("text"))


@R.add(f"SELECT doc_id, n, {clean_sql('line')} AS text FROM {LINES}")
def cleaned_statements(t: Tables) -> DataFrame:
    """T08."""
    return lines(t).select("doc_id", "n", tx.clean_statement("line").alias("text"))


@R.add(f"WITH {finish_sql('f', LINES, 'doc_id, n')} SELECT doc_id, n, done AS text FROM f")
def finished_statements(t: Tables) -> DataFrame:
    """Cut at supporting text, then the first sentence with the wording, else the first."""
    return lines(t).select("doc_id", "n", tx.finalize_statement("line", WORDING).alias("text"))


_flat = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@R.add(f"""WITH d AS (SELECT doc_id, {_flat} AS flat, {split_sql(_flat, '.!?;')} AS s FROM documents), l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d), {finish_sql('f', 'l', 'doc_id, i')},
g AS (SELECT doc_id, list(done ORDER BY i) AS parts FROM f GROUP BY doc_id), h AS (SELECT doc_id, flat, list_filter(parts, lambda s: NOT {heading_sql('s', wording_sql('s'))} AND {wording_sql('s')}) AS good, list_filter(parts, lambda s: s <> '') AS filled FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, array_to_string(CASE WHEN len(good) > 0 THEN list_slice(good, 1, 24) WHEN len(filled) > 0 THEN list_slice(filled, 1, 5) ELSE [substring(flat, 1, 240)] END, '|') AS chosen FROM h""")
def selected_statements(t: Tables) -> DataFrame:
    """Sentences with the wording, else the first five, else the start."""
    return t.documents.select("doc_id", F.array_join(tx.select_statements("text", WORDING), "|").alias("chosen"))


@R.add(f"SELECT doc_id, n, {wording_sql('line')} AS acts, {heading_sql('line', wording_sql('line'))} AS heads, NOT {heading_sql('line', wording_sql('line'))} AND {wording_sql('line')} AS recommends FROM {LINES}")
def recommending_language(t: Tables) -> DataFrame:
    """T10, T11, with wording of one's own."""
    return lines(t).select("doc_id", "n", tx.actionable("line", WORDING).alias("acts"), tx.heading("line", WORDING).alias("heads"), tx.recommends("line", WORDING).alias("recommends"))


@R.add(f"SELECT conv_id, turn, role, {heading_sql('text', 'regexp_matches(text, ' + chr(39) + tx.ACTIONABLE + chr(39) + ')')} AS heads FROM conversations")
def heading_rules(t: Tables) -> DataFrame:
    """T11."""
    return t.conversations.select("conv_id", "turn", "role", tx.heading("text").alias("heads"))


_NOTICE = "|".join(tx.POLICY_WORDS)
_policy = f"(regexp_matches(lower(line), '{_NOTICE}') OR (regexp_matches(lower(line), '{tx.PEOPLE}') AND NOT regexp_matches(lower(line), 'recommended|should')))"


@R.add(f"SELECT doc_id, n, length(line) BETWEEN 24 AND 900 AND NOT contains(line, '?') AND NOT {_policy} AND NOT {heading_sql('line', wording_sql('line'))} AND {wording_sql('line')} AS accepted FROM {LINES}")
def accepted_statements(t: Tables) -> DataFrame:
    """T21, with wording of one's own."""
    return lines(t).select("doc_id", "n", tx.acceptable("line", WORDING).alias("accepted"))


_acts = f"regexp_matches(line, '{tx.ACTIONABLE}')"
_word = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
_class = rf"regexp_replace(upper(trim({_word}, ' ,.;')), '^(?:COR|CLASS)\s+', '')"
_level = rf"regexp_replace(upper(trim(regexp_replace({_word}, '\s+', '', 'g'), ' ,.;')), '^(?:LOE|LEVEL(?:OFEVIDENCE)?)', '')"
_one_of = lambda x, values: f"{x} IN ({', '.join(repr(v) for v in values)})"


@R.add(rf"""SELECT doc_id, n, length(line) < 3 OR regexp_matches(lower(line), '^\d+$|^http|doi:|^downloaded from') OR {_policy} OR regexp_matches(lower(line), '{tx.JOURNALS}') OR {heading_sql('line', _acts)} AS noise,
upper({_word}) IN ('COR', 'LOE', 'RECOMMENDATION', 'RECOMMENDATIONS') OR {_one_of(_class, tx.CLASSES)} OR {_one_of(_level, tx.LEVELS)} OR regexp_matches({_word}, '^\d+\.?$') AS structure FROM {LINES}""")
def noise_and_structure(t: Tables) -> DataFrame:
    """Noise lines and structural lines."""
    return lines(t).select("doc_id", "n", tx.noise_line("line").alias("noise"), tx.structural_line("line").alias("structure"))


_safe = "replace(replace(replace(line, 'e.g.', 'e<dot>g<dot>'), 'i.e.', 'i<dot>e<dot>'), 'vs.', 'vs<dot>')"


@R.add(f"SELECT doc, n, text FROM (SELECT doc_id AS doc, n, unnest(list_filter(list_transform(string_split(regexp_replace({_safe}, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(replace(s, '<dot>', '.'))), lambda s: s <> '')) AS text FROM {LINES})")
def narrative_sentences(t: Tables) -> DataFrame:
    """Sentences of lines, with abbreviations that end none."""
    found = ex.action_sentences(lines(t).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "n", "line"))
    return found.select("doc", "n", "text")


@R.add(f"SELECT doc_id, array_to_string(list_slice(s, 1, 6), ' ') AS summary, s[-1] AS takeaway FROM (SELECT doc_id, {split_sql('text', '.!?')} AS s FROM documents)")
def summaries(t: Tables) -> DataFrame:
    """T44."""
    return t.documents.select("doc_id", tx.summary("text").alias("s")).select("doc_id", "s.summary", "s.takeaway")


#: Kinds of documents, by the first pattern that fits.
KINDS = [(r"token\s*=", "secret"), ("licen[sc]e", "licensed"), (r"[a-z0-9]@[a-z0-9]+\.", "mail"), (r"\+1 \([0-9]{3}\)", "phone"), (r"[0-9]{16}", "card"), (r"([0-9]{1,3}\.){3}[0-9]", "address")]


@R.add("SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for p, k in KINDS) + ", 'prose') AS kind FROM documents")
def study_designs(t: Tables) -> DataFrame:
    """The first pattern that fits, of a list of one's own."""
    return t.documents.select("doc_id", tx.first_pattern("text", KINDS, "prose").alias("kind"))


#: Words that give a language away, in order.
SPOKEN = [(" und ", "de"), (" les ", "fr"), (" los ", "es"), (" the ", "en")]


@R.add("SELECT doc_id, lang, coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{k}' END" for w, k in SPOKEN) + ", 'en') AS guess FROM documents")
def guessed_languages(t: Tables) -> DataFrame:
    """Words of one's own."""
    return t.documents.select("doc_id", "lang", tx.guess_language("text", SPOKEN).alias("guess"))


@R.add(r"SELECT doc_id, TRY_CAST(regexp_extract(replace(text, ',', '.'), '-?\d+(\.\d+)?') AS DOUBLE) AS number FROM documents")
def decimal_numbers(t: Tables) -> DataFrame:
    """The first number of a document."""
    return t.documents.select("doc_id", tx.number_in("text").alias("number"))


#: What a turn raises, and its topic by the first word that fits.
RAISED = [("[?]", "asked"), ("[0-9]{3}", "numbered"), (r"(^|\s)(the|der|les|los)\s", "article"), ("[%*#]{3}", "shouted")]
TOPICS = [("@", "contact"), ("#", "marked"), (" und ", "german"), (" que ", "romance"), (" of ", "english")]


@R.add("SELECT conv_id, turn, role, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN '{k}' END" for p, k in RAISED) + ") AS raised FROM conversations")
def question_triggers(t: Tables) -> DataFrame:
    """Triggers that a turn raises, by rules of one's own."""
    return t.conversations.select("conv_id", "turn", "role", F.array_join(lineage.inferred_triggers(F.coalesce("text", F.lit("")), RAISED), ",").alias("raised"))


@R.add("SELECT conv_id, turn, role, coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{k}' END" for w, k in TOPICS) + ", 'other') AS topic FROM conversations")
def turn_topics(t: Tables) -> DataFrame:
    """First labels by a list of one's own."""
    return t.conversations.select("conv_id", "turn", "role", tx.first_label("text", TOPICS, "other").alias("topic"))


@R.add(r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(q, '&'), lambda x: CASE WHEN split_part(x, '=', 1) IN ('page', 'ref') AND split_part(x, '=', 2) <> '' THEN replace(x, '=', ':') END), lambda x: x IS NOT NULL), ';') AS cells
FROM (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages)""")
def typed_cell_lists(t: Tables) -> DataFrame:
    """The query parts of addresses as typed cells."""
    query = F.replace(F.replace(F.regexp_extract("url", "[?]([^#]*)", 1), F.lit("="), F.lit(":")), F.lit("&"), F.lit(";"))
    cells = tx.typed_cells(query, ["page", "ref"])
    return t.pages.select("page_id", F.array_join(F.transform(cells, lambda c: F.concat(c["type"], F.lit(":"), c["value"])), ";").alias("cells"))
