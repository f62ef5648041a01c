"""Queries over text, linkage, scoring, terminology and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scoring, text as tx
from ..operators import impacts, lineage, linkage, relational as op, states, terminology
from ..sources import readers, writers
from ..streaming import windows
from .base import Registry, Tables

R = Registry()
WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 1)"


@R.add("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(t: Tables) -> DataFrame:
    """D03."""
    return linkage.exact(t.documents, "text", "doc_id")


@R.add("SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')")
def normalized_dedup(t: Tables) -> DataFrame:
    """D08, T05."""
    return t.documents.groupBy(tx.title_key("text").alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@R.add(f"""WITH b AS (SELECT item_id, list_distinct({WORDS.format(c='text')}) AS w FROM benchmark)
SELECT a.item_id AS item_id, c.item_id AS other_id, round(2.0 * len(list_intersect(a.w, c.w)) / (len(a.w) + len(c.w)), 6) AS dice FROM b a JOIN b c ON a.item_id < c.item_id
WHERE len(a.w) + len(c.w) > 0 AND round(2.0 * len(list_intersect(a.w, c.w)) / (len(a.w) + len(c.w)), 6) >= 0.3""")
def dice_similarity_pairs(t: Tables) -> DataFrame:
    """D10 by prefix filtering; all pairs of items that reach 0.3."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 1))
    b = t.benchmark.select("item_id", words.alias("tokens"))
    return linkage.dice_pairs(b, b.withColumnRenamed("item_id", "other_id"), "item_id", "other_id", 0.3).where("item_id < other_id")


@R.add("""WITH RECURSIVE k AS (SELECT page_id AS id, regexp_replace(lower(url), '[?#].*$', '') AS u, md5(html) AS h FROM pages),
e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON (a.u = b.u OR a.h = b.h)),
r AS (SELECT id AS x, id AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS ordinal, min(y) AS cluster FROM r GROUP BY x""")
def multi_key_resolution(t: Tables) -> DataFrame:
    """D04, components: pages that share an address or their content, directly or through others."""
    rows = t.pages.select("page_id", F.regexp_replace(F.lower("url"), r"[?#].*$", "").alias("u"), F.md5("html").alias("h"))
    return linkage.resolve(rows, ["u", "h"], "page_id")


@R.add("""WITH RECURSIVE k AS (SELECT page_id, 1 AS place, 'u:' || regexp_replace(lower(url), '[?#].*$', '') AS key FROM pages UNION ALL SELECT page_id, 2, 'h:' || md5(html) FROM pages),
p AS (SELECT page_id, arg_min(earlier, place) FILTER (earlier IS NOT NULL) AS parent FROM (SELECT page_id, place, lag(page_id) OVER (PARTITION BY key ORDER BY page_id) AS earlier FROM k) GROUP BY page_id),
up AS (SELECT page_id AS ordinal, page_id AS cluster FROM p WHERE parent IS NULL UNION ALL SELECT p.page_id, up.cluster FROM up JOIN p ON p.parent = up.ordinal)
SELECT ordinal, cluster FROM up""")
def ordered_resolution(t: Tables) -> DataFrame:
    """D04, in order of arrival."""
    rows = t.pages.select("page_id", F.regexp_replace(F.lower("url"), r"[?#].*$", "").alias("u"), F.md5("html").alias("h"))
    return linkage.resolve(rows, ["u", "h"], "page_id", mode="ordered")


@R.add("""SELECT source, arg_max(text, (length(trim(text)), -doc_id)) AS longest, string_agg(DISTINCT lang, '; ' ORDER BY lang) AS langs, arg_min(lang, doc_id) AS first_lang FROM documents GROUP BY source""")
def survivorship(t: Tables) -> DataFrame:
    """D05."""
    s = linkage.survivors(t.documents.withColumn("langs", F.col("lang")).withColumn("first_lang", F.col("lang")).withColumn("longest", F.col("text")), "source", "doc_id", longest=["longest"], first=["first_lang"], joined=["langs"])
    return s.select("source", "longest", "langs", "first_lang")


@R.add("""SELECT key, titles FROM (SELECT 'url:' || regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS key, count(DISTINCT html) AS titles FROM pages GROUP BY 1) WHERE titles > 1""")
def url_canonical(t: Tables) -> DataFrame:
    """Addresses whose pages differ."""
    p = t.pages.withColumns({"doi": F.lit(None).cast("string"), "pmid": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "score": F.lit(0)})
    return linkage.conflicts(p, linkage.first_key("doi", "pmid", "title", "url"), "score", "html")


@R.add("""SELECT user_id, arg_min(event_type, event_id) FILTER (trim(event_type) <> '') AS event_type, arg_max(props, event_id) FILTER (trim(props) <> '') AS props FROM events GROUP BY user_id""")
def source_priority_merge(t: Tables) -> DataFrame:
    """D07."""
    return linkage.priority_merge(t.events, "user_id", "event_id", ["event_type", "props"], last=["props"])


@R.add("""WITH need AS (SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal >= 5000), have AS (SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal >= 9500) SELECT nationkey, 'missing' AS problem FROM (FROM need EXCEPT FROM have) UNION ALL SELECT nationkey, 'unexpected' FROM (FROM have EXCEPT FROM need)""")
def set_coverage(t: Tables) -> DataFrame:
    """D09."""
    return linkage.coverage(t.supplier.where("s_acctbal >= 5000").select(F.col("s_nationkey").alias("nationkey")), t.customer.where("c_acctbal >= 9500").select(F.col("c_nationkey").alias("nationkey")), "nationkey")


@R.add("SELECT o_orderkey, round(CASE WHEN abs(y - 1995) = 0 THEN 0.15 ELSE greatest(0.0, 0.1 - 0.03 * abs(y - 1995)) END, 4) AS bonus FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def year_bonus(t: Tables) -> DataFrame:
    """D12."""
    return t.orders.select("o_orderkey", F.round(linkage.year_bonus(F.year("o_orderdate"), F.lit(1995)), 4).alias("bonus"))


@R.add("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x) <> '')) AS n FROM documents")
def sentence_split(t: Tables) -> DataFrame:
    """T12."""
    return t.documents.select("doc_id", F.size(tx.sentences("text")).cast("long").alias("n"))


@R.add("SELECT doc_id, regexp_extract(text, '-?\\d+(\\.\\d+)?') AS number, len(regexp_extract_all(text, '\\d+')) AS n FROM documents WHERE regexp_matches(text, '\\d')")
def numbers_in_text(t: Tables) -> DataFrame:
    """Numbers in texts, as T28 and T39 read them."""
    return t.documents.where(F.col("text").rlike(r"\d")).select("doc_id", F.regexp_extract("text", r"-?\d+(\.\d+)?", 0).alias("number"), F.size(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))).cast("long").alias("n"))


@R.add("""SELECT doc_id, CASE WHEN contains(lower(text), 'apache') THEN 'permissive' WHEN contains(lower(text), 'general public') THEN 'copyleft' WHEN contains(lower(text), 'cc by') THEN 'attribution' ELSE 'none' END AS label FROM documents""")
def first_match_label(t: Tables) -> DataFrame:
    """T26, T31."""
    return t.documents.select("doc_id", tx.first_label("text", [("apache", "permissive"), ("general public", "copyleft"), ("cc by", "attribution")], "none").alias("label"))


@R.add("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)[a-z]+@[a-z]+|@mail') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'table' END) AS tags FROM documents""")
def domain_tags(t: Tables) -> DataFrame:
    """T33, T34."""
    return t.documents.select("doc_id", F.array_join(tx.all_labels("text", [("licen[sc]e", "licence"), ("[a-z]+@[a-z]+|@mail", "mail"), (r"\|", "table")]), ",").alias("tags"))


@R.add("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(t: Tables) -> DataFrame:
    """T03."""
    return t.part.select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@R.add("SELECT c_custkey, 'CUS-' || upper(substr(sha256(c_name), 1, 12)) AS short_id, concat_ws('::', 'TPC', nullif(trim(c_name), ''), CAST(c_nationkey AS VARCHAR)) AS joined_id FROM customer")
def deterministic_ids(t: Tables) -> DataFrame:
    """T06, K06."""
    return t.customer.select("c_custkey", tx.short_id("CUS-", "c_name").alias("short_id"), tx.joined_id(F.lit("TPC"), "c_name", "c_nationkey").alias("joined_id"))


@R.add("SELECT r_regionkey, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS hash FROM region")
def canonical_json(t: Tables) -> DataFrame:
    """T07."""
    return t.region.select("r_regionkey", tx.canonical_hash("r_regionkey", "r_name").alias("hash"))


@R.add("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_strip(t: Tables) -> DataFrame:
    """S18, T37."""
    return t.pages.select("page_id", tx.strip_markup("html").alias("text"))


@R.add(f"""SELECT p_partkey, CAST(score AS BIGINT) AS score FROM (SELECT p_partkey, list_sum(list_transform(['part', 'promo', '1'], lambda q: CASE WHEN starts_with(l, q) THEN 12 ELSE 0 END + CASE WHEN contains(h, q) THEN 4 ELSE 0 END + CASE WHEN list_contains(w, q) THEN 6 ELSE 0 END)) AS score
FROM (SELECT p_partkey, lower(p_name) AS l, lower(p_name || ' ' || p_type) AS h, {WORDS.format(c="p_name || ' ' || p_type")} AS w FROM part)) WHERE score > 0""")
def token_search_rank(t: Tables) -> DataFrame:
    """T04, M17."""
    both = F.concat_ws(" ", "p_name", "p_type")
    score = scoring.index_score(F.col("p_name"), F.lower(both), tx.tokens(both), F.array(F.lit("part"), F.lit("promo"), F.lit("1")), F.lit(False), F.lit(False))
    return t.part.select("p_partkey", score.cast("long").alias("score")).where("score > 0")


@R.add("""SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'widget') THEN 55 WHEN contains(lower(p_name), 'widget') THEN 34 ELSE 16 END + CASE WHEN lower(p_name) = 'widget' THEN 180 WHEN starts_with(lower(p_name), 'widget') THEN 30 ELSE 0 END + least(p_size, 200) / 20 AS score FROM part WHERE contains(lower(p_name || ' ' || p_type), 'widget')""")
def browser_search(t: Tables) -> DataFrame:
    """M18."""
    score = scoring.browser_score(F.col("p_name"), F.lower(F.concat_ws(" ", "p_name", "p_type")), F.array(F.lit("widget")), F.lit("widget"), F.lit(False), F.col("p_size"))
    return t.part.select("p_partkey", score.alias("score")).where("score IS NOT NULL")


#: Folded text in DuckDB, as T02 folds it.
FOLDED = "trim(regexp_replace(lower(translate(regexp_replace({c}, '\\p{{M}}+', '', 'g'), '" + tx.ACCENTED + "', '" + tx.PLAIN + "')), '\\s+', ' ', 'g'))"
CONCEPTS = f"""d AS (SELECT doc_id, lang, source, n_chars, {FOLDED.format(c="substring(text, 1, 60)")} AS l, {FOLDED.format(c="text")} AS h, list_filter(regexp_extract_all(h, '[a-z0-9]+'), lambda x: length(x) > 1) AS w0 FROM documents)"""
ASKED = f"""q AS (SELECT item_id, {FOLDED.format(c="array_to_string(list_slice(string_split(text, ' '), 1, {n}), ' ')")} AS p, list_distinct(list_filter(regexp_extract_all(p, '[a-z0-9]+'), lambda x: length(x) > 1)) AS ts FROM benchmark)"""


def _concepts(t: Tables, extra) -> impacts.Index:
    rows = t.documents.select("doc_id", F.substring("text", 1, 60).alias("label"), "text", extra.alias("extra"))
    return impacts.write_index(rows, "doc_id", "label", "text", F.col("extra"))


def _first_words(t: Tables, n: int) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, n), " ").alias("text"))


@R.add(f"""WITH {CONCEPTS}, {ASKED.replace("{n}", "4")},
w AS (SELECT doc_id, list(x ORDER BY i) AS w FROM (SELECT doc_id, x, min(i) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM (SELECT doc_id, unnest(w0) AS x, generate_subscripts(w0, 1) AS i FROM d) GROUP BY doc_id, x) WHERE n <= 48 GROUP BY doc_id),
s AS (SELECT item_id, d.doc_id AS key, list_sum(list_transform(ts, lambda t: CASE WHEN starts_with(l, t) THEN 12 ELSE 0 END + CASE WHEN contains(h, t) THEN 4 ELSE 0 END + CASE WHEN coalesce(list_contains(w, t), FALSE) THEN 6 ELSE 0 END)) AS base,
CASE WHEN lang = 'en' THEN 6.0 ELSE 0 END - CASE WHEN source = 'src0' THEN 8 ELSE 0 END AS extra FROM q, d LEFT JOIN w USING (doc_id))
SELECT item_id, rank, key, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM (SELECT item_id, key, greatest(base + extra, 1.0) AS score FROM s WHERE base > 0)) WHERE rank <= 10""")
def index_search(t: Tables) -> DataFrame:
    """The ten best documents for the first words of each item, by the index."""
    extra = F.when(F.col("lang") == "en", 6.0).otherwise(0.0) - F.when(F.col("source") == "src0", 8).otherwise(0)
    return impacts.search(_concepts(t, extra), _first_words(t, 4), "item_id", "text", 10)[0]


@R.add(f"""WITH {CONCEPTS}, {ASKED.replace("{n}", "2")},
s AS (SELECT item_id, doc_id AS key, list_sum(list_transform(ts, lambda t: CASE WHEN starts_with(l, t) THEN 55 WHEN contains(l, t) THEN 34 ELSE 16 END)) + CASE WHEN l = p THEN 180 WHEN starts_with(l, p) THEN 30 ELSE 0 END + least(n_chars, 200) / 20 AS score
FROM q, d WHERE len(ts) > 0 AND len(list_filter(ts, lambda t: NOT contains(h, t))) = 0)
SELECT item_id, rank, key, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def index_browser(t: Tables) -> DataFrame:
    """The ten best documents that hold both first words of an item, by the index."""
    extra = F.least(F.col("n_chars"), F.lit(200)) / 20
    return impacts.search(_concepts(t, extra), _first_words(t, 2), "item_id", "text", 10, impacts.BROWSER_SEARCH)[0]


@R.add("""SELECT o_orderkey, score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'moderate' ELSE 'emerging' END AS label FROM (SELECT o_orderkey, least(greatest(round(0.45 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.35 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 0.1 ELSE 0 END - CASE WHEN o_orderstatus = 'P' THEN 0.1 ELSE 0 END, 2), 0.05), 1.0) AS score FROM orders)""")
def weighted_score(t: Tables) -> DataFrame:
    """Additive rules, clamped, with tiers, as M01 and M02 use them."""
    rules = [(F.col("o_orderpriority") == "1-URGENT", 0.35, "urgent"), (F.col("o_totalprice") > 200000, 0.1, "large"), (F.col("o_orderstatus") == "P", -0.1, "pending")]
    s = t.orders.select("o_orderkey", scoring.additive(0.45, rules, 2, 0.05, 1.0).alias("s"))
    return s.select("o_orderkey", F.col("s.score").alias("score"), scoring.tier(F.col("s.score"), scoring.WEIGHT_TIERS, "emerging").alias("label"))


@R.add("SELECT o_orderkey, CAST(CASE WHEN 2000 - year(o_orderdate) >= 10 THEN 0.25 WHEN 2000 - year(o_orderdate) >= 6 THEN 0.12 ELSE 0 END AS DOUBLE) AS penalty FROM orders")
def age_penalty(t: Tables) -> DataFrame:
    """M08."""
    return t.orders.select("o_orderkey", scoring.age_penalty(F.col("o_orderdate"), F.lit("2000-01-01").cast("date")).alias("penalty"))


@R.add("""SELECT c_custkey, concat_ws(',', CASE WHEN NOT coalesce(c_acctbal > 0, FALSE) THEN 'balance' END, CASE WHEN NOT coalesce(n > 0, FALSE) THEN 'orders' END) AS blocking, CASE WHEN coalesce(c_acctbal > 0, FALSE) AND coalesce(n > 0, FALSE) THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def gate_blockers(t: Tables) -> DataFrame:
    """M28."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    g = t.customer.join(n, "c_custkey", "left").select("c_custkey", scoring.gates({"balance": F.col("c_acctbal") > 0, "orders": F.col("n") > 0}).alias("g"))
    return g.select("c_custkey", F.array_join("g.blocking", ",").alias("blocking"), F.col("g.verdict").alias("verdict"))


@R.add("SELECT c_mktsegment, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 1) AS completeness, round(avg(c_acctbal), 2) AS mean_balance FROM customer GROUP BY 1")
def completeness_index(t: Tables) -> DataFrame:
    """A19's percentage; its tier is in ``reliability_tiers``."""
    return t.customer.groupBy("c_mktsegment").agg(F.round(100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 1).alias("completeness"), F.round(F.avg("c_acctbal"), 2).alias("mean_balance"))


@R.add("""SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size > 10 THEN 'size' END, CASE WHEN NOT starts_with(p_brand, 'Brand#1') THEN 'brand' END) AS paths FROM part""")
def schema_issues(t: Tables) -> DataFrame:
    """M33."""
    found = scoring.issues({"size": (F.col("p_size") > 10, "too small"), "brand": (F.startswith("p_brand", F.lit("Brand#1")), "another brand")})
    return t.part.select("p_partkey", F.array_join(F.transform(found, lambda i: i["path"]), ",").alias("paths"))


@R.add("""SELECT s_suppkey, least(greatest(91 - 4.0 * (s_suppkey % 5) - 1.5 * (s_suppkey % 3), 60), 95) AS ecs, round(least(0.95, 0.12 + 0.12 * (s_suppkey % 5) + 0.03 * (s_suppkey % 3)), 4) AS uci FROM supplier""")
def translation_scores(t: Tables) -> DataFrame:
    """M23."""
    s = t.supplier.select("s_suppkey", scoring.translation_scores(F.col("s_suppkey") % 5, F.col("s_suppkey") % 3).alias("s"))
    return s.select("s_suppkey", F.col("s.ecs").alias("ecs"), F.round("s.uci", 4).alias("uci"))


#: Moves between the roles of a conversation, and between the kinds of a user's events.
ROLE_MOVES = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
EVENT_MOVES = {"view": ["click", "view"], "click": ["view", "purchase"], "purchase": ["view"], "signup": ["view"], "error": ["view"]}


@R.add("""WITH RECURSIVE t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations),
s AS (SELECT DISTINCT conv_id, CAST(NULL AS BIGINT) AS turn, '' AS role, CAST(0 AS BIGINT) AS n, '' AS from_state, '' AS outcome, 'start' AS state_after FROM t
UNION ALL SELECT conv_id, turn, role, n, from_state, CASE WHEN ok THEN 'moved' ELSE 'refused' END, CASE WHEN ok THEN role ELSE from_state END
FROM (SELECT t.*, s.state_after AS from_state, s.state_after || '>' || t.role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS ok FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1))
SELECT conv_id, turn, role, from_state, outcome, state_after FROM s WHERE n > 0""")
def state_machine_validate(t: Tables) -> DataFrame:
    """The roles of conversations as states; a refused turn leaves the state as it was."""
    return states.replay(t.conversations.select("conv_id", "turn", "role"), "conv_id", ["turn"], "role", "start", ROLE_MOVES)


@R.add("""WITH RECURSIVE t AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 = 1 THEN 'e' || event_id WHEN event_id % 3 = 0 THEN 'k' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 END AS override_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
o AS (SELECT DISTINCT user_id, override_id FROM t WHERE event_id % 2 = 0 AND event_id % 7 > 0 AND override_id IS NOT NULL),
s AS (SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, '' AS event_type, CAST('' AS VARCHAR) AS override_id, CAST(0 AS BIGINT) AS n, '' AS from_state, '' AS outcome, 'view' AS state_after, CAST([] AS VARCHAR[]) AS used FROM t
UNION ALL SELECT user_id, event_id, event_type, override_id, n, from_state, outcome, CASE WHEN outcome IN ('moved', 'overridden') THEN event_type ELSE from_state END, CASE WHEN outcome = 'overridden' THEN list_append(used, override_id) ELSE used END
FROM (SELECT t.*, s.used, s.state_after AS from_state, CASE WHEN s.state_after || '>' || t.event_type IN ('view>click', 'view>view', 'click>view', 'click>purchase', 'purchase>view', 'signup>view', 'error>view') THEN 'moved' WHEN t.override_id IS NULL THEN 'refused'
WHEN o.override_id IS NOT NULL AND NOT list_contains(s.used, t.override_id) THEN 'overridden' ELSE 'invalid-override' END AS outcome
FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1 LEFT JOIN o ON o.user_id = t.user_id AND o.override_id = t.override_id))
SELECT user_id, event_id, event_type, override_id, from_state, outcome, state_after FROM s WHERE n > 0""")
def override_transitions(t: Tables) -> DataFrame:
    """users' events as steps; some name an override of their own, some one that others name too."""
    k = F.get_json_object("props", "$.k").cast("long") % 5
    named = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("e"), "event_id")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), k.cast("string")))
    steps = t.events.select("user_id", "event_id", "event_type", named.alias("override_id"))
    given = steps.where("override_id IS NOT NULL").select("user_id", "override_id", F.when(F.col("event_id") % 2 == 0, "active").otherwise("expired").alias("status"), F.when(F.col("event_id") % 7 > 0, "lead").alias("signed_by"), F.lit("needed").alias("justification"))
    return states.replay(steps, "user_id", ["event_id"], "event_type", "view", EVENT_MOVES, given, "override_id")


@R.add("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, event_id, n, sha256('|' || event_type) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, sha256(c.hash || '|' || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, event_id, hash FROM c""")
def hash_chain(t: Tables) -> DataFrame:
    """W06."""
    return lineage.hash_chain(t.events, "user_id", "event_id", "event_type")


@R.add("""SELECT event_id, hash, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_hash FROM (SELECT *, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS hash FROM events)""")
def integrity_chain(t: Tables) -> DataFrame:
    """W07."""
    return lineage.integrity_chain(t.events, ["user_id"], ["event_id"], ["event_id", "event_type"]).select("event_id", "hash", "previous_hash")


@R.add("""SELECT d.doc_id, coalesce(n, 0) AS n_events, CASE WHEN n IS NULL THEN 'orphan' ELSE 'tracked' END AS status FROM documents d LEFT JOIN (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY 1) USING (doc_id)""")
def audit_report(t: Tables) -> DataFrame:
    """L06, L07."""
    e = t.events.select(F.col("user_id").alias("doc_id"), "ts")
    return lineage.audit_report(t.documents.select("doc_id", "source"), e, "doc_id").select("doc_id", "n_events", "status")


@R.add("""SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 1.0 FROM part WHERE p_partkey % 3 = 0""")
def upsert(t: Tables) -> DataFrame:
    """L05."""
    base = t.part.select("p_partkey", "p_retailprice")
    return lineage.upsert(base, base.where("p_partkey % 3 = 0").withColumn("p_retailprice", F.lit(1.0)), ["p_partkey"])


@R.add("SELECT l_orderkey, l_linenumber, 'L' || lpad(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS VARCHAR), 3, '0') AS item_id, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS depends_on FROM lineitem")
def bill_of_materials(t: Tables) -> DataFrame:
    """L11, L12."""
    p = lineage.positions([t.lineitem.select("l_orderkey", "l_linenumber")], "L", ["l_linenumber"], "l_orderkey")
    return lineage.steps_chain(p, "l_orderkey", "position", "l_linenumber").select("l_orderkey", "l_linenumber", "item_id", "depends_on")


@R.add("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
d AS (SELECT 'r0' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM d JOIN e USING (node)) SELECT node, CAST(depth AS BIGINT) AS depth FROM d""")
def recursive_hierarchy(t: Tables) -> DataFrame:
    """S21, with K01's hierarchy."""
    a = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("node"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    b = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("node"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    roots = t.spark.createDataFrame([("r0",)], "node string")
    return terminology.descendants(a.unionByName(b), roots).select("node", F.col("depth").cast("long").alias("depth"))


@R.add("SELECT 'PART::' || p_partkey AS id, p_type || ': ' || p_name AS label FROM part WHERE contains(lower(p_name), 'widget') ORDER BY id, label LIMIT 50")
def code_search(t: Tables) -> DataFrame:
    """K09."""
    terms = t.part.select(tx.joined_id(F.lit("PART"), "p_partkey").alias("id"), F.concat_ws(": ", "p_type", "p_name").alias("label"), "p_name")
    return terms.where(F.contains(F.lower("p_name"), F.lit("widget"))).orderBy("id", "label").limit(50).select("id", "label")


@R.add("""SELECT 'CUST::' || c_custkey || '::is-a::' || c_nationkey AS id, 'CUST::' || c_custkey AS source_concept_id, 'CUST::' || c_nationkey AS target_concept_id FROM customer""")
def terminology_edges(t: Tables) -> DataFrame:
    """K06, K07."""
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_nationkey").cast("string").alias("parent"))
    return terminology.relationships(rows, "CUST", F.lit("is-a")).select("id", "source_concept_id", "target_concept_id")


@R.add("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 99 END, p_type, p_partkey) = 1 AS is_primary FROM part")
def primary_codes(t: Tables) -> DataFrame:
    """K12."""
    codes = t.part.select("p_brand", F.lit("any").alias("category"), F.col("p_type").alias("system"), F.col("p_partkey").alias("code"))
    return terminology.primary_codes(codes, "p_brand", "category", {"any": ["PROMO", "STANDARD"]}).select("p_brand", F.col("code").alias("p_partkey"), "is_primary")


@R.add("""SELECT item_id, w, list_aggregate(list_transform(p, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS positions FROM (SELECT item_id, w, list(i - 1 ORDER BY i) AS p FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark) GROUP BY 1, 2)""")
def inverted_index(t: Tables) -> DataFrame:
    """T36 (the index that abstracts are read from)."""
    words = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return words.groupBy("item_id", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i.cast("string")), ",").alias("positions"))


@R.add("SELECT item_id, text FROM benchmark")
def abstract_round_trip(t: Tables) -> DataFrame:
    """Abstracts read back from their inverted index."""
    words = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w")).groupBy("item_id", "w").agg(F.collect_list("i").alias("p"))
    maps = words.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("m"))
    return maps.select("item_id", tx.inverted_abstract("m").alias("text"))


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(t: Tables) -> DataFrame:
    """Array and JSON access: the field walk of props."""
    return readers.json_fields(t.events.select("event_id", "props"), "event_id", "props", most=1).where("path = 'k'").select("event_id", F.col("value").cast("long").alias("k"))


@R.add("""SELECT lang, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM documents GROUP BY lang""")
def flat_export(t: Tables) -> DataFrame:
    """S29, A12."""
    return writers.flat(t.documents.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources")))


@R.add("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_feed(t: Tables) -> DataFrame:
    """S24."""
    return writers.feed(t.region.select("r_regionkey", "r_name"))


@R.add("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    """Extension: tumbling windows; the same plan runs on a stream."""
    w = windows.tumbling_counts(t.events, "ts", "event_type")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@R.add("""SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def event_sessions(t: Tables) -> DataFrame:
    """Extension: session windows."""
    return windows.sessions(t.events, "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@R.add("SELECT doc_id, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM (SELECT doc_id, source, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents)")
def line_numbers(t: Tables) -> DataFrame:
    """Lines of each document and the running count in its source."""
    rows = t.documents.select("doc_id", "source", tx.line_of("text", F.length("text")).cast("long").alias("n"))
    return rows.select("doc_id", "n", F.sum("n").over(Window.partitionBy("source").orderBy("doc_id")).alias("running"))
