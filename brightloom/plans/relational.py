"""Queries over filters, joins, rollups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import lexicon, relational as op
from .base import Registry, Tables

R = Registry()
long = lambda c: F.col(c).cast("long").alias(c)


@R.add("""SELECT p_brand, p_type, n, avg_quantity, revenue, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, avg_quantity DESC, p_type) AS rank FROM (
    SELECT p_brand, p_type, count(*) AS n, round(avg(l_quantity), 3) AS avg_quantity, round(sum(l_extendedprice), 2) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE rank <= 3""")
def topk_per_group(t: Tables) -> DataFrame:
    """The three most sold types of each brand."""
    # Lines are summed up by part first, so the join moves one row for each part sold.
    sold = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count("l_quantity").alias("known"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("revenue"))
    mean = F.try_divide(F.sum("quantity"), F.sum("known"))
    sums = sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.sum("n").alias("n"), F.round(mean, 3).alias("avg_quantity"), F.round(F.sum("revenue"), 2).alias("revenue"))
    return op.top_per_group(sums, ["p_brand"], [F.desc("n"), F.desc("avg_quantity"), "p_type"], 3).withColumn("rank", F.col("rank").cast("long"))


@R.add("SELECT p_partkey, p_name FROM part WHERE lower(p_brand) = 'brand#1' AND lower(p_type) = 'promo'")
def equality_filters(t: Tables) -> DataFrame:
    """F01, F03."""
    return op.equals_ignoring_case(t.part, p_brand="BRAND#1", p_type="promo", p_name=None).select("p_partkey", "p_name")


@R.add("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def catalog_search(t: Tables) -> DataFrame:
    """F02."""
    return op.search_columns(t.part, "Ring", ["p_name", "p_type"]).select("p_partkey", "p_name")


@R.add("SELECT p_partkey, (SELECT count(*) FROM part) AS total FROM part ORDER BY lower(p_name), p_partkey LIMIT 25 OFFSET 50")
def offset_page(t: Tables) -> DataFrame:
    """a page is what the operator returns."""
    return op.page(t.part, [F.lower("p_name"), "p_partkey"], 50, 25).select("p_partkey", "total")


@R.add("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def latest_events(t: Tables) -> DataFrame:
    """Top-k."""
    return op.latest(t.events, "ts", 100, "event_id").select("event_id", "user_id")


@R.add("SELECT doc_id, coalesce('label', '') AS source_kind, quality FROM labels UNION ALL SELECT doc_id, 'document', NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fallback_lookup(t: Tables) -> DataFrame:
    """F07."""
    a = t.labels.select("doc_id", F.lit("label").alias("source_kind"), "quality")
    return op.first_source([a, t.documents.select("doc_id", F.lit("document").alias("source_kind"))], "doc_id").select("doc_id", "source_kind", "quality")


@R.add("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_contains(list(o_orderpriority), '1-URGENT'))")
def array_member(t: Tables) -> DataFrame:
    """F08, L08, J11."""
    sets = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("p"))
    return op.with_matching(t.customer, op.having_member(sets, "p", "1-URGENT"), "c_custkey").select("c_custkey")


@R.add("SELECT event_id FROM events WHERE event_type = 'error' OR (event_type = 'click' AND value >= 50)")
def allowed_rows(t: Tables) -> DataFrame:
    """F10, F15, F16."""
    return t.events.where(op.allowed(F.col("event_type") == "error", (F.col("event_type") == "click") & op.at_least("value", 50))).select("event_id")


@R.add("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 AND lang IN ('en', 'de')")
def post_join_filter(t: Tables) -> DataFrame:
    """A null-rejecting filter turns the left join into an inner one."""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").where((F.col("quality") == 1) & F.col("lang").isin("en", "de")).select("doc_id", "lang")


@R.add("SELECT n_nationkey, n_name, coalesce(r_name, '') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def left_lookup(t: Tables) -> DataFrame:
    """A lookup with a fallback."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("")).alias("region"))


@R.add("SELECT n_name, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def left_join_rollup(t: Tables) -> DataFrame:
    """J03, A16."""
    j = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("n_name").agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@R.add("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")
def composite_join(t: Tables) -> DataFrame:
    """J04."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"), "o_orderstatus")
    return t.lineitem.join(o, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey < 3) AND o_orderstatus = 'F'")
def semi_topics(t: Tables) -> DataFrame:
    """J05."""
    topics = t.orders.where("o_orderkey < 3").select("o_orderpriority").distinct()
    return op.with_matching(t.orders.where("o_orderstatus = 'F'"), topics, "o_orderpriority").select("o_orderkey")


@R.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_required(t: Tables) -> DataFrame:
    """J07, J12."""
    return op.without_matching(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@R.add("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'offer' WHEN lower(p_type) LIKE '%ec%' THEN 'economy' WHEN lower(p_type) LIKE '%s%' THEN 'other' END AS label FROM part""")
def contains_first_match(t: Tables) -> DataFrame:
    """J08."""
    return op.first_contained(t.part, "p_type", [("promo", "offer"), ("ec", "economy"), ("s", "other")]).select("p_partkey", "label")


@R.add("""SELECT p_partkey, concat_ws(',', CASE WHEN contains(lower(p_type), 'promo') OR contains('promo', lower(p_type)) THEN 'promo' END, CASE WHEN contains(lower(p_type), 'standard') OR contains('standard', lower(p_type)) THEN 'standard' END) AS matches FROM part""")
def contains_both_ways(t: Tables) -> DataFrame:
    """J09."""
    return op.contained_either_way(t.part, "p_type", ["promo", "standard"]).select("p_partkey", F.array_join("matches", ",").alias("matches"))


#: Passages of the benchmark before its longer words, as a lexicon table.
LEXICON = """SELECT word, arg_min(label, place) AS label, min(place) AS place FROM (SELECT lower(text) AS word, 'passage ' || item_id AS label, item_id AS place FROM benchmark
UNION ALL SELECT word, 'word ' || word, 1000000 + min(item_id) FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark) WHERE length(word) >= 8 GROUP BY word) GROUP BY word"""


def benchmark_words(t: Tables, least: int) -> DataFrame:
    words = t.benchmark.select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.min("item_id").alias("item_id"))


@R.add(f"""SELECT doc_id, arg_min(label, (place, word)) AS label FROM documents LEFT JOIN ({LEXICON}) ON contains(lower(text), word) GROUP BY doc_id""")
def lexicon_first_match(t: Tables) -> DataFrame:
    """J08, with a lexicon that is a table: whole documents against passages and words."""
    passages = t.benchmark.select(F.lower("text").alias("word"), F.concat(F.lit("passage "), "item_id").alias("label"), F.col("item_id").alias("place"))
    words = benchmark_words(t, 8).select("word", F.concat(F.lit("word "), "word").alias("label"), (F.col("item_id") + 1000000).alias("place"))
    return lexicon.first_contained(t.documents.select("doc_id", "text"), "text", passages.unionByName(words)).select("doc_id", "label")


@R.add("""SELECT DISTINCT text, word FROM (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS text FROM conversations), (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark)
WHERE length(word) >= 4 AND (contains(text, word) OR contains(word, text))""")
def lexicon_both_ways(t: Tables) -> DataFrame:
    """J09, with a lexicon that is a table: first words of turns against words of the benchmark."""
    first = t.conversations.select(F.lower(F.get(F.split("text", " "), F.lit(0))).alias("text")).distinct()
    return lexicon.contained_either_way(first.withColumn("t", F.col("text")), "text", "t", benchmark_words(t, 4))


@R.add("""SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY c_custkey""")
def multi_hop(t: Tables) -> DataFrame:
    """J10, A26."""
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    counted = orders.groupBy("c_custkey").agg(F.count("*").alias("orders"))
    # One distinct over (customer, part) serves the count and the brands; no row is expanded.
    parts = orders.join(t.lineitem, "l_orderkey").select("c_custkey", F.col("l_partkey").alias("p_partkey")).distinct()
    brands = parts.join(t.part, "p_partkey", "left").groupBy("c_custkey").agg(F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))
    zero = F.lit(0)
    return t.customer.select("c_custkey").join(counted, "c_custkey", "left").join(brands, "c_custkey", "left").select("c_custkey", F.coalesce("orders", zero).alias("orders"), F.coalesce("parts", zero).alias("parts"), "brands")


@R.add("""SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS name, CASE WHEN s_suppkey IS NULL THEN 'customer' WHEN c_custkey IS NULL THEN 'supplier' ELSE 'both' END AS side
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def full_outer_overlay(t: Tables) -> DataFrame:
    """J13."""
    s, c = t.supplier, t.customer
    side = F.when(F.col("s_suppkey").isNull(), "customer").when(F.col("c_custkey").isNull(), "supplier").otherwise("both")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "full").select(F.coalesce("s_suppkey", "c_custkey").alias("key"), F.coalesce("s_name", "c_name").alias("name"), side.alias("side"))


@R.add("""SELECT o_orderkey, (SELECT count(*) FROM orders b WHERE b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus <> a.o_orderstatus) AS n_differing FROM orders a""")
def differing_in_group(t: Tables) -> DataFrame:
    """J15 as counts."""
    return op.differing_within(t.orders, "o_orderpriority", "o_orderstatus", "o_orderkey").select("o_orderkey", "n_differing")


@R.add("""SELECT event_type, string_agg(k, ',' ORDER BY r) AS kinds FROM (SELECT event_type, u || ':' || n AS k, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, u) AS r
FROM (SELECT event_type, CAST(user_id % 7 AS VARCHAR) AS u, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 4 GROUP BY event_type""")
def type_histogram_top4(t: Tables) -> DataFrame:
    """A02."""
    return op.top_kinds(t.events.withColumn("u", (F.col("user_id") % 7).cast("string")), ["event_type"], "u")


@R.add("""SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS positive, count(*) FILTER (event_type LIKE '%error%') AS negative,
CASE WHEN count(*) FILTER (event_type IN ('purchase', 'signup')) > 0 AND count(*) FILTER (event_type LIKE '%error%') = 0 THEN 'supportive' WHEN count(*) FILTER (event_type LIKE '%error%') > 0 AND count(*) FILTER (event_type IN ('purchase', 'signup')) = 0 THEN 'restrictive' ELSE 'mixed' END AS stance
FROM events GROUP BY user_id""")
def conditional_counts(t: Tables) -> DataFrame:
    """A03, A15, M04."""
    from ..functions import scoring

    c = op.conditional_counts(t.events, ["user_id"], positive=F.col("event_type").isin("purchase", "signup"), negative=F.col("event_type").like("%error%"))
    return c.withColumn("stance", scoring.stance(F.col("positive"), F.col("negative")))


@R.add("SELECT coalesce(c_mktsegment, 'unknown') AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def count_by_field(t: Tables) -> DataFrame:
    """A04, A06, A25."""
    return op.count_by(t.customer, "c_mktsegment")


@R.add("SELECT count(*) AS n FROM lineitem")
def count_all(t: Tables) -> DataFrame:
    """A05."""
    return t.lineitem.agg(F.count("*").alias("n"))


@R.add("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2""")
def facet_profile(t: Tables) -> DataFrame:
    """A07."""
    return op.facet_counts(t.part, ["p_brand", "p_type", "p_size"])


@R.add("""SELECT lower(p_brand) AS key, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, CAST(max(p_size) AS BIGINT) AS priority, count(*) AS n,
CASE WHEN count(*) FILTER (p_type = 'PROMO') > 0 THEN 'PROMO' ELSE min(p_type) END AS dominant FROM part GROUP BY 1""")
def rollup_sets(t: Tables) -> DataFrame:
    """A08, A09, A10, A11."""
    r = op.browser_rollup(t.part, F.lower("p_brand"), {"types": "p_type"}, "p_size")
    return r.select("key", F.array_join("types", ",").alias("types"), long("priority"), "n", op.dominant(F.col("types"), ["PROMO"]).alias("dominant"))


@R.add("""SELECT p_type, n, CAST(greatest(6, round(100.0 * n / max(n) OVER ())) AS BIGINT) AS width FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 8)""")
def bar_widths(t: Tables) -> DataFrame:
    """A13."""
    return op.bars(t.part, "p_type").select("p_type", "n", long("width"))


@R.add("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(t: Tables) -> DataFrame:
    """A14."""
    return op.duplicates(t.documents, ["text"])


@R.add("SELECT v AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) s(v)")
def zero_filled_status(t: Tables) -> DataFrame:
    """A22."""
    return op.zero_filled(t.orders, "o_orderstatus", ["O", "F", "P", "X"])


@R.add("""WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY 1)
SELECT doc, line, count(DISTINCT page) AS on_pages FROM l JOIN p USING (doc) GROUP BY doc, line, pages HAVING count(DISTINCT page) >= CASE WHEN pages >= 6 THEN greatest(3, pages // 6) ELSE 99 END""")
def repeated_lines(t: Tables) -> DataFrame:
    """Lines on many documents of a source."""
    lines = t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return op.repeated_lines(lines)


@R.add("SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR) || sha256(text), '' ORDER BY CAST(doc_id AS VARCHAR) || sha256(text))) AS digest FROM documents GROUP BY source")
def file_set_digest(t: Tables) -> DataFrame:
    """A24, S26."""
    return op.set_digest(t.documents.select("source", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha")), ["source"], "name", "sha")


@R.add("""SELECT o_orderpriority, place, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (
SELECT *, first_value(o_orderstatus) OVER w AS f, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)) WHERE r = 1 OR o_orderstatus <> f) WHERE place <= 4""")
def stance_conflict(t: Tables) -> DataFrame:
    """The preferred order of a priority and the next that differ."""
    return op.preferred_and_others(t.orders, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], "o_orderstatus").select("o_orderpriority", long("place"), "o_orderkey", "o_orderstatus")


@R.add("""SELECT o_orderkey, row_number() OVER w AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def latest_version_lineage(t: Tables) -> DataFrame:
    """W03, W04, W05, W14."""
    return op.versions(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", long("version"), "previous")


@R.add("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value >= 25) WHERE r = 1")
def best_candidate(t: Tables) -> DataFrame:
    """W11."""
    return op.best_candidate(t.events, "user_id", "value", "event_id", 25).select("user_id", "event_id")


@R.add("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_case(t: Tables) -> DataFrame:
    """W14, L05."""
    return op.latest_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@R.add("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END DESC, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 200""")
def priority_order(t: Tables) -> DataFrame:
    """A top-k report."""
    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    top = t.orders.orderBy(weight.desc(), F.desc("o_totalprice"), "o_orderkey").limit(200)
    from pyspark.sql import Window

    return top.select("o_orderkey", F.row_number().over(Window.orderBy(weight.desc(), F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@R.add("SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(*) AS n FROM (SELECT c_nationkey, NULL AS s_nationkey FROM customer UNION ALL SELECT NULL, s_nationkey FROM supplier) GROUP BY 1")
def union_by_name(t: Tables) -> DataFrame:
    """D01."""
    both = t.customer.select("c_nationkey").unionByName(t.supplier.select("s_nationkey"), allowMissingColumns=True)
    return both.groupBy(F.coalesce("c_nationkey", "s_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@R.add("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    """D02, D14."""
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()
