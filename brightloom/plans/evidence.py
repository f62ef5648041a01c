"""Queries over evidence rules, merges, reviews and derived records, on the driver tables.

Orders and suppliers stand in for records: their columns give each rule's inputs, so that every branch
is taken and DuckDB can say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scoring as sc, text as tx
from ..operators import lineage, linkage, relational as op
from .base import Registry, Tables

R = Registry()


@R.add("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END, p_name) AS name FROM part")
def coalesce_update(t: Tables) -> DataFrame:
    """new values where there are any."""
    new = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"))
    return op.overlay(t.part.select("p_partkey", "p_name"), new, "p_partkey").select("p_partkey", F.col("p_name").alias("name"))


@R.add("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 AND event_type = 'view'")
def nested_flag(t: Tables) -> DataFrame:
    """a filter on a nested field."""
    return t.events.where((F.get_json_object("props", "$.k").cast("long") > 90) & (F.col("event_type") == "view")).select("event_id")


@R.add("SELECT event_id, profile FROM events JOIN (VALUES ('error', 'bleeding'), ('error', 'stroke'), ('purchase', 'none')) p(event_type, profile) USING (event_type)")
def trigger_profiles(t: Tables) -> DataFrame:
    """A small literal table, one trigger to several profiles."""
    p = t.spark.createDataFrame([("error", "bleeding"), ("error", "stroke"), ("purchase", "none")], "event_type string, profile string")
    return t.events.join(F.broadcast(p), "event_type").select("event_id", "profile")  # three rows


@R.add("SELECT o_orderkey, 'C' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS mapped FROM orders")
def id_map(t: Tables) -> DataFrame:
    """One map for all rows."""
    ids = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("mapped"))
    return t.orders.join(ids, "o_custkey").select("o_orderkey", "mapped")


@R.add("""SELECT p_brand, list_aggregate(list_slice(list_sort(list(DISTINCT p_type)), 1, 3), 'string_agg', ',') AS aliases, CASE max(CASE p_type WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 2 ELSE 1 END) WHEN 3 THEN 'ready' WHEN 2 THEN 'candidate' ELSE 'draft' END AS status FROM part GROUP BY 1""")
def keyed_merge(t: Tables) -> DataFrame:
    """A10: capped aliases and a status that only rises."""
    rank = F.when(F.col("p_type") == "PROMO", 3).when(F.col("p_type") == "STANDARD", 2).otherwise(1)
    g = t.part.groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 3), ",").alias("aliases"), F.max(rank).alias("r"))
    return g.select("p_brand", "aliases", F.when(F.col("r") == 3, "ready").when(F.col("r") == 2, "candidate").otherwise("draft").alias("status"))


@R.add("""SELECT bucket, count(*) AS n FROM (SELECT unnest(['lang:' || lang, 'source:' || source]) AS bucket FROM documents) GROUP BY 1""")
def bucket_rows(t: Tables) -> DataFrame:
    """Rows once for each of their buckets."""
    return t.documents.select(F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@R.add("""SELECT user_id, round(least(sum(CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.6 WHEN 'click' THEN 0.3 ELSE 0.1 END) / greatest(count(*), 1), 1.0), 4) AS severity, bool_or(event_type = 'error') AS critical, coalesce(max(CASE WHEN event_type = 'error' THEN 4 END), 0) AS max_severity FROM events GROUP BY 1""")
def severity_mean(t: Tables) -> DataFrame:
    """A18, A21."""
    w = sc.lookup(F.col("event_type"), {"error": 1.0, "purchase": 0.6, "click": 0.3}, 0.1)
    return t.events.groupBy("user_id").agg(F.round(F.least(F.sum(w) / F.greatest(F.count("*"), F.lit(1)), F.lit(1.0)), 4).alias("severity"), F.bool_or(F.col("event_type") == "error").alias("critical"), F.coalesce(F.max(F.when(F.col("event_type") == "error", 4)), F.lit(0)).alias("max_severity"))


@R.add("""SELECT o_custkey, CAST(sum(len(a)) AS BIGINT) AS n, list_aggregate(list_sort(list_distinct(flatten(list(a)))), 'string_agg', ',') AS everything FROM (SELECT o_custkey, [o_orderstatus, o_orderpriority] AS a FROM orders) GROUP BY 1""")
def array_sums(t: Tables) -> DataFrame:
    """A27."""
    a = t.orders.select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("a"))
    return a.groupBy("o_custkey").agg(F.sum(F.size("a")).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))), ",").alias("everything"))


@R.add("""SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def capped_sources(t: Tables) -> DataFrame:
    """The first of each source, then the first of all; a report's limits."""
    return op.top_per_group(t.part, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 10).orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey")


@R.add("""SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT item_id, w, min(i) AS i, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS r FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark) GROUP BY item_id, w) WHERE r <= 5 GROUP BY item_id""")
def ordered_distinct(t: Tables) -> DataFrame:
    """Distinct words in order, at most five."""
    return t.benchmark.select("item_id", F.array_join(F.slice(F.array_distinct(F.split("text", " ")), 1, 5), " ").alias("words"))


@R.add("""SELECT o_orderkey, round(-0.4 * ((CASE WHEN contains(t, 'correction') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'reply') THEN 1 ELSE 0 END)), 4) AS penalty FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'correction and reply' WHEN 'P' THEN 'a reply' ELSE 'article' END AS t FROM orders)""")
def erratum_penalty(t: Tables) -> DataFrame:
    """D11."""
    title = F.when(F.col("o_orderstatus") == "F", "Correction and Reply").when(F.col("o_orderstatus") == "P", "A Reply").otherwise("Article")
    return t.orders.select("o_orderkey", F.round(linkage.erratum_penalty(title), 4).alias("penalty"))


@R.add("""SELECT doc_id, trim(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?;])\\s+', '\\1' || chr(30), 'g'), chr(30))[1]) AS first_sentence FROM documents WHERE trim(text) <> ''""")
def first_sentence(t: Tables) -> DataFrame:
    """The first sentence of each text."""
    return t.documents.where(F.trim("text") != "").select("doc_id", F.get(tx.sentences(tx.collapse("text")), F.lit(0)).alias("first_sentence"))


@R.add("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '2A' WHEN '3-MEDIUM' THEN '3: HARM' END AS cor, CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B-NR' END AS loe FROM orders""")
def grade_tokens(t: Tables) -> DataFrame:
    """Raw tokens to classes and levels."""
    raw_cor = F.when(F.col("o_orderpriority") == "1-URGENT", " Class  I.").when(F.col("o_orderpriority") == "2-HIGH", "COR IIa").when(F.col("o_orderpriority") == "3-MEDIUM", "III: harm").otherwise("IV")
    raw_loe = F.when(F.col("o_orderstatus") == "O", "Level of Evidence A").when(F.col("o_orderstatus") == "F", "loe b - nr").otherwise("Z")
    return t.orders.select("o_orderkey", tx.recommendation_class(raw_cor).alias("cor"), tx.evidence_level(raw_loe).alias("loe"))


@R.add("""SELECT p_partkey, '10.1000/' || lower(p_brand) AS doi, 1900 + p_partkey % 100 AS year FROM part""")
def identifiers(t: Tables) -> DataFrame:
    """T35."""
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, " https://doi.org/10.1000/").otherwise("DOI: 10.1000/"), "p_brand")
    return t.part.select("p_partkey", tx.doi(raw).alias("doi"), tx.year_in(F.concat(F.lit("p. 12, "), (1900 + F.col("p_partkey") % 100).cast("string"))).cast("long").alias("year"))


@R.add("""SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS k FROM events""")
def measurements(t: Tables) -> DataFrame:
    """The number after a name."""
    return t.events.select("event_id", tx.measurement(F.translate("props", '{}"', "   "), "k").alias("k"))


@R.add("""SELECT p_partkey, p_brand || '. (' || (1990 + p_size) || '). ' || p_name || '.' AS citation, 'V' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS version FROM part""")
def citations(t: Tables) -> DataFrame:
    """T42, T43, T46, T51."""
    c = tx.citation("p_brand", F.lit(1990) + F.col("p_size"), tx.first_filled(F.lit(" "), "p_name"), F.lit(""))
    return t.part.select("p_partkey", c.alias("citation"), tx.version_id("V", F.col("p_size")).alias("version"))


@R.add("""WITH r AS (SELECT s_suppkey, ['benefit', 'mixed', 'harm'][s_suppkey % 3 + 1] AS direction, ['highest', 'moderate', 'low', 'high'][s_suppkey % 4 + 1] AS strength, ['high', 'low', 'very-high', 'unknown', 'moderate'][s_suppkey % 5 + 1] AS certainty, ['guideline', 'rct', 'registry'][s_suppkey % 3 + 1] AS kind, CAST((s_suppkey % 7) / 7.0 AS DOUBLE) AS app, [0.0, 0.12, 0.25][s_suppkey % 3 + 1] AS pen, s_suppkey % 2 = 0 AS approved FROM supplier),
c AS (SELECT *, round(least(greatest(0.40::DOUBLE * CASE certainty WHEN 'very-high' THEN 1 WHEN 'high' THEN 0.85 WHEN 'moderate' THEN 0.65 WHEN 'low' THEN 0.45 WHEN 'very-low' THEN 0.25 ELSE 0.15 END + 0.35::DOUBLE * CASE strength WHEN 'highest' THEN 1 WHEN 'high' THEN 0.85 WHEN 'moderate' THEN 0.65 WHEN 'low' THEN 0.45 WHEN 'very-low' THEN 0.25 ELSE 0.15 END + 0.15::DOUBLE * app + CASE kind WHEN 'guideline' THEN 0.12 WHEN 'rct' THEN 0.04 ELSE 0 END - pen, 0), 1), 2) AS conf FROM r),
m AS (SELECT *, direction IN ('mixed', 'inconclusive') OR pen >= 0.25 OR conf < 0.5 OR certainty IN ('insufficient', 'unknown') AS critical, app < 0.45 OR (pen >= 0.12 AND pen < 0.25) AS warning FROM c),
k AS (SELECT *, CASE WHEN critical THEN 'indeterminate' WHEN app < 0.45 THEN 'not-applicable' WHEN NOT warning AND app >= 0.75 THEN 'applicable' ELSE 'conditional' END AS klass, round(1 - conf, 2) AS uci FROM m)
SELECT s_suppkey, conf, klass, CASE WHEN l = 'I' AND NOT approved THEN 'II' ELSE l END AS level, CASE WHEN critical OR NOT approved THEN 'defer_to_review' WHEN direction = 'benefit' AND strength IN ('highest', 'high') THEN 'recommend' WHEN direction = 'benefit' THEN 'consider' WHEN direction = 'harm' THEN 'avoid' ELSE 'defer_to_review' END AS verb
FROM (SELECT *, CASE WHEN critical OR klass = 'indeterminate' OR 100 * conf < 50 OR uci > 0.6 THEN 'IV' WHEN warning OR klass = 'conditional' OR 100 * conf < 65 OR uci > 0.4 THEN 'III' WHEN klass = 'applicable' AND 100 * conf >= 80 AND uci <= 0.25 THEN 'I' ELSE 'II' END AS l FROM k)""")
def evidence_decisions(t: Tables) -> DataFrame:
    """Confidence to decision."""
    def pick(values: list, n: int):
        return F.get(F.array(*map(F.lit, values)), (F.col("s_suppkey") % n).cast("int"))

    r = t.supplier.select("s_suppkey", pick(["benefit", "mixed", "harm"], 3).alias("direction"), pick(["highest", "moderate", "low", "high"], 4).alias("strength"), pick(["high", "low", "very-high", "unknown", "moderate"], 5).alias("certainty"), pick(["guideline", "rct", "registry"], 3).alias("kind"), ((F.col("s_suppkey") % 7) / F.lit(7.0)).alias("app"), pick([0.0, 0.12, 0.25], 3).alias("pen"), (F.col("s_suppkey") % 2 == 0).alias("approved"))
    r = r.withColumn("conf", sc.evidence_confidence(F.col("certainty"), F.col("strength"), F.col("app"), F.col("kind"), F.col("pen")))
    r = r.withColumn("m", sc.conflict_markers(F.col("direction"), F.col("app"), F.col("pen"), F.col("conf"), F.col("certainty"))).withColumn("klass", sc.applicability_class(F.lit(True), F.col("m"), F.col("app")))
    uci = sc.residual_uncertainty(F.col("conf"), F.array().cast("array<string>"))
    level = sc.uncertainty_level(F.lit(True), F.col("m"), F.col("klass"), 100 * F.col("conf"), uci, F.col("approved"))
    verb = sc.reviewed_decision(sc.decision(F.col("direction"), F.col("strength")), F.col("m"), F.col("approved"))
    return r.select("s_suppkey", "conf", "klass", level.alias("level"), verb["verb"].alias("verb"))


@R.add("""SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'FAIL' WHEN c_acctbal < 1000 OR c_nationkey % 5 = 0 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM customer""")
def certification(t: Tables) -> DataFrame:
    """M20, M21."""
    yes = F.lit(True)
    c = sc.certification(F.col("c_acctbal") < 0, F.col("c_mktsegment") != "BUILDING", yes, yes, F.when(F.col("c_acctbal") < 1000, 0.5).otherwise(0.9), F.lit(0.9), F.col("c_nationkey") % 5 == 0)
    return t.customer.select("c_custkey", c.alias("c")).select("c_custkey", sc.certification_status(F.col("c.blocking"), F.col("c.soft")).alias("status"))


@R.add("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'validated' WHEN quality = 0 OR toxic = 1 THEN 'rejected' ELSE 'pending' END AS level FROM labels""")
def audit_resolution(t: Tables) -> DataFrame:
    """Two verdicts."""
    r = sc.audit_resolution(F.when(F.col("quality") == 1, "approved").otherwise("rejected"), F.when(F.col("toxic") == 0, "approved").otherwise("rejected"))
    return t.labels.select("doc_id", r["level"].alias("level"))


@R.add("""SELECT l_returnflag, round(avg(l_discount) - 0.05, 4) AS delta, abs(avg(l_discount) - 0.05) > 0.001 AS breached FROM lineitem GROUP BY 1""")
def drift(t: Tables) -> DataFrame:
    """M31."""
    d = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("a")).select("l_returnflag", sc.drift(F.col("a"), F.lit(0.05), F.lit(0.001)).alias("d"))
    return d.select("l_returnflag", F.round("d.delta", 4).alias("delta"), F.col("d.breached").alias("breached"))


@R.add("""SELECT p_partkey, trim(p_type) <> '' AND (p_partkey % 2 = 1 OR regexp_full_match(CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END, '[0-9]+')) AS ok FROM part""")
def code_validation(t: Tables) -> DataFrame:
    """M32."""
    system = F.when(F.col("p_partkey") % 2 == 0, "SNOMED").otherwise("ICD10")
    code = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""))
    return t.part.select("p_partkey", sc.valid_code(system, code).alias("ok"))


@R.add("""SELECT item_id, round(CASE WHEN hits / 3.0 < 0.35 THEN 0.35 ELSE hits / 3.0 END, 4) AS relevance FROM (SELECT item_id, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END AS hits FROM benchmark)""")
def query_relevance(t: Tables) -> DataFrame:
    """M15."""
    return t.benchmark.select("item_id", F.round(sc.query_relevance(F.col("text"), F.array(F.lit("the"), F.lit("der"), F.lit("que"))), 4).alias("relevance"))


@R.add("""SELECT doc_id, concat_ws(',', CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 1000 THEN 'long' END) AS tags, CAST(len(text) AS BIGINT) AS n FROM documents""")
def domain_tag_sets(t: Tables) -> DataFrame:
    """L03."""
    return t.documents.select("doc_id", F.array_join(lineage.tags((F.col("n_chars") > 1000, "long"), (F.col("lang") == "en", "english")), ",").alias("tags"), F.char_length("text").cast("long").alias("n"))


@R.add("""SELECT item_id, 'EO-' || upper(substr(sha256(CAST(item_id AS VARCHAR)), 1, 12)) AS object_id, sha256('{"record_id":"' || item_id || '","title":"' || substr(text, 1, 5) || '"}') AS hash FROM benchmark""")
def derived_objects(t: Tables) -> DataFrame:
    """L02, M14, M34."""
    r = t.benchmark.select("item_id", F.col("item_id").cast("string").alias("record_id"), F.substring("text", 1, 5).alias("title"), F.lit(None).cast("array<string>").alias("outcomes"))
    return lineage.derive(r).select(F.col("record_id").cast("long").alias("item_id"), "object_id", F.col("trace.hash").alias("hash"))


@R.add("""SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, strftime(o_orderdate, '%Y/%m/%d') AS folder, strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') AS valid_until, CAST(datediff('hour', o_orderdate, TIMESTAMP '2000-01-01') > 720 AS BOOLEAN) AS stale FROM orders""")
def dates(t: Tables) -> DataFrame:
    """L01, §2.11."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("year"), F.date_format(d, "yyyy/MM/dd").alias("folder"), F.date_format(d + F.expr("INTERVAL 30 DAYS"), "yyyyMMdd").alias("valid_until"), sc.stale(d, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).alias("stale"))


@R.add("""SELECT n_name AS node, 'region' AS level FROM nation WHERE n_regionkey = 0 UNION ALL SELECT s_name, 'nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0""")
def hierarchy_nodes(t: Tables) -> DataFrame:
    """Nodes below one root."""
    n = t.nation.where("n_regionkey = 0")
    return n.select(F.col("n_name").alias("node"), F.lit("region").alias("level")).unionByName(t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("node"), F.lit("nation").alias("level")))


@R.add("""SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def active_only(t: Tables) -> DataFrame:
    """Active rows that nothing deprecates."""
    gone = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return op.without_matching(t.part.where("p_type <> 'PROMO'"), gone, "p_partkey").select("p_partkey")


@R.add("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'restricted' WHEN s_acctbal < 3000 THEN 'internal' ELSE 'public' END AS sensitivity, CASE WHEN s_suppkey % 4 >= 3 THEN 'IV' WHEN s_suppkey % 4 = 2 THEN 'III' WHEN s_suppkey % 4 = 1 THEN 'II' ELSE 'I' END AS level FROM supplier""")
def class_tables(t: Tables) -> DataFrame:
    """Ordered thresholds as one expression."""
    severity = F.col("s_suppkey") % 4
    return t.supplier.select("s_suppkey", sc.tier(F.col("s_acctbal"), [(3000, "public"), (0, "internal")], "restricted").alias("sensitivity"), sc.tier(severity, [(3, "IV"), (2, "III"), (1, "II")], "I").alias("level"))


@R.add("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""")
def latest_twenty(t: Tables) -> DataFrame:
    """A limited timeline for each case."""
    return op.top_per_group(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@R.add("""SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n, round(sum(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM customer""")
def running_totals(t: Tables) -> DataFrame:
    """Places and running sums in a group."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.select("c_custkey", F.row_number().over(w).cast("long").alias("n"), F.round(F.sum("c_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))
