"""Terminologies: raw vocabularies to concepts, descriptions, relationships and mappings; search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from .crawl import crawl
from .linkage import written


@dataclass
class Terms:
    """The four tables of a vocabulary."""

    concepts: DataFrame
    descriptions: DataFrame
    relationships: DataFrame
    mappings: DataFrame | None = None

    def union(self, other: Terms) -> Terms:
        both = [m for m in (self.mappings, other.mappings) if m is not None]
        return Terms(self.concepts.unionByName(other.concepts), self.descriptions.unionByName(other.descriptions), self.relationships.unionByName(other.relationships), both[0].unionByName(both[1]) if len(both) == 2 else (both or [None])[0])


def concept_id(system: str, code: Column) -> Column:
    """K06."""
    return tx.joined_id(F.lit(system), code)


def concepts(rows: DataFrame, system: str, version: str) -> DataFrame:
    return rows.where("trim(code) <> ''").select(concept_id(system, F.col("code")).alias("id"), "code", F.lit(system).alias("system"), F.lit(version).alias("version")).distinct()


def descriptions(rows: DataFrame, system: str, kind: Column, language: str = "en") -> DataFrame:
    return rows.where("trim(code) <> '' AND trim(term) <> ''").select(tx.joined_id(F.lit(system), F.col("code"), kind, F.col("term")).alias("id"), concept_id(system, F.col("code")).alias("concept_id"), "term", F.lit(language).alias("language"), kind.alias("type"), F.lit(system).alias("system")).distinct()


def relationships(rows: DataFrame, system: str, kind: Column) -> DataFrame:
    """Edges with both ends; whether the parent is a concept isn't asked."""
    return rows.where("trim(code) <> '' AND trim(parent) <> ''").select(tx.joined_id(F.lit(system), F.col("code"), kind, F.col("parent")).alias("id"), concept_id(system, F.col("code")).alias("source_concept_id"), concept_id(system, F.col("parent")).alias("target_concept_id"), kind.alias("relationship_type"), F.lit(system).alias("system")).distinct()


def mappings(rows: DataFrame, system: str, target: str, kind: str) -> DataFrame:
    return rows.where("trim(code) <> '' AND trim(target_code) <> ''").select(tx.joined_id(F.lit(system), F.col("code"), F.lit(target), F.col("target_code")).alias("id"), concept_id(system, F.col("code")).alias("source_concept_id"), "target_code", F.lit(target).alias("target_system"), F.lit(kind).alias("mapping_type"), F.lit(system).alias("system")).distinct()


def icd10(classes: DataFrame, version: str) -> Terms:
    """Rows of code, preferred, definition, parent (from the attribute or the child element)."""
    preferred = classes.select("code", F.col("preferred").alias("term"))
    defined = classes.select("code", F.col("definition").alias("term"))
    return Terms(concepts(classes, "ICD10", version), descriptions(preferred, "ICD10", F.lit("preferred")).unionByName(descriptions(defined, "ICD10", F.lit("definition"))), relationships(classes, "ICD10", F.lit("is-a")))


def loinc(rows: DataFrame, version: str) -> Terms:
    """LOINC_NUM, LONG_COMMON_NAME, CLASS; a class is a node that codes are part of. A related name
    that begins with SNOMED maps to the code after its last colon."""
    r = rows.select(F.col("LOINC_NUM").alias("code"), F.col("LONG_COMMON_NAME").alias("term"), F.col("CLASS").alias("parent"), F.col("RELATEDNAMES2").alias("related"))
    nodes = r.select(F.col("parent").alias("code"), F.col("parent").alias("term"))
    to = r.where(F.startswith(F.upper(F.trim("related")), F.lit("SNOMED"))).withColumn("target_code", F.trim(F.element_at(F.split("related", ":"), -1)))
    return Terms(concepts(r.select("code").unionByName(nodes.select("code")), "LOINC", version), descriptions(r.select("code", "term").unionByName(nodes), "LOINC", F.lit("preferred")), relationships(r, "LOINC", F.lit("part-of")), mappings(to, "LOINC", "SNOMED", "related"))


def rxnorm(conso: DataFrame, rel: DataFrame, sat: DataFrame, version: str) -> Terms:
    """By position: CONSO 0 id, 1 language, 12 kind, 14 term; REL 0, 3 relation, 4 id, 7 its name;
    SAT 0 id, 8 attribute, 10 value."""
    c = conso.select(F.col("_c0").alias("code"), F.col("_c14").alias("term"), F.lower("_c12").alias("kind"))
    named = F.when(F.lower("_c7").isin("isa", "has_ingredient"), "is-a").otherwise(F.lower(F.coalesce("_c7", "_c3")))
    r = rel.select(F.col("_c0").alias("code"), F.col("_c4").alias("parent"), named.alias("kind"))
    s = sat.where("_c8 = 'ATC'").select(F.col("_c0").alias("code"), F.col("_c10").alias("target_code"))
    return Terms(concepts(c, "RXNORM", version), descriptions(c, "RXNORM", F.col("kind")), relationships(r, "RXNORM", F.col("kind")), mappings(s, "RXNORM", "ATC", "exact"))


#: Fixed values (K04): SNOMED's ids of a fully specified name and of "is a".
PREFERRED, IS_A = "900000000000003001", "116680003"


def snomed(concept_rows: DataFrame, description_rows: DataFrame, relationship_rows: DataFrame, version: str) -> Terms:
    """Active rows only."""
    c = concept_rows.where("active = '1'").select(F.col("id").alias("code"))
    d = description_rows.where("active = '1'").select(F.col("conceptId").alias("code"), "term", F.when(F.col("typeId") == PREFERRED, "preferred").otherwise("synonym").alias("kind"))
    r = relationship_rows.where("active = '1'").select(F.col("sourceId").alias("code"), F.col("destinationId").alias("parent"), F.when(F.col("typeId") == IS_A, "is-a").otherwise("part-of").alias("kind"))
    return Terms(concepts(c, "SNOMED", version), descriptions(d, "SNOMED", F.col("kind")), relationships(r, "SNOMED", F.col("kind")))


def ucum(units: DataFrame, version: str) -> Terms:
    """Rows of code and name."""
    u = units.select("code", F.col("name").alias("term"))
    none = u.select("code", F.lit("").alias("parent"))
    return Terms(concepts(u, "UCUM", version), descriptions(u, "UCUM", F.lit("preferred")), relationships(none, "UCUM", F.lit("is-a")))


def ingest_status(found: DataFrame, known: DataFrame) -> DataFrame:
    """By system and content hash: SKIPPED (no files), UNCHANGED, PROCESSED. Unchanged inputs are
    parsed all the same by who asks for it; only the status says so."""
    k = known.select("system", F.col("digest").alias("_known"))
    status = F.when(F.col("digest").isNull(), "SKIPPED").when(F.col("digest") == F.col("_known"), "UNCHANGED").otherwise("PROCESSED")
    return found.join(k, "system", "left").withColumn("status", status).drop("_known")


def ingest(spark: SparkSession, parsers: Mapping[str, Callable[[], Terms]], found: DataFrame, known: DataFrame) -> tuple[dict[str, Terms], DataFrame, DataFrame]:
    """Run the parser of each system, one after the other, and go on where one fails.

    ``found`` has the digest of each system's files (null: none) and ``known`` that of the last good run.
    Returns the terms of the systems that went well, written; ``system, status, rows, digest``, with
    status SKIPPED (no files; not parsed), UNCHANGED, PROCESSED or ERROR (no rows); and ``system,
    error_type, message`` of those that failed. A failed system's digest isn't to be kept as known.
    """
    statuses = {r.system: r for r in ingest_status(found, known).where(F.col("system").isin(*parsers)).collect()}  # a row a parser
    terms, rows, errors = {}, [], []
    for system, parse in parsers.items():
        state = statuses.get(system)
        if state is None or state.status == "SKIPPED":
            rows.append((system, "SKIPPED", 0, None))
            continue
        try:
            parsed = Terms(*[None if df is None else written(df) for df in vars(parse()).values()])
            n = sum(df.count() for df in vars(parsed).values() if df is not None)
        except Exception as e:  # noqa: BLE001 - whatever a system's files do, the others go on
            rows.append((system, "ERROR", 0, state.digest))
            errors.append((system, type(e).__name__, str(e)[:1000]))
            continue
        terms[system] = parsed
        rows.append((system, state.status, n, state.digest))
    return terms, spark.createDataFrame(rows, "system string, status string, rows long, digest string"), spark.createDataFrame(errors, "system string, error_type string, message string")


def search(terms: DataFrame, query: str, columns: Sequence[str], limit: int = 50) -> DataFrame:
    """Rows with the text in any column, in any case, ordered by the columns."""
    low = query.lower()
    test = None
    for c in columns:
        hit = F.contains(F.lower(c), F.lit(low))
        test = hit if test is None else test | hit
    return terms.where(test).orderBy(*columns).limit(limit)


def translate(items: DataFrame, maps: DataFrame, most: int = 1000) -> DataFrame:
    """Codes with their targets; those without one carry an error. ``most`` is the size of a batch
    that callers may ask for; more raises."""
    if items.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} items")
    hit = maps.select("source_concept_id", "target_code", "target_system")
    out = items.join(hit, "source_concept_id", "left")
    return out.withColumn("error", F.when(F.col("target_code").isNull(), F.lit("no mapping")))


def primary_codes(codes: DataFrame, term: str, category: str, preference: dict[str, Sequence[str]]) -> DataFrame:
    """For each term the code of the system that its category prefers."""
    place = F.lit(99)
    for name, systems in preference.items():
        place = F.when(F.col(category) == name, F.array_position(F.array(*map(F.lit, systems)), F.col("system"))).otherwise(place)
    place = F.when(place == 0, 99).otherwise(place)
    best = F.row_number().over(Window.partitionBy(term).orderBy(place, "system", "code"))
    return codes.withColumn("_n", best).withColumn("is_primary", F.col("_n") == 1).drop("_n")


def descendants(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes below the roots with their least depth, however deep; with ``most``, the first so
    many nodes in breadth-first order."""
    return crawl(edges, roots, most)
