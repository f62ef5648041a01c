"""Decision rules of cases and packages: levels, classes, gates, the layers of a case, audits.

Everything is a column expression, so a table of cases is judged in one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scoring import gates

# The names, reasons and limits of the rules.
LEVELS = [("guideline", "Class I"), ("consensus", "Class IIa"), ("review", "Class IIb")]
STRONG, MODERATE = ["guideline", "recommendation"], ["review"]
CONSENT_WORDS = ["consentimiento", "firma"]
SENSITIVE = {
    "highly_sensitive": "Incluye consentimiento o autorizacion clinica firmada.",
    "restricted": "Contiene datos clinicos directos y resultados observacionales.",
    "confidential": "Metadata documental con identificacion de caso clinico.",
}
DIRECT_KINDS = ["lab", "imaging", "medication"]
PRIORITY_KINDS = {"diagnosis": 260, "procedure": 210, "intervention": 230, "outcome": 220, "eo-candidate": 120}
PRIORITY_ROUTES = {"critical-pathway-anchor": 160, "route-anchor": 100}
PRIORITY_WORDS = (
    "infarto|infarction|cabg|revascular|keratoconus|queratocono|aortic|aorta|stroke|cerebral|aki|colorectal|coronary|heart|cardiac|valve|bypass"
    "|repair|replacement|resection|excision|drainage|transplant"
)
RELIABILITY_TIERS = ["Nivel 1 (interno validado)", "Nivel 2 (revisión requerida)", "Nivel 3 (confiabilidad limitada)"]
LAYERS = "IGL TG EL ETE EUL GHL KBOL RO BOM TAM EVT RDY-G LCCB CCCL SRM CQOI CML".split()
PRIMARY_SOURCES = ["doi_landing", "pubmed", "official_society", "publisher"]
SOUND = ["validated_primary", "validated_secondary"]


def recommendation_level(title: Column, synopsis: Column) -> Column:
    """The level of the first kind that title or synopsis names."""
    both = F.lower(F.concat_ws(" ", title, synopsis))
    return F.coalesce(*[F.when(F.contains(both, F.lit(word)), F.lit(level)) for word, level in LEVELS], F.lit("Class III"))


def recommendation_strength(tags: Column) -> Column:
    """By domain tags, in any case."""
    low = F.transform(tags, F.lower)
    has = lambda words: F.arrays_overlap(low, F.array(*map(F.lit, words)))
    return F.when(has(STRONG), "Strong").when(has(MODERATE), "Moderate").otherwise("Weak")


def sensitivity(kind: Column, payload: Column) -> Column:
    """Struct of class and reason, by the document's kind and what its text says."""
    low = F.lower(payload)
    signed = (kind == "consent") | reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in CONSENT_WORDS])
    name = F.when(signed, "highly_sensitive").when(kind.isin(DIRECT_KINDS), "restricted").otherwise("confidential")
    reason = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in SENSITIVE.items()])
    return F.struct(name.alias("class"), reason.alias("reason"))


def display_priority(text: Column, status: Column, system: Column, kind: Column, route: Column, label: Column, own: str) -> Column:
    """A sum of bonuses; long labels lose. ``own`` begins the names of one's own source systems."""
    def of(c: Column, table: dict[str, int]) -> Column:
        return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()], F.lit(0))

    return (F.when(status == "route-ready", 900).otherwise(0) + F.when(F.startswith(system, F.lit(own)), 360).otherwise(0) + F.when(system.eqNullSafe("ICD10_PCS"), 0).otherwise(140)
            + of(kind, PRIORITY_KINDS) + of(route, PRIORITY_ROUTES) + F.when(text.rlike(PRIORITY_WORDS), 120).otherwise(0) - F.when(F.length(label) > 220, 30).otherwise(0))


def reliability_tier(complete: Column, variables: Column, total: Column, first: float, second: float) -> Column:
    """Struct of the completeness index in percent, the mean reliability, and its tier."""
    mean = total / variables
    tier = F.when(mean >= first, RELIABILITY_TIERS[0]).when(mean >= second, RELIABILITY_TIERS[1]).otherwise(RELIABILITY_TIERS[2])
    return F.struct(F.round(100.0 * complete / variables, 1).alias("completeness"), mean.alias("reliability"), tier.alias("tier"))


def traceability(captures: Column, snapshots: Column, all_signed: Column, closed: Column) -> Column:
    """The mean of four coverages in percent: transitions, snapshots, overrides, documentation."""
    parts = [F.least(F.lit(100), captures * 16), F.least(F.lit(100), snapshots * 25), F.when(all_signed, 100).otherwise(40), F.when(closed, 78).otherwise(64)]
    return F.round(reduce(lambda a, b: a + b, parts) / 4, 2)


def case_translation(objects: Column, severity: Column) -> Column:
    """Struct of ecs and uci by evidence objects and the highest severity (none counts 0)."""
    return F.struct(F.round((88 + objects).cast("double"), 1).alias("ecs"), F.round(0.2 + F.greatest(F.coalesce(severity, F.lit(0)), F.lit(0)) * 0.045, 2).alias("uci"))


def case_uncertainty(severity: Column, uci: Column) -> Column:
    """Level 1 to 4 by the highest severity and the uncertainty."""
    most = F.greatest(F.coalesce(severity, F.lit(0)), F.lit(0))
    return F.when((most >= 4) | (uci > 0.55), 4).when((most >= 3) | (uci > 0.35), 3).when((most >= 1) | (uci > 0.15), 2).otherwise(1)


def information_gate(c: dict[str, Column]) -> Column:
    """M27, IGL: certificate, identifiers, consent, required data, completeness."""
    return gates({
        "ILC invalid or missing": c["certificate"], "Case ID missing": c["case_id"] != "", "Episode ID missing": c["episode_id"] != "", "Active consent missing": c["consent"],
        "DDMO baseline registry missing": F.size(c["required"]) > 0, "Data Completeness Index below threshold": c["completeness"] >= 0.85,
    })


def terminology_gate(codes: dict[str, Column]) -> Column:
    """M27, TG: at least one code of each of six systems; numbers of codes by system."""
    names = {"icd10": "ICD-10 codes missing", "snomed": "SNOMED CT codes missing", "loinc": "LOINC codes missing", "ucum": "UCUM units missing", "rxnorm": "RxNorm/ATC terms missing", "udi": "UDI/GS1 traceability missing"}
    return gates({said: codes[k] > 0 for k, said in names.items()})


def order_gate(level: Column, data_complete: Column, guideline_active: Column, version_active: Column) -> Column:
    """M27, KBOL."""
    return gates({"EUL must be LEVEL I-III": level <= 3, "DDMO-Gate must pass": data_complete, "Guideline package inactive": guideline_active, "VRN is not active": version_active})


def case_layers(c: dict[str, Column]) -> Column:
    """The 17 layers of a case in order, as structs of id, blockers and critical. A layer that needs
    what a blocked one would have made is blocked itself. ``c``: the columns of ``information_gate``,
    ``terminology_gate`` (as ``codes``, a dict) and ``order_gate``, and present (names), severity, objects,
    critical_events, transition."""
    complete = (F.size(F.array_except(c["required"], c["present"])) == 0) & c["data_present"]
    level = case_uncertainty(c["severity"], case_translation(c["objects"], c["severity"])["uci"])
    none = F.array().cast("array<string>")
    order = order_gate(level, complete, c["guideline_active"], c["version_active"])["blocking"]
    ordered = F.size(order) == 0
    ready = c["critical_events"] == 0
    one = lambda ok, said: F.when(ok, none).otherwise(F.array(F.lit(said)))
    blockers = {
        "IGL": information_gate(c)["blocking"], "TG": terminology_gate(c["codes"])["blocking"], "ETE": one(complete, "DDMO-Gate blocked"), "KBOL": order,
        "RO": one(ordered, "CPO must be active before runbook generation"), "BOM": one(ordered, "Runbook required before BOM validation"), "TAM": one(ordered, "BOM must be ready before TAM"),
        "RDY-G": one(ready, "Critical event active"), "LCCB": one(ready, "Readiness gate must be GO"), "CCCL": one(c["transition"], "State Transition Certificate missing"),
    }
    return F.transform(F.array(*[F.struct(F.lit(n).alias("id"), blockers.get(n, none).alias("blockers")) for n in LAYERS]), lambda x: F.struct(x["id"].alias("id"), x["blockers"].alias("blockers"), (F.size(x["blockers"]) > 0).alias("critical")))


def case_ok(layers: Column) -> Column:
    """No layer is critical."""
    return F.forall(layers, lambda x: ~x["critical"])


def quality_audit(records: DataFrame, expected: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """``id, rule`` for each record that fails one of five rules: duplicate pmid, validated without
    doi, core without title or validation, top ten not validated, guideline without a primary source.
    With ``expected`` and ``found`` output files (name, size), a sixth: files that are missing or empty."""
    validated = F.startswith("validation_status", F.lit("validated"))
    copies = F.count("*").over(Window.partitionBy("pmid"))
    rules = {
        "duplicate-pmid": (F.col("pmid") != "") & (F.col("_copies") > 1),
        "validated-without-doi": validated & (F.coalesce("doi", F.lit("")) == ""),
        "core-incomplete": (F.col("tier") == "absolute_core") & ((F.coalesce("title", F.lit("")) == "") | ~validated),
        "top10-status": (F.col("priority_rank") <= 10) & ~F.col("validation_status").isin(SOUND),
        "guideline-source": (F.col("domain_group") == "guideline_trunk") & ~F.coalesce(F.col("source_of_truth").isin(PRIMARY_SOURCES), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    issues = records.withColumn("_copies", copies).select("id", F.explode(broken).alias("rule"))
    if expected is None or found is None:
        return issues
    there = found.where("size > 0").select("name").distinct()
    absent = expected.select("name").distinct().join(there, "name", "left_anti")
    return issues.select(F.col("id").cast("string").alias("id"), "rule").unionByName(absent.select(F.col("name").alias("id"), F.lit("missing-output").alias("rule")))


def package_links(objects: DataFrame, package: str) -> DataFrame:
    """One link of the package to each object (object_id, record_id, domain)."""
    return objects.select(
        F.concat_ws("-", F.lit("LINK"), F.lit(package), "object_id").alias("link_id"), F.lit(package).alias("package_id"), "object_id", "record_id", "domain", F.upper("domain").alias("group_label"))


def active_set(sets: DataFrame, system: str, version: str | None = None) -> DataFrame:
    """Active sets of a system, of one version if asked for."""
    found = sets.where((F.col("system") == system) & F.col("is_active"))
    return found if version is None else found.where(F.col("version") == version)


def reactivated(changes: DataFrame, deprecations: DataFrame, version: str) -> DataFrame:
    """Changes (key, status, and allow, whether to reactivate all the same) of versions that a
    deprecation record names raise an error if they would make one active; the others come back."""
    marked = changes.join(deprecations.select(version, F.lit(True).alias("_deprecated")).distinct(), version, "left")
    blocked = F.col("_deprecated").isNotNull() & (F.col("status") == "ACTIVE") & ~F.col("allow")
    return marked.withColumn("blocked", F.coalesce(blocked, F.lit(False))).drop("_deprecated")


def raise_if_blocked(changes: DataFrame) -> DataFrame:
    """The changes, or an error at the first blocked one that is read."""
    said = F.raise_error(F.lit("VRN reactivation is blocked by deprecation record."))
    return changes.where(F.when(F.col("blocked"), said.cast("boolean")).otherwise(F.lit(True)))


def adapted(artefacts: DataFrame, names: dict[str, str], required: list[str]) -> DataFrame:
    """Interchange records with snake_case fields as columns of the model: renames by a table,
    defaults for lists, and the missing required fields of each as ``missing``."""
    have = {f.name: f.dataType.simpleString() for f in artefacts.schema.fields}
    columns = [F.coalesce(F.col(old), F.array().cast(have[old])).alias(new) if have[old].startswith("array") else F.col(old).alias(new) for old, new in names.items()]
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(r).cast("string")), F.lit("")) == "", F.lit(names[r])) for r in required]))
    return artefacts.select(*columns, gaps.alias("missing"))
