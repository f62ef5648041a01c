"""Audit, versions, integrity chains, state machines, artefact derivation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx


def integrity_chain(df: DataFrame, chain: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Each row's hash over its own payload, and the hash of the row before it in its chain."""
    window = Window.partitionBy(*chain).orderBy(*order)
    own = df.withColumn("hash", tx.canonical_hash(*payload))
    return own.withColumn("previous_hash", F.lag("hash").over(window))


def hash_chain(df: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """hash = SHA-256(previous hash | payload), from the empty string on; ``chain, order, hash``.

    Each hash needs the one before, so a chain goes through one task in order. The task reads sorted rows
    as they stream and keeps the last hash alone, so a long chain takes time but no memory. Ties are
    ordered by payload; a null payload is empty; rows of a null chain are one chain.
    """
    kind = dict(df.dtypes)
    rows = df.select(F.col(chain).alias("c"), F.col(order).alias("o"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, begun = None, "", False
        for batch in batches:
            hashes = []
            for c, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or c != current:
                    current, last, begun = c, "", True
                last = hashlib.sha256(f"{last}|{p}".encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string())], names=["c", "o", "hash"])

    ordered = rows.repartition("c").sortWithinPartitions("c", "o", "p")
    return ordered.mapInArrow(run, f"c {kind[chain]}, o {kind[order]}, hash string").toDF(chain, order, "hash")


#: Rows of a segment of a chain, as a power of two.
SEGMENT_BITS = 12


def verified_chain(df: DataFrame, chain: str, order: Sequence[str], payload: str, hash_: str) -> DataFrame:
    """Rows of stored chains with ``valid``: the stored hash is that of the stored hash before it
    and the row's own payload, as ``hash_chain`` makes it.

    Sorted rows are dealt in segments of bounded length, each of which needs no more of the chain than the
    last hash of the segment before it; so a chain of any length is verified by many tasks. A changed
    payload breaks its own row; a changed, lost or added row breaks the row after it too. Null payloads
    and hashes are empty; rows of a null chain are one chain; rows of equal order are ordered by hash.
    """
    from .linkage import written

    own = [F.col(chain).cast("string").alias("_chain"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(F.col(hash_), F.lit("")).alias("_hash"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("_payload")]
    keys = ["_chain", *[f"_o{i}" for i in range(len(order))], "_hash"]
    rows = df.select(F.struct("*").alias("_row"), *own).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_segment", F.shiftright("_at", SEGMENT_BITS)))
    inside = F.lag("_hash").over(Window.partitionBy("_chain", "_segment").orderBy("_at"))
    ends = rows.groupBy("_chain", "_segment").agg(F.max_by("_hash", "_at").alias("_last"))
    ends = ends.select("_chain", "_segment", F.lag("_last").over(Window.partitionBy("_chain").orderBy("_segment")).alias("_before"))
    a, b = rows.withColumn("_inside", inside).alias("a"), ends.alias("b")
    both = a.join(b, F.col("a._chain").eqNullSafe(F.col("b._chain")) & (F.col("a._segment") == F.col("b._segment")))
    previous = F.coalesce("_inside", "_before", F.lit(""))
    valid = F.sha2(F.concat_ws("|", previous, "_payload"), 256) == F.col("_hash")
    return both.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != "valid"], valid.alias("valid"))


def first_breaks(verified: DataFrame, chain: str, order: str) -> DataFrame:
    """Each chain's number of rows and of broken ones, and where it breaks first."""
    return verified.groupBy(chain).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("broken"), F.min(F.when(~F.col("valid"), F.col(order))).alias("first_break"))


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace those of their key."""
    return base.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Delete-then-insert of the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def timeline(events: DataFrame, document: str, time: str) -> DataFrame:
    """The number of each event of its document, oldest first."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(document).orderBy(time, "event_id")))


def audit_report(documents: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Documents with their events, with warnings for those without any or without a source."""
    counts = events.groupBy(key).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event"))
    warnings = F.array_compact(F.array(F.when(F.col("n_events").isNull(), "no-events"), F.when(F.col("source").isNull(), "no-source")))
    return documents.join(counts, key, "left").withColumn("warnings", warnings).withColumn("status", F.when(F.col("n_events").isNull(), "orphan").otherwise("tracked")).withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def tags(*rules: tuple[Column, str]) -> Column:
    """Sorted distinct tags of the rules that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))))


def normalized_ingest(df: DataFrame, time: str) -> DataFrame:
    """Trimmed texts, the time as a timestamp (a bad one raises), its year."""
    trimmed = df.withColumns({c: F.trim(c) for c, t in df.dtypes if t == "string"})
    return trimmed.withColumn(time, F.to_timestamp(time)).withColumn("year", F.year(time))


def positions(parts: Sequence[DataFrame], prefix: str, order: Sequence[str], by: str) -> DataFrame:
    """The union of parts with ids by position in each group."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("item_id", F.format_string(f"{prefix}%03d", "position"))


def steps_chain(df: DataFrame, plan: str, order: str, step: str) -> DataFrame:
    """Each step depends on the one before it in its plan."""
    return df.withColumn("depends_on", F.lag(step).over(Window.partitionBy(plan).orderBy(order)))


#: Fixed values (L10): attributes of a question and the triggers they raise.
TRIGGERS = [("urgent", "time-critical"), ("conflict", "evidence-conflict"), ("adverse", "safety-signal"), ("update", "new-evidence")]


def inferred_triggers(question: Column, rules: Sequence[tuple[str, str]] = TRIGGERS) -> Column:
    """Triggers of all rules whose word is in the question."""
    return tx.all_labels(question, rules)


def derive(records: DataFrame) -> DataFrame:
    """Decision objects of evidence records (struct assembly with fallbacks and a trace)."""
    return records.select(
        tx.short_id("EO-", F.col("record_id")).alias("object_id"), "record_id", F.coalesce("title", F.lit("untitled")).alias("title"),
        F.coalesce("outcomes", F.array(F.lit("unspecified"))).alias("outcomes"),
        F.struct(F.lit("record").alias("from_kind"), F.col("record_id").alias("from_id"), tx.canonical_hash("record_id", "title").alias("hash")).alias("trace"))
