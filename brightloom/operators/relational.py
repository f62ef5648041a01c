"""Filters, joins, rollups, rankings. Small sides are left to Catalyst, which broadcasts by size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


# --- Filters and paging (F) -----------------------------------------------------------------------


def equals_ignoring_case(df: DataFrame, **wanted: str | None) -> DataFrame:
    """rows whose columns equal the given values in any case; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.lower(F.col(name)) == value.lower())
    return df


def search_columns(df: DataFrame, query: str | None, columns: Sequence[str], escape: bool = False) -> DataFrame:
    """rows with the text in any of the columns. ``%`` and ``_`` are wild cards unless escaped."""
    if not query:
        return df
    if escape:
        tests = [F.contains(F.lower(F.col(c)), F.lit(query.lower())) for c in columns]
    else:
        tests = [F.lower(F.col(c)).like(f"%{query.lower()}%") for c in columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """one page in a total order, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def latest(df: DataFrame, time: str, n: int, *ties: str) -> DataFrame:
    """The newest rows, a top-k without a full sort."""
    return df.orderBy(F.desc(time), *ties).limit(n)


def first_source(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """for each key the row of the first source that has it."""
    marked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)])
    best = F.row_number().over(Window.partitionBy(key).orderBy("_source"))
    return marked.withColumn("_n", best).where("_n = 1").drop("_n", "_source")


def having_member(df: DataFrame, array: str, value: str) -> DataFrame:
    """Rows whose array has the value."""
    return df.where(F.array_contains(array, value))


def facet(primary: str, others: str, value: str) -> Column:
    """the value is the primary one or among all."""
    return (F.col(primary) == value) | F.array_contains(others, value)


def at_least(column: str, least: float | None) -> Column:
    """F16: a null fails only if a minimum is set."""
    return F.lit(True) if least is None else F.coalesce(F.col(column) >= least, F.lit(False))


def presets(df: DataFrame, name: str, table: dict[str, Sequence[Column]]) -> DataFrame:
    """all predicates of a named preset."""
    return reduce(lambda d, p: d.where(p), table[name], df)


def allowed(*reasons: Column) -> Column:
    """any of the reasons holds; null doesn't."""
    return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in reasons])


# --- Joins (J) ------------------------------------------------------------------------------------


def overlay(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Joined rows; where the right side has a value for a shared column, it wins."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(other, key, how)
    return out.withColumns({c: F.coalesce(f"_r_{c}", c) for c in shared}).drop(*[f"_r_{c}" for c in shared])


def with_matching(df: DataFrame, other: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """J05, J07, J11."""
    return df.join(other, keys, "left_semi")


def without_matching(df: DataFrame, other: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """J07, J12."""
    return df.join(other, keys, "left_anti")


def preferred_term(concepts: DataFrame, terms: DataFrame) -> DataFrame:
    """The preferred term of each concept, its code if it has none."""
    first = terms.where("type = 'preferred'").groupBy("concept_id").agg(F.min("term").alias("_term"))
    return concepts.join(first, concepts["id"] == first["concept_id"], "left").drop("concept_id").withColumn("label", F.coalesce("_term", "code")).drop("_term")


def first_contained(df: DataFrame, text: str, words: Sequence[tuple[str, str]], name: str = "label") -> DataFrame:
    """The label of the first listed word that the text contains. The list is a literal, so it is
    one expression and no join."""
    low = F.lower(F.col(text))
    return df.withColumn(name, F.coalesce(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(label)) for w, label in words], F.lit(None).cast("string")))


def contained_either_way(df: DataFrame, text: str, words: Sequence[str], name: str = "matches") -> DataFrame:
    """All listed words that contain the text or are contained in it."""
    low = F.lower(F.col(text))
    tests = [F.when(F.contains(low, F.lit(w)) | F.contains(F.lit(w), low), F.lit(w)) for w in map(str.lower, words)]
    return df.withColumn(name, F.array_compact(F.array(*tests)))


def differing_within(df: DataFrame, group: str, by: str, key: str) -> DataFrame:
    """For each row the number of rows of its group that differ in ``by``. Counts meet, not rows, so
    a hot group gives no pairs."""
    counts = df.groupBy(group, by).agg(F.count("*").alias("_n"))
    totals = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    return df.join(totals, [group, by]).withColumn("n_differing", F.col("_all") - F.col("_n")).select(*df.columns, "n_differing")


def challenges(df: DataFrame, group: str, stance: str, score: str, key: str, most: int | None = None, neutral: str = "mixed") -> DataFrame:
    """In each group with two stances or more besides the neutral one, the preferred row (the
    highest score, then the least key) against each row of another stance, the best first if at most
    ``most`` are asked for: ``group, preferred, preferred_stance, preferred_score, challenger, challenger_stance,
    challenger_score``, then their ``place``. A group has as many pairs as challengers, never all pairs. Rows without a
    stance, score or key take no part."""
    rows = df.where(F.col(stance).isNotNull() & F.col(score).isNotNull() & F.col(key).isNotNull())
    mine = F.struct(F.col(score).alias("s"), F.col(key).alias("k"), F.col(stance).alias("t"))
    best = rows.groupBy(group, stance).agg(F.min_by(mine, F.struct(-F.col(score), F.col(key))).alias("b"))
    sides = F.count_if(F.col(stance) != neutral)
    best = best.groupBy(group).agg(F.min_by("b", F.struct(-F.col("b.s"), F.col("b.k"))).alias("b"), sides.alias("sides")).where("sides > 1")
    pairs = rows.alias("c").join(best.alias("p"), F.col(f"c.{group}").eqNullSafe(F.col(f"p.{group}")) & (F.col(f"c.{stance}") != F.col("p.b.t")))
    out = pairs.select(F.col(f"c.{group}").alias(group), F.col("b.k").alias("preferred"), F.col("b.t").alias("preferred_stance"), F.col("b.s").alias("preferred_score"), F.col(f"c.{key}").alias("challenger"), F.col(f"c.{stance}").alias("challenger_stance"), F.col(f"c.{score}").alias("challenger_score"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("challenger_score"), "challenger"))
    return out if most is None else out.withColumn("place", place).where(F.col("place") <= most)


# --- Rollups (A) ----------------------------------------------------------------------------------


def ranking(df: DataFrame, keys: Sequence[str], weight: str, confidence: str) -> DataFrame:
    """Count, mean weight and mean confidence of each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(weight), 3).alias("avg_weight"), F.round(F.avg(confidence), 3).alias("avg_confidence"))


def top_kinds(df: DataFrame, keys: Sequence[str], kind: str, k: int = 4) -> DataFrame:
    """The most frequent kinds of each group as ``kind:count``, ties by name. Ranks are limited
    before anything is collected."""
    counts = df.groupBy(*keys, kind).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), kind))
    top = counts.withColumn("_r", rank).where(F.col("_r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", kind, F.col("_n").cast("string")).alias("s"))))
    return top.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("kinds"))


def conditional_counts(df: DataFrame, keys: Sequence[str], **tests: Column) -> DataFrame:
    """How many rows of each group pass each test."""
    return df.groupBy(*keys).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def count_by(df: DataFrame, field: str, unknown: str = "unknown") -> DataFrame:
    """Counts by a field, null named, most frequent first."""
    return df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit(unknown)).alias(field)).agg(F.count("*").alias("n"))


def facet_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts by each of several fields in one pass over the input."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def browser_rollup(df: DataFrame, key: Column, sets: dict[str, str], priority: str) -> DataFrame:
    """By a normalised label: sorted sets of other columns, the highest priority, the count."""
    return df.groupBy(key.alias("key")).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()], F.max(priority).alias("priority"), F.count("*").alias("n"))


def dominant(values: Column, order: Sequence[str]) -> Column:
    """The first of ``order`` among the values, else the smallest."""
    return F.coalesce(F.get(F.array_intersect(F.array(*map(F.lit, order)), values), F.lit(0)), F.array_min(values))


def bars(df: DataFrame, field: str, k: int = 8) -> DataFrame:
    """The top counts, ties by name, with widths of 6 to 100 relative to the largest."""
    top = count_by(df, field).orderBy(F.desc("n"), field).limit(k)
    return top.withColumn("width", F.greatest(F.lit(6), F.round(100 * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1)))).cast("int")))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A14."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def zero_filled(df: DataFrame, field: str, values: Sequence[str]) -> DataFrame:
    """Counts of the listed values, 0 for those that don't occur."""
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{field} string")
    return listed.join(df.groupBy(field).agg(F.count("*").alias("n")), field, "left").select(field, F.coalesce("n", F.lit(0)).alias("n"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, line) on so many pages of their document that they are running heads: a
    sixth of the pages, 3 at least; none in documents of under 6 pages."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = lines.groupBy("doc", "line").agg(F.count_distinct("page").alias("on_pages"))
    limit = F.when(F.col("pages") >= 6, F.greatest(F.lit(3), F.floor(F.col("pages") / 6))).otherwise(99)
    return seen.join(pages, "doc").where(F.col("on_pages") >= limit).select("doc", "line", "on_pages")


def set_digest(df: DataFrame, keys: Sequence[str], name: str, digest: str) -> DataFrame:
    """One hash of the sorted names and digests of each group."""
    listed = F.array_sort(F.collect_list(F.concat(F.col(name), F.col(digest))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(listed, ""), 256).alias("digest"))


def streamed_digest(df: DataFrame, key: str, name: str, digest: str) -> DataFrame:
    """A24 for groups of any size: ``key, digest``, the SHA-256 of ``name:digest`` of the group's rows by
    name, with bars between. Sorted rows stream through a running hash, so a group takes time in one task
    but no memory. Nulls are empty; ties are ordered by digest."""
    kind = dict(df.dtypes)[key]
    text = F.concat_ws(":", F.coalesce(F.col(name).cast("string"), F.lit("")), F.coalesce(F.col(digest), F.lit("")))
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("o"), text.alias("t")).repartition("k").sortWithinPartitions("k", "o", "t").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = k, hashlib.sha256(t.encode())
                else:
                    state.update(b"|" + t.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.column(0).type), pa.array([d for _, d in done], pa.string())], names=["k", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.column(0).type), pa.array([state.hexdigest()], pa.string())], names=["k", "digest"])

    return rows.mapInArrow(run, f"k {kind}, digest string").withColumnRenamed("k", key)


def joined_set(c: Column | str, separator: str = "; ") -> Column:
    """Sorted distinct values as text."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


# --- Rankings (W) ---------------------------------------------------------------------------------


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. End the order with a unique key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def preferred_and_others(df: DataFrame, group: str, order: Sequence[Column | str], by: str, k: int = 3) -> DataFrame:
    """Each group's first row, and the next rows that differ from it in ``by``."""
    window = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("_first", F.first(by).over(window)).withColumn("place", F.row_number().over(window))
    marked = marked.where((F.col("place") == 1) | (F.col(by) != F.col("_first")))
    return marked.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k + 1).drop("_first")


def versions(df: DataFrame, lineage: Sequence[str], time: Sequence[Column | str], key: str) -> DataFrame:
    """The version number in a lineage, and the key of the version before."""
    window = Window.partitionBy(*lineage).orderBy(*time)
    return df.withColumn("version", F.row_number().over(window)).withColumn("previous", F.lag(key).over(window))


def best_candidate(df: DataFrame, group: str, score: str, ordinal: str, least: float) -> DataFrame:
    """The highest score of each group that reaches the threshold; of ties the first."""
    return top_per_group(df.where(F.col(score) >= least), [group], [F.desc(score), ordinal], 1).drop("rank")


def latest_per_key(df: DataFrame, key: Sequence[str], time: Sequence[Column | str]) -> DataFrame:
    """The last row of each key."""
    return top_per_group(df, key, time, 1).drop("rank")


def mixed_order(column: str) -> list[Column]:
    """Numbers first, by value, then texts."""
    number = F.col(column).try_cast("double")
    return [number.isNull().asc(), number.asc(), F.lower(F.col(column)).asc()]
