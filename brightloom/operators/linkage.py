"""Deduplication, record linkage and survivorship."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a
    session on a local master (one machine, as in tests) gets a folder of its own; any other is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="brightloom-"))
        folder = context.getCheckpointDir()
    return folder


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's file systems close."""
    path = f"{shared_folder(spark).rstrip('/')}/brightloom-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read again."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact(df: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each content, by its SHA-256. The hash is what shuffles, with the key of the
    first row; copies are summed up before that."""
    keyed = df.withColumn("sha256", F.sha2(content, 256))
    return keyed.groupBy("sha256").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def by_key(df: DataFrame, key: Column, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; rows without a key stay."""
    keyed = df.withColumn("_key", key)
    best = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    kept = keyed.where("_key IS NOT NULL").withColumn("_n", best).where("_n = 1").drop("_n")
    return kept.unionByName(keyed.where("_key IS NULL")).drop("_key")


def first_key(doi: str, pmid: str, title: str, url: str) -> Column:
    """The first key that a record has: doi, pmid, title, address without query and slash."""
    address = F.regexp_replace(F.regexp_replace(F.lower(F.col(url)), r"[?#].*$", ""), "/+$", "")
    return F.coalesce(F.concat(F.lit("doi:"), tx.doi(doi)), F.concat(F.lit("pmid:"), tx.first_filled(pmid)), F.concat(F.lit("title:"), F.nullif(tx.title_key(title), F.lit(""))), F.concat(F.lit("url:"), F.nullif(address, F.lit(""))))


def conflicts(df: DataFrame, key: Column, score: str, title: str) -> DataFrame:
    """Keys whose best score several titles share."""
    best = df.withColumn("key", key).groupBy("key", score).agg(F.count_distinct(title).alias("titles"))
    top = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(score)))
    return best.withColumn("_n", top).where("_n = 1 AND titles > 1 AND key IS NOT NULL").select("key", "titles")


def link_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of strings linked by edges (a, b): the smallest hash labels spread, halving paths.

    Every round is a few joins and aggregates and is written; rounds grow with the logarithm of the
    number of nodes. Nothing is collected.
    """
    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))

    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("root")))
        steps.append(step)
        edges = written(edges.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    out = steps.pop() if steps else edges.toDF("node", "root")
    while steps:
        lower = steps.pop()
        out = written(lower.join(out.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return out


def resolve(records: DataFrame, keys: Sequence[str], ordinal: str, mode: str = "components") -> DataFrame:
    """``ordinal, cluster`` of each record; a cluster is named by its first record's ordinal.

    ``components``: records that share any key, directly or through others, are one cluster; no order
    matters. ``ordered``: records arrive by ordinal; the first of its keys that is known decides the
    cluster, then all its keys point there, so a record that links two clusters doesn't merge them.
    Ordinals are distinct. A record without keys is a cluster.
    """
    parts = F.filter(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in keys]), lambda x: x.isNotNull())
    rows = written(records.select(F.col(ordinal).cast("long").alias("ordinal"), parts.alias("keys")))
    if mode == "ordered":
        return _in_order(rows)
    first = F.get("keys", F.lit(0))
    edges = rows.select(first.alias("a"), F.explode("keys").alias("b"))
    roots = link_components(edges)
    placed = rows.withColumn("a", first).join(roots.toDF("a", "root"), "a", "left").withColumn("root", F.coalesce("root", "a", F.concat(F.lit("row:"), F.col("ordinal").cast("string"))))
    names = placed.groupBy("root").agg(F.min("ordinal").alias("cluster"))
    return placed.join(names, "root").select("ordinal", "cluster")


#: Runs of ordinals that the holders of one key are dealt by.
RUNS = 64


def _in_order(rows: DataFrame) -> DataFrame:
    """Clusters of records (ordinal, keys by rank) that arrive one by one.

    A key always points to the cluster of the latest record that held it. So a record that isn't new
    belongs where the latest earlier holder of its deciding key belongs, and if that one was decided by
    the same key too, where the last holder before that wasn't. Those pointers are found by a running
    maximum over each key's holders, run by run of ordinals, so the holders of a frequent key are spread;
    doubling the pointers then takes a few joins for a chain of any length.
    """
    held = rows.select("ordinal", F.posexplode("keys").alias("place", "key"))
    later = held.join(held.groupBy("key").agg(F.min("ordinal").alias("first")), "key").where("ordinal > first")
    deciding = later.groupBy("ordinal").agg(F.min_by("key", "place").alias("by"))
    borders = sorted(set(rows.approxQuantile("ordinal", [i / RUNS for i in range(1, RUNS)], 0.001)))
    run = F.size(F.filter(F.array(*map(F.lit, borders)), lambda x: x < F.col("ordinal"))) if borders else F.lit(0)
    held = written(held.join(deciding, "ordinal", "left").select("ordinal", "key", F.col("key").eqNullSafe(F.col("by")).alias("decided"), run.alias("run")))
    anchor = F.max(F.when(~F.col("decided"), F.col("ordinal")))
    inside = held.withColumn("near", anchor.over(Window.partitionBy("key", "run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))).where("decided")
    runs = held.groupBy("key", "run").agg(anchor.alias("last"))
    runs = runs.select("key", "run", F.max("last").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    points = inside.join(runs, ["key", "run"]).select("ordinal", F.coalesce("near", "far").alias("to"))
    points = written(points.withColumn("done", F.lit(False)))
    while not points.where("NOT done").isEmpty():
        a, b = points.where("NOT done").alias("a"), points.alias("b")
        moved = a.join(b, F.col("a.to") == F.col("b.ordinal"), "left").select("a.ordinal", F.coalesce("b.to", "a.to").alias("to"), F.coalesce("b.done", F.lit(True)).alias("done"))
        points = written(points.where("done").unionByName(moved))
    return rows.join(points.select("ordinal", "to"), "ordinal", "left").select("ordinal", F.coalesce("to", "ordinal").alias("cluster"))


ACCESS = ("open", "unknown", "restricted")


def survivors(members: DataFrame, cluster: str, order: str, longest: Sequence[str] = (), first: Sequence[str] = (), union: Sequence[str] = (), joined: Sequence[str] = (), access: str | None = None) -> DataFrame:
    """One record for each cluster: the longest text, the first value, the union of lists in order
    of arrival, sorted joined values, and the most open access. All are aggregates with partial sums;
    lists are those of one cluster."""
    aggs = [F.max_by(c, F.struct(F.length(F.trim(c)), -F.col(order))).alias(c) for c in longest]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    aggs += [_ordered_union(c, order) for c in union]
    aggs += [F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(c) for c in joined]
    if access:
        places = F.array_position(F.array(*map(F.lit, ACCESS)), F.col(access))
        aggs.append(F.min_by(access, F.when(places > 0, places)).alias(access))
    return members.groupBy(cluster).agg(*aggs)


def _ordered_union(name: str, order: str) -> Column:
    return F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("v"))))["v"])).alias(name)


def priority_merge(sources: DataFrame, key: str, order: str, fields: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """For each field the first value that isn't blank, in source order; for ``last`` the last."""
    def pick(name: str, best) -> Column:
        filled = F.nullif(F.trim(F.col(name)), F.lit(""))
        return best(name, F.when(filled.isNotNull(), F.col(order))).alias(name)

    return sources.groupBy(key).agg(*[pick(f, F.max_by if f in last else F.min_by) for f in fields])


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Codes that are missing or unexpected."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def year_bonus(a: Column, b: Column) -> Column:
    """0.15 for the same year, less by distance."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 0.15).otherwise(F.greatest(F.lit(0.0), 0.1 - 0.03 * gap))


#: Fixed values.
ERRATA = ["erratum", "correction", "comment", "reply", "retraction"]


def erratum_penalty(title: Column) -> Column:
    """0.4 off for each word of notices in the title."""
    return F.size(F.filter(F.array(*map(F.lit, ERRATA)), lambda w: F.contains(F.lower(title), w))) * F.lit(-0.4)


def dice_pairs(left: DataFrame, right: DataFrame, key: str, other: str, least: float) -> DataFrame:
    """D10 as a join: pairs of (id, tokens) whose Dice similarity reaches ``least``, by an inverted index
    with prefix filtering: of n tokens, only the n - ceil(least / (2 - least) * n) + 1 rarest can be the
    first that a similar pair shares, so frequent tokens drop out of the join. ``least`` is taken lower there
    by what the result is rounded by, so that the prefix errs to the long side."""
    low = least - 1e-6
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name), F.explode("tokens").alias("t"))

    freq = ranked(left, key).unionByName(ranked(right, other).withColumnRenamed(other, key)).groupBy("t").agg(F.count("*").alias("f"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        sorted_ = ranked(df, name).join(freq, "t").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "t")))["t"].alias("s"))
        n = F.size("s")
        keep = n - F.ceil(F.lit(low / (2 - low)) * n).cast("int") + 1
        return sorted_.select(name, F.explode(F.slice("s", F.lit(1), F.greatest(keep, F.lit(1)))).alias("t"))

    pairs = prefix(left, key).join(prefix(right, other), "t").select(key, other).distinct()
    full = pairs.join(left.select(key, F.col("tokens").alias("_a")), key).join(right.select(other, F.col("tokens").alias("_b")), other)
    return full.withColumn("dice", F.round(tx.dice(F.col("_a"), F.col("_b")), 6)).where(F.col("dice") >= least).select(key, other, "dice")
