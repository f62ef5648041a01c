"""Top-k search over a persisted inverted index with impact bounds per block.

A block is a run of rows of one task. An index row holds one term's postings in one block, packed, with the
best that any of them can add; what doesn't depend on the query is summed up when the index is built. A search bounds every (query, block) from those rows alone, scores the blocks with the
best bounds, and then only such blocks whose bound reaches the k-th score found: the rest can't have a
result. A query word may be any part of a term, so words are first looked up in the vocabulary.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as tx
from .lexicon import occurrences
from .linkage import new_path, written

#: Concepts of a block, at most, and blocks of a query that are scored first.
BLOCK, FIRST = 1024, 4
#: A posting is eight times the concept's place in its block, plus these.
BEGINS, LABEL, WORD = 1, 2, 4
#: Words of a concept, as T04 counts them.
WORDS = 48


@dataclass(frozen=True)
class Weights:
    """What a query word adds: if the label begins with it, if it is within the label, if it is within any
    term, and if it is one of the concept's words; whether the best or the sum of these counts; whether
    every word must be there; and what a label adds that equals the query, or begins with it."""

    begins: int
    label: int
    any: int
    word: int
    adds: bool
    all: bool
    equal: int = 0
    phrase: int = 0
    least: int | None = None


#: Fixed values.
INDEX_SEARCH = Weights(begins=12, label=0, any=4, word=6, adds=True, all=False, least=1)
BROWSER_SEARCH = Weights(begins=55, label=34, any=16, word=0, adds=False, all=True, equal=180, phrase=30)


def terms(text: Column) -> Column:
    """The runs of a-z and 0-9 of a folded text."""
    return F.regexp_extract_all(tx.fold(text), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass(frozen=True)
class Index:
    """A written index: ``postings`` by term and block, and ``concepts`` by key."""

    postings: DataFrame
    concepts: DataFrame


def write_index(concepts: DataFrame, key: str, label: str, text: str, extra: Column, path: str | None = None) -> Index:
    """Index concepts by the terms of ``text``, with ``extra`` (a number) added to each of their scores,
    under ``path`` (a folder of its own, else one in the shared folder). A null or repeated key is a
    concept like any other; null labels and texts have no terms.

    Texts travel to their blocks once, as they are; their terms are listed and grouped there.
    """
    spark = concepts.sparkSession
    path = path or new_path(spark)
    rows = concepts.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.coalesce(tx.fold(label), F.lit("")).alias("label"), F.coalesce(tx.fold(F.col(text).cast("string")), F.lit("")).alias("text"), F.coalesce(extra.cast("double"), F.lit(0.0)).alias("extra"))
    rows.write.parquet(f"{path}/.made")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/.made").withColumns({"block": F.floor(F.col("id") / BLOCK), "offset": (F.col("id") % BLOCK).cast("int")})
    order = F.row_number().over(Window.partitionBy("block").orderBy("key", "id"))
    rows.drop("text").withColumn("place", order).write.parquet(f"{path}/concepts")
    here = rows.select("block", "offset", "extra", "label", "text").repartition(max(1, min(1 << 14, -(-rows.count() // (2 * BLOCK)))), "block")
    own = F.array_remove(F.array_distinct(F.split("text", "[^a-z0-9]+")), "")
    begins = F.regexp_extract("label", "^[a-z0-9]+", 0)
    # The lists are made before the rows are exploded: what stands beside explode() is worked out for each of its rows.
    listed = here.select("block", "offset", "extra", terms(F.col("label")).alias("of_label"), begins.alias("begins"), own.alias("own"))
    # T04's words are the first so many terms of two characters or more: those before a place.
    words = F.slice(F.filter("own", lambda x: F.length(x) > 1), 1, WORDS)
    listed = listed.select("block", "offset", "extra", "of_label", "begins", F.when(F.size(words) == WORDS, F.array_position("own", F.element_at(words, -1))).otherwise(F.size("own")).alias("end"), F.array_union("own", "of_label").alias("terms"))
    posted = listed.select("block", "offset", "extra", "of_label", "begins", "end", F.posexplode("terms").alias("at", "term"))
    flags = posted.select("term", "block", "offset", "extra", (F.col("begins") == F.col("term")).alias("begins"), F.array_contains("of_label", F.col("term")).alias("label"), ((F.col("at") < F.col("end")) & (F.length("term") > 1)).alias("word"))
    bits = F.col("begins").cast("int") * BEGINS + F.col("label").cast("int") * LABEL + F.col("word").cast("int") * WORD
    grouped = flags.groupBy("block", "term").agg(
        F.collect_list(F.col("offset") * 8 + bits).alias("postings"), F.max("extra").alias("extra"), F.bool_or("begins").alias("begins"), F.bool_or("label").alias("label"), F.bool_or("word").alias("word"))
    grouped.sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/.made")
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(made, True)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/concepts"))


def _adds(w: Weights, begins: Column, label: Column, word: Column) -> Column:
    if w.adds:
        return F.when(begins, w.begins).otherwise(0) + F.when(label, w.label).otherwise(0) + w.any + F.when(word, w.word).otherwise(0)
    return F.when(begins, w.begins).when(label, w.label).otherwise(w.any) + F.when(word, w.word).otherwise(0)


def _best(lists: pa.Table, blocks: pa.Table, k: int, w: Weights) -> list[tuple]:
    """(query, id, score) of the ``k`` best concepts of one block for each of its queries."""
    (block,) = blocks.select(["concepts", "asked"]).to_pylist()
    offsets, ids, names, extra, places = (np.array([c[n] for c in block["concepts"]], kind) for n, kind in (("offset", int), ("id", int), ("label", object), ("extra", float), ("place", int)))
    size = int(offsets.max()) + 1
    t = lists.column("t").combine_chunks().dictionary_encode()
    postings = lists.column("postings").combine_chunks()
    n = np.diff(postings.offsets.to_numpy())
    values, row = postings.flatten().to_numpy(), np.repeat(t.indices.to_numpy(), n).astype(np.int64)
    table = np.zeros((len(t.dictionary), size), np.uint8)
    bits = (values & np.repeat(lists.column("flags").to_numpy(), n) | 8).astype(np.uint8)  # 8: the word is there
    np.bitwise_or.at(table.ravel(), row * size + (values >> 3), bits)
    flags = dict(zip(t.dictionary.to_pylist(), table[:, offsets], strict=True))
    adds = {t: np.where(f & 8, _added(w, f), 0) for t, f in flags.items()}
    by_name = sorted(range(len(names)), key=names.__getitem__)
    sorted_names = [names[i] for i in by_name]
    out = []
    for asked in block["asked"]:
        words = [t for t in asked["words"] if t in flags]
        there = sum((flags[t] >> 3).astype(np.int64) for t in words)
        hits = np.flatnonzero(there == len(asked["words"]) if w.all else there) if words else np.zeros(0, np.int64)
        if not len(hits):
            continue
        phrase, bonus = asked["phrase"], np.zeros(len(names), np.int64)
        for at in range(bisect_left(sorted_names, phrase), len(names)):
            if not sorted_names[at].startswith(phrase):
                break
            bonus[by_name[at]] = w.equal if sorted_names[at] == phrase else w.phrase
        score = sum(adds[t][hits] for t in words) + extra[hits] + bonus[hits]
        if w.least is not None:
            score = np.maximum(score, float(w.least))
        first = np.lexsort((places[hits], -score))[:k]
        out += zip([asked["q"]] * len(first), ids[hits[first]].tolist(), score[first].tolist(), strict=True)
    return out


def _added(w: Weights, flags: np.ndarray) -> np.ndarray:
    begins, label, word = flags & BEGINS > 0, flags & LABEL > 0, (flags & WORD > 0) * w.word
    return begins * w.begins + label * w.label + w.any + word if w.adds else np.where(begins, w.begins, np.where(label, w.label, w.any)) + word


def search(index: Index, queries: DataFrame, query_id: str, text: str, k: int, weights: Weights = INDEX_SEARCH, stop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best concepts of each query as ``query_id, rank, key, score`` (equal scores by key), and for
    each query how many blocks hold a match and how many were read (``blocks, read``).

    A query's words are those of T04, without ``stop``; queries without one give no rows. Query ids are
    distinct. Each distinct word is looked up once, however many queries have it.
    """
    w = weights
    asked = queries.select(F.col(query_id).alias("q"), F.coalesce(tx.fold(text), F.lit("")).alias("phrase"), tx.tokens(text, stop).alias("words")).where(F.size("words") > 0)
    # Where the phrase doesn't begin with the first word, any label might begin with the phrase.
    asked = written(asked.withColumn("open", F.regexp_extract("phrase", "^[a-z0-9]+", 0) != F.get("words", F.lit(0))))
    words = asked.select("q", "open", F.posexplode("words").alias("place", "t"))
    vocabulary = index.postings.select("term").distinct()
    parts = written(occurrences(vocabulary.withColumn("v", F.col("term")), "v", "term", words.select("t").distinct(), "t").toDF("term", "t"))
    same, starts = F.col("term") == F.col("t"), F.startswith("term", F.col("t"))
    of_block = parts.join(index.postings.drop("postings"), "term").groupBy("t", "block").agg(F.bool_or(starts & F.col("begins")).alias("begins"), F.bool_or("label").alias("label"), F.bool_or(same & F.col("word")).alias("word"), F.max("extra").alias("extra"))
    bound = words.join(written(of_block), "t")
    more = F.when(F.col("begins") & (F.col("place") == 0) | F.col("open"), max(w.equal, w.phrase)).otherwise(0)
    bounds = bound.groupBy("q", "block").agg((F.sum(_adds(w, F.col("begins"), F.col("label"), F.col("word"))) + F.max(more)).alias("adds"), F.max("extra").alias("extra"), F.count("*").alias("n"))
    if w.all:
        bounds = bounds.join(asked.select("q", F.size("words").alias("all")), "q").where(F.col("n") == F.col("all"))
    ceiling = F.col("adds") + F.col("extra") if w.least is None else F.greatest(F.col("adds") + F.col("extra"), F.lit(float(w.least)))
    bounds = written(bounds.select("q", "block", ceiling.alias("bound")))

    held = index.concepts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "label", "extra", "place"))).alias("concepts"))
    with_words = asked.select("q", F.struct("q", "phrase", "words").alias("asked"))
    schema = StructType([asked.schema["q"], StructField("id", LongType()), StructField("score", DoubleType())])
    kind = to_arrow_type(asked.schema["q"].dataType)

    def run(lists: pa.Table, blocks: pa.Table) -> pa.Table:
        found = _best(lists, blocks, k, w) if blocks.num_rows else []
        q, ids, scores = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"q": pa.array(q, kind), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    def scored(chosen: DataFrame) -> DataFrame:
        """The best of each chosen (query, block): a block's postings of asked terms, its concepts and its
        queries meet in one task."""
        by_block = chosen.select("q", "block").join(with_words, "q").groupBy("block").agg(F.collect_list("asked").alias("asked"))
        flags = F.when(same, BEGINS + LABEL + WORD).when(starts, BEGINS + LABEL).otherwise(LABEL)
        lists = parts.select("term", "t", flags.alias("flags")).join(index.postings.select("term", "block", "postings"), "term").select("block", "t", "flags", "postings")
        lists = lists.join(chosen.select("block").distinct(), "block", "left_semi")
        best = lists.groupBy("block").cogroup(by_block.join(held, "block").groupBy("block")).applyInArrow(run, schema)
        return best.join(index.concepts.select("id", "key"), "id").select("q", "id", "key", "score")

    top = Window.partitionBy("q").orderBy(F.desc("score"), "key", "id")
    first = written(bounds.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))).where(F.col("n") <= FIRST).drop("n"))
    best = written(scored(first).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k))
    reached = best.where(F.col("rank") == k).select("q", F.col("score").alias("reached"))
    rest = written(bounds.join(first.select("q", "block"), ["q", "block"], "left_anti").join(reached, "q", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached"))).drop("reached"))
    found = best.drop("rank").unionByName(scored(rest)).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    read = first.unionByName(rest).groupBy("q").agg(F.count("*").alias("read"))
    report = bounds.groupBy("q").agg(F.count("*").alias("blocks")).join(read, "q", "left").select(F.col("q").alias(query_id), "blocks", F.coalesce("read", F.lit(0)).alias("read"))
    return found.select(F.col("q").alias(query_id), "rank", "key", "score"), report
