"""Contains joins of texts with a lexicon that is a table.

The lexicon goes through in blocks of bounded size. A block is sent to all tasks, which build one automaton
over its words and read each text once, whatever the lexicon's size; a plan has no expression per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .linkage import written

#: Words and characters of a block, about (by hash), or one longer word.
WORDS, CHARACTERS = 1 << 17, 8 << 20


@lru_cache(maxsize=1)
def _automaton(name: str, words: Callable[[], list[tuple[str, object]]]):
    """One automaton per worker, that of the block that it met last."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, value in words():
        a.add_word(word, value)
    a.make_automaton()
    return a


class _Block:
    """The words of a block in a broadcast, equal to itself wherever it is unpickled."""

    def __init__(self, broadcast, name: str) -> None:
        self.broadcast, self.name = broadcast, name

    def __call__(self) -> list[tuple[str, object]]:
        return self.broadcast.value

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return isinstance(other, _Block) and other.name == self.name

    def automaton(self):
        return _automaton(self.name, self)


def _blocks(words: DataFrame) -> Iterator[_Block]:
    """Blocks of (word, value) rows; words are distinct and not empty."""
    words = written(words)
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    count = max(1, -(-n // WORDS), -(-size // CHARACTERS))
    for k in range(count):
        rows = [(r.word, r.value) for r in words.where(F.pmod(F.xxhash64("word"), F.lit(count)) == k).collect()]  # one block
        if rows:
            yield _Block(words.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex)


def first_contained(df: DataFrame, text: str, lexicon: DataFrame, name: str = "label") -> DataFrame:
    """The ``label`` of the lexicon's first word, by ``place``, that the text contains, in any case.

    ``lexicon`` has ``word``, ``label`` and ``place`` (a whole number). Of equal places the smaller word
    counts; the empty word is in every text; null words, and null texts, match nothing.
    """
    low = lexicon.where("word IS NOT NULL").select(F.lower("word").alias("word"), F.struct(F.col("place").cast("long").alias("place"), F.lower("word").alias("w"), F.col("label").cast("string").alias("label")).alias("entry"))
    best = low.groupBy("word").agg(F.min("entry").alias("entry"))
    empty = best.where("word = ''").select("entry.*").first()
    least = F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(("place", "w", "label"), ("long", "string", "string"), empty or (None, None, None), strict=True)])
    out = df.select(F.struct("*").alias("row"), least.alias("best"))
    schema, passed = out.schema, False
    for block in _blocks(best.where("word <> ''").select("word", F.struct("entry.place", "entry.w", "entry.label").alias("value"))):

        def run(batches: Iterator[pa.RecordBatch], block: _Block = block) -> Iterator[pa.RecordBatch]:
            find = block.automaton().iter
            for batch in batches:
                best = []
                for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    least = None if b["place"] is None else (b["place"], b["w"], b["label"])
                    for _, value in find(t or ""):
                        if least is None or (value[0], value[1]) < least[:2]:
                            least = tuple(value)
                    best.append(dict(zip(("place", "w", "label"), least or (None, None, None), strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, batch.schema.field(2).type)], names=["row", "best"])

        if passed:  # one automaton at a time; a lexicon of one block writes nothing
            out = written(out)
        out, passed = out.select("row", F.lower(F.col("row")[text].cast("string")).alias("text"), "best").mapInArrow(run, schema), True
    label = F.when(F.col("row")[text].isNotNull(), F.col("best.label"))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], label.alias(name))


def occurrences(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """Each text's ``key`` with each distinct word that it contains as ``word``, by characters as they are.
    The empty word is in every text that isn't null; null words are in none."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    distinct = words.where(F.col(word).isNotNull()).select(F.col(word).cast("string").alias("word"), F.lit(0).alias("value")).distinct()
    out = rows.where(F.lit(not distinct.where("word = ''").isEmpty())).select("key", F.lit("").alias("word"))
    schema = StructType([rows.schema["key"], StructField("words", ArrayType(StringType()))])
    for block in _blocks(distinct.where("word <> ''").select("word", F.col("word").alias("value"))):

        def run(batches: Iterator[pa.RecordBatch], block: _Block = block) -> Iterator[pa.RecordBatch]:
            find = block.automaton().iter
            for batch in batches:
                found = [sorted({w for _, w in find(t)}) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["key", "words"])

        out = out.unionByName(rows.mapInArrow(run, schema).select("key", F.explode("words").alias("word")))
    return out.select(F.col("key").alias(key), "word")


def contained_either_way(df: DataFrame, key: str, text: str, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Each row's ``key`` with all distinct words that its text contains or is contained in, in any
    case, as ``key, word``. Only texts no longer than the longest word can be in one: those are words to
    look for in the lexicon. Rows whose keys and texts are equal count once."""
    low = df.select(key, F.lower(F.col(text).cast("string")).alias("_text")).where("_text IS NOT NULL").distinct()
    words = lexicon.select(F.lower(F.col(word).cast("string")).alias("word")).where("word IS NOT NULL").distinct()
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    short = low.where(F.length("_text") <= longest)
    inside = occurrences(words.withColumn("w", F.col("word")), "w", "word", short.select("_text"), "_text").toDF("word", "_text")
    ways = occurrences(low, key, "_text", words, "word").unionByName(short.join(inside, "_text").select(key, "word"))
    return ways.distinct()
