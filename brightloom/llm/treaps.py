"""Ranked lexical search with an inverted treap per term.

The index has a row for each term and shard, a shard being some megabytes of neighbouring documents. The
row is a treap: its search order is the document, its heap order the impact, of equal impacts the earlier
document first. Its postings are stored by document, so each subtree is a slice and so is the part of it in
any range; its shape is stored as the sizes of left subtrees in preorder.

A search walks the treaps of an item's terms through one range of documents at a time. In a range, each
term stands at its highest node there; the weighted sum of those impacts bounds every score in the range,
so the range is dropped once that is under the tenth score so far. Else it is split at the document of the
heaviest node, and ranges with few postings are added up at once. The best range comes first. Each shard
gives its ten best for an item, and a ranked window merges them.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import cut

#: Bytes of text of a shard (or one longer text), and items of a block.
SHARD, BLOCK = 10 << 20, 512
#: A range of at most so many postings is added up at once.
FEW = 4096
TOP = 10
#: Bytes that belong to no term are spaces, and A-Z are a-z.
TERMS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
INDEX = "shard string, term string, postings long, documents binary, impacts binary, lefts binary"
FOUND = "item long, doc_id long, score long, added long"


class Words(dict):
    """Word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def greater_left(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest larger one to its left within its segment, else the place
    before the segment. ``values`` are distinct within a segment; ``starts`` has the segment's first place."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= starts)
    while True:
        open_ = open_[at[open_] >= starts[open_]]
        open_ = open_[values[at[open_]] < values[open_]]
        if not len(open_):
            return np.maximum(at, starts - 1)
        at[open_] = at[at[open_]]  # what the smaller one skips, this one skips as well


def preorder(impacts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of postings in document order, by segment: their places in the treaps' preorder and the sizes of
    their left subtrees."""
    n = len(impacts)
    places = np.arange(n)
    heap = (impacts << 32) - (places - starts)  # of equal impacts the earlier one is higher
    left = greater_left(heap, starts)
    right = n - 1 - greater_left(heap[::-1], (n - ends)[::-1])[::-1]
    # Ancestors to the right are the chain of nearest larger ones; counted by doubling.
    above, step = np.where(right < ends, 1, 0), np.where(right < ends, right, places)
    while True:
        more = above[step]
        if not more.any():
            break
        above, step = above + more, step[step]
    return left + 1 + above, places - left - 1


def shard_rows(texts: list[bytes], ids: list, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The treaps of a shard's documents, and a row of the empty term with their ids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    words, parts, lengths = Words(), [], np.zeros(len(order), np.int64)
    for place, i in enumerate(order):
        found = np.fromiter(map(words.__getitem__, texts[i].split()), np.int64)
        texts[i] = b""
        lengths[place] = len(found)
        parts.append(found << 32 | place)
    norm = 10 + (90 * lengths * documents) // max(terms, 1)
    pairs = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    del parts
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(pairs)])
    pairs = pairs[first]
    places, numbers = pairs & 0xFFFFFFFF, pairs >> 32
    impacts = (1_000_000_000 * times) // (1000 * times + 8 * norm[places])
    counts = np.bincount(numbers, minlength=len(words))
    ends = np.cumsum(counts)
    starts = np.repeat(ends - counts, counts)
    to, sizes = preorder(impacts, starts, np.repeat(ends, counts))
    lefts = np.empty(len(places), "<i4")
    lefts[to] = sizes
    columns = [places.astype("<i4"), impacts.astype("<i4"), lefts]
    shard = uuid.uuid4().hex
    kept = np.array([-1 if ids[i] is None else ids[i] for i in order], "<i8")
    nulls = np.array([ids[i] is None for i in order], np.uint8)
    yield _batch(shard, pa.array([""]), np.array([len(order)]), [pa.array([kept.tobytes()]), pa.array([nulls.tobytes()]), pa.array([b""])])
    names = list(words)
    for a in range(0, len(names), 50_000):
        b = min(a + 50_000, len(names))
        low, high = (ends[a - 1] if a else 0), ends[b - 1]
        offsets = (np.r_[low, ends[a:b]] - low).astype(np.int32) * 4
        slices = [pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(c[low:high].tobytes())]) for c in columns]
        yield _batch(shard, pa.array(names[a:b], pa.binary()).cast(pa.string()), counts[a:b], slices)


def _batch(shard: str, terms: pa.Array, counts: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
    names = ["shard", "term", "postings", "documents", "impacts", "lefts"]
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(terms)), terms, pa.array(counts, pa.int64()), *columns], names=names)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len((text.as_py() or "").encode().translate(TERMS).split())
                documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    row = docs.select(F.col("text").cast("string")).mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame) -> DataFrame:
    """The treaps of all terms of ``docs`` as rows of ``INDEX``, written to the shared folder. Null ids are
    ids after all others; null and empty texts have no terms; repeated rows are documents of their own;
    other columns are ignored. A task holds the words of one shard."""
    documents, terms = statistics(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode().translate(TERMS)
                if data.isspace() or not data:
                    continue
                if texts and size + len(data) > SHARD:
                    yield from shard_rows(texts, ids, documents, terms)
                    texts, ids, size = [], [], 0
                texts.append(data)
                ids.append(i)
                size += len(data)
        if texts:
            yield from shard_rows(texts, ids, documents, terms)

    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX), "treaps")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: runs of digits, letters and all beyond ASCII, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


class Treap:
    """One term's treap in a shard."""

    __slots__ = ("documents", "impacts", "key", "left", "top", "weight")

    def __init__(self, weight: int, documents: bytes, impacts: bytes, lefts: bytes) -> None:
        self.weight = weight
        self.documents, self.impacts = np.frombuffer(documents, "<i4"), np.frombuffer(impacts, "<i4").astype(np.int64) * weight
        self.key, self.top, self.left = memoryview(documents).cast("i"), memoryview(self.impacts), memoryview(lefts).cast("i")


def best_of_shard(treaps: list[Treap], count: int, least: int, most: int = TOP) -> tuple[list[tuple[int, int]], int]:
    """The ``most`` best (score, -document) of a shard of ``count`` documents with scores of ``least`` or
    more, and how many postings were added up."""
    best: list[tuple[int, int]] = []
    added, serial = 0, 0

    def enough() -> int:
        return max(least, best[0][0]) if len(best) == most else least

    def ranged(nodes: list[tuple[Treap, int, int, int]], low: int, high: int) -> None:
        """Put the range of documents low..high with each term's highest node there: its place in
        preorder and the slice of its subtree."""
        nonlocal serial
        kept, bound, postings = [], 0, 0
        for t, at, a, b in nodes:
            key, left = t.key, t.left
            inside = bisect_right(key, high, a, b) - bisect_left(key, low, a, b)
            if not inside:
                continue
            while not low <= (d := key[middle := a + left[at]]) <= high:
                if d < low:
                    at, a = at + 1 + left[at], middle + 1
                else:
                    at, b = at + 1, middle
            kept.append((t, at, a, b))
            bound += t.top[middle]
            postings += inside
        if kept and bound >= enough():
            serial += 1
            heapq.heappush(ranges, (-bound, serial, low, high, postings, kept))

    ranges: list = []
    ranged([(t, 0, 0, len(t.key)) for t in treaps], 0, count - 1)
    while ranges and -ranges[0][0] >= enough():
        _, _, low, high, postings, nodes = heapq.heappop(ranges)
        if postings > FEW and low < high:
            t, at, a, _ = max(nodes, key=lambda node: node[0].top[node[2] + node[0].left[node[1]]])
            middle = t.key[a + t.left[at]]
            for first, last in ((low, middle - 1), (middle, middle), (middle + 1, high)):
                if first <= last:
                    ranged(nodes, first, last)
            continue
        added += postings
        slices = [(t, bisect_left(t.key, low, a, b), bisect_right(t.key, high, a, b)) for t, _, a, b in nodes]
        documents = np.concatenate([t.documents[a:b] for t, a, b in slices])
        order = np.argsort(documents, kind="stable")
        documents = documents[order]
        starts = np.flatnonzero(np.r_[True, documents[1:] != documents[:-1]])
        scores = np.add.reduceat(np.concatenate([t.impacts[a:b] for t, a, b in slices])[order], starts)
        reach = np.flatnonzero(scores >= enough())
        for entry in zip(scores[reach].tolist(), (-documents[starts[reach]].astype(np.int64)).tolist(), strict=True):
            if len(best) < most:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return best, added


def search(index: DataFrame, items: DataFrame, documents: int | None = None, most: int = TOP) -> DataFrame:
    """Each item's ``most`` best documents by the treaps of ``index``: item_id, rank, doc_id, score, and
    ``added``, the postings that were added up for the item in the shards that gave a row. Equal (item_id, text) are one item; null and
    termless texts give no rows. ``items`` goes through in blocks of about ``BLOCK`` items a shard."""
    spark = index.sparkSession
    documents = index.where(F.col("term") == "").agg(F.sum("postings")).first()[0] or 0 if documents is None else documents
    asked = cut(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-asked.count() // BLOCK))
    words = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.explode(terms_of(F.col("text"))).alias("term"))
    by_term = words.groupBy("term", "block").agg(F.collect_list("item").alias("wanted"))  # at most about BLOCK items
    frequency = index.join(words.select("term").distinct(), "term").groupBy("term").agg(F.sum("postings").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1)))
    weighed = by_term.join(frequency.select("term", weight.cast("long").alias("weight")), "term")
    heads = spark.range(blocks).select(F.lit("").alias("term"), F.col("id").cast("int").alias("block"), F.array().cast("array<long>").alias("wanted"), F.lit(0).cast("long").alias("weight"))
    weighed = cut(weighed.unionByName(heads), "weighed")
    parts = index.join(weighed, "term").select("shard", "block", "term", "weight", "wanted", "postings", "documents", "impacts", "lefts")
    parts = parts.repartition("shard", "block").sortWithinPartitions("shard", "block", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[int]] = defaultdict(list)  # an item's best scores in this task's shards

        def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            ids, nulls = np.frombuffer(rows[0][4], "<i8"), np.frombuffer(rows[0][5], np.uint8)
            by_item: dict[int, list[Treap]] = defaultdict(list)
            for _, w, wanted, _, *blobs in rows[1:]:
                treap = Treap(w, *blobs) if w else None
                for item in wanted if treap else ():
                    by_item[item].append(treap)
            out: list[tuple] = []
            for item, treaps in by_item.items():
                scores = least[item]
                best, added = best_of_shard(treaps, len(ids), scores[0] if len(scores) == most else 1, most)
                for score, document in best:
                    (heapq.heappush if len(scores) < most else heapq.heappushpop)(scores, score)
                    out.append((item, None if nulls[-document] else int(ids[-document]), score, added))
            names = ["item", "doc_id", "score", "added"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=names)

        rows, group = [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            values = [batch.column(k).to_pylist() for k in range(2, 9)]
            for k, key in enumerate(keys):
                if key != group and rows:
                    yield from found(rows)
                    rows = []
                group = key
                rows.append(tuple(v[k] for v in values))
        if rows:
            yield from found(rows)

    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = parts.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)
    return top.join(asked, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "added")


def search_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index all documents and search them for each item; see ``build_index`` and ``search``."""
    return search(build_index(docs), items).drop("added")


#: The same ranks by counting all postings, for DuckDB.
ORACLE = """
WITH words AS (SELECT doc_id, d.rowid_ AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) d),
totals AS (SELECT count(DISTINCT doc) AS n_docs, count(*) AS n_terms FROM words),
lengths AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
asked AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)))),
postings AS (SELECT doc_id, doc, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, doc, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
scores AS (SELECT item, item_id, doc_id, doc, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc), totals GROUP BY item, item_id, doc_id, doc)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
