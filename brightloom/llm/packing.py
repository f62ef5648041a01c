"""Best-fit packing of token sequences, in bulk-synchronous rounds over sizes.

Documents of one size are interchangeable, and so are gaps of one size. A round therefore takes all
documents of one size (largest first) and sweeps the gaps upwards from their successor, the smallest gap
that holds the size: the document of rank r goes to gap number r // k of that sweep, where k documents
of the size fit into a gap, so no two documents ask for the same place. Gaps then shrink and move down
to their new size. What a sweep needs is one count per size, at most ``capacity`` numbers; the result is
a table of rank intervals. The documents themselves never leave the executors: their ranks inside a size
come from a salted window, and one join with the intervals tells each its sequence and offset. The
outcome equals best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_pass, cut, free
from .encoding import pieces, tokenizer_path

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids; a null or empty text is the end id alone."""

    def rows(columns: list[list]) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        encode = pieces(path).encode
        for doc, text in zip(*columns, strict=True):
            ids = np.append(encode(text or ""), np.array([end_id], "<u4"))
            for n, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                for k, v in zip(out, (doc, n, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    out[k].append(v)
        return out

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), PIECES, rows)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds from the largest size down. Returns (size, first rank, end rank, documents a gap, first
    sequence, offset): ranks count inside a size; a gap's documents lie one after the other."""
    plan, gaps, sizes, sequences = [], {}, [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(sizes, size)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, each = capacity, capacity // size
                first, n = sequences, -(-left // each)
                sequences += n
            each = gap // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, rank + full * each, each, first, capacity - gap))
                put(gap - each * size, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                plan.append((size, rank, rank + left, left, first, capacity - gap))
                put(gap - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(gap, first, n)
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length, ids_crc32``.

    ``length`` lies in 1..capacity. Equal rows are told apart by rank only, which is harmless: they are
    interchangeable. An empty table gives an empty result. Columns that ``items`` has already by the names of
    the new ones are replaced; all others stay.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    salt, rank, before = free(items, "_salt", "_rank", "_before")
    salts = min(4096, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salted = items.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = cut(salted.groupBy("length", salt).agg(F.count("*").alias("n")), "sizes")
    counts = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy(salt)) - F.col("n")
    groups = groups.select("length", salt, earlier.alias(before))
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn(rank, within - 1).join(groups, ["length", salt]).withColumn(rank, F.col(rank) + F.col(before))
    plan = spark.createDataFrame(sweep(counts, capacity), "length long, lo long, hi long, each long, first long, base long")
    p, r = plan.alias("p"), ranked.alias("r")
    # The plan has a few rows for each size, whatever the number of documents.
    placed = r.join(F.broadcast(p), (F.col("r.length") == F.col("p.length")) & (F.col(f"r.{rank}") >= F.col("p.lo")) & (F.col(f"r.{rank}") < F.col("p.hi")))
    turn = F.col(f"r.{rank}") - F.col("p.lo")
    return placed.select(
        *[F.col(f"r.{c}") for c in items.columns],
        (F.col("p.first") + F.floor(turn / F.col("p.each"))).alias("sequence_id"),
        (F.col("p.base") + turn % F.col("p.each") * F.col("r.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: ids by the vocabulary file at ``path``, then one end id; longer documents are
    cut into pieces of ``capacity``. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed each;
    columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    items = cut(token_pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity), "pieces")
    return pack(items, capacity)
