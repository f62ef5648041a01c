"""Token-id store: one concatenated id array per shard, with Elias-Fano coded document boundaries.

A shard is one row of a Parquet table, so any file system that Spark writes to will do:

* ``ids``: all ids of the shard's documents, little-endian, 16 bits each if the vocabulary allows, else 32;
* ``ends_*``: the Elias-Fano code of each document's end in ``ids``;
* ``docs_*``: the Elias-Fano code of the ascending document ids less ``first_doc``; null ids come first
  and are only counted;
* ``part, shard, part_start``: place in document order; ``part_start`` ids lie before it in its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_path
from .encoding import pieces, tokenizer_path

END_ID = 0
SHARD_IDS = 1 << 21
SAMPLE = 64


@dataclass
class EliasFano:
    """A non-decreasing sequence of n numbers below u in n * (2 + log2(u / n)) bits, about.

    Each number's low bits lie side by side; its high part plus its index is the place of a one in
    ``high``. ``samples`` has the place of each ``SAMPLE``-th one, from which select() goes on.
    """

    n: int
    width: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, (int(values[-1]) + 1) // n).bit_length() - 1
        width = max(0, width)
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Number ``i`` of the sequence, without decoding the others."""
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return ((place - i) << self.width) | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.width
        part = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3], "little")
        return part >> (first & 7) & ((1 << self.width) - 1)

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
        low = bits.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return (high << self.width) | low


CODE = [("n", pa.int64()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())]
SHARDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("n_null", pa.int64()), ("first_doc", pa.int64())]
    + [(f"{name}_{k}", t) for name in ("ends", "docs") for k, t in CODE]
)
SHARDS_DDL = ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long', 'binary': 'binary'})[str(f.type)]}" for f in SHARDS)


def write_tokens(docs: DataFrame, to: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text (null: empty), append ``end_id``, and write shards in ascending doc_id order.

    Rows of one doc_id (repeated rows, null ids) are ordered by a hash of the text. A shard is closed
    once it holds ``shard_ids`` ids, so a task's memory is bounded by that and its longest document.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, part = pieces(path), TaskContext.get().partitionId()
        kind = "<u2" if max(end_id, lookup.whole.get_vocab_size()) < 1 << 16 else "<u4"
        shard, before, ids, ends, names, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard, before, ids, ends, names, size
            known = [x for x in names if x is not None]
            first = known[0] if known else 0
            row = {"part": part, "shard": shard, "part_start": before, "n_ids": size, "id_bytes": int(kind[2]), "ids": b"".join(ids), "n_null": len(names) - len(known), "first_doc": first}
            for name, values in (("ends", ends), ("docs", [x - first for x in known])):
                row |= {f"{name}_{k}": v for k, v in vars(EliasFano.encode(np.array(values, np.uint64))).items()}
            shard, before, ids, ends, names, size = shard + 1, before + size, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=SHARDS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = lookup.encode(text)
                ids += [found.astype(kind).tobytes(), np.array([end_id], kind).tobytes()]
                size += len(found) + 1
                ends.append(size)
                names.append(doc)
                if size >= shard_ids:
                    yield close()
        if names:
            yield close()

    ordered.mapInArrow(run, SHARDS_DDL).write.parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS_DDL).parquet(at)
    # One row for each part that wrote shards, as many as there were shuffle partitions.
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code = {name: EliasFano(*[row[f"{name}_{k}"] for k, _ in CODE]) for name in ("ends", "docs")}
                # Each document is looked up by itself: its end, and the end before, by select().
                n, end, name = code["ends"].n, code["ends"].select, code["docs"].select
                ends = np.array([end(i) for i in range(n)], np.int64)
                begins = np.array([end(i - 1) if i else 0 for i in range(n)], np.int64)
                names = [None] * row["n_null"] + [name(i) + row["first_doc"] for i in range(code["docs"].n)]
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                sums = [zlib.crc32(ids[a:b].astype("<u4").data) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.full(n, row["part"]), pa.int32()), (names, pa.int64()), (begins + row["part_start"], pa.int64()), (ends - begins, pa.int64()), (sums, pa.int64()))], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    read = shards.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_documents(docs: DataFrame, path: str | None = None, to: str | None = None) -> DataFrame:
    """Write the store of ``docs`` (to ``to``, else a new folder in the shared one) and read it back.

    An empty table gives an empty store and no rows; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    to = to or new_path(spark, "tokens")
    write_tokens(docs, to, path or tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, to)
