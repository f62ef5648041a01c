"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints within d bits of each other, cut into m parts, agree within t_i bits in some part i as long
as the sum of the (t_i + 1) is d + 1; a part with t_i = -1 is not probed. So

1. bits that vary together are put into one part, which makes some parts poor and others selective;
2. each fingerprint gets its own thresholds, by dynamic programming over parts on the number of
   candidates that the parts' histograms predict for its own values;
3. a fingerprint is indexed by its value in every part and probes, in each part, the values within its
   threshold there; candidates of equal value are verified on all 64 bits.

Equal fingerprints are one row throughout. Where many distinct fingerprints share a value, both sides
are dealt to blocks, so a task compares two blocks at most; a block gives a spanning forest of its links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_pass, cut, free
from .components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Rows of one side that a task compares at once.
BLOCK = 2048
#: Bits of a part's value that its histogram keeps, so that one has at most 2 ** 16 counts.
HISTOGRAM_BITS = 16
#: Values of wider parts whose own counts are broadcast, the most common ones first; any other value has at
#: most one fingerprint in so many.
HOT_VALUES = 1 << 14


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64 values; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 2:
        return digest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[: n - 1]).tolist()
    hashes = np.fromiter((digest(text[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *others: F.Column) -> DataFrame:
    """``doc_id long, fp long`` (the 64 bits as a signed number) of every text (null or empty: 0), and
    other columns of type long."""
    names = [f"_{i}" for i in range(len(others))]

    def rows(columns: list[list]) -> dict:
        fps = [fingerprint((t or "").encode().lower().split()) for t in columns[1]]
        return {"doc_id": columns[0], "fp": np.array(fps, np.uint64).view(np.int64)} | dict(zip(names, columns[2:], strict=True))

    needed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c.alias(n) for c, n in zip(others, names, strict=True)])
    return arrow_pass(needed, "doc_id long, fp long" + "".join(f", {n} long" for n in names), rows)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(fps: DataFrame, parts: int) -> list[list[int]]:
    """Bits 0..63 in ``parts`` groups of about equal size; bits that correlate share a group.

    Counts of all pairs of bits over all fingerprints: a 64 x 64 table from each task, added up in Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([*range(4096), -1], pa.int32()), pa.array([*total.ravel().astype(np.int64), n], pa.int64())], names=["cell", "n"])

    sums = {r["cell"]: r["n"] for r in fps.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = max(1, sums.get(-1, 0))
    both = np.array([sums.get(i, 0) for i in range(4096)], float).reshape(64, 64) / n
    share = np.diag(both)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs(both - np.outer(share, share)) / np.outer(spread, spread)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        # Begin with the least balanced bit, then add the bit that is closest to the group.
        group = [max(left, key=lambda b: (abs(share[b] - 0.5), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (close[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Each fingerprint's value in each part."""
    fps = fps.view(np.uint64)
    out = np.zeros((len(fps), len(groups)), np.int64)
    for g, bits in enumerate(groups):
        for k, b in enumerate(bits):
            out[:, g] |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _masks(width: int, most: int) -> list[np.ndarray]:
    """For t = 0..most: the masks of exactly t of ``width`` bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], np.int64) for t in range(most + 1)]


class Crowds:
    """How many fingerprints are indexed at a value of a part, and how many probe it.

    A part whose histogram keeps only its first bits has their counts spread evenly over the bits left out,
    but for the values in ``hot``, whose own counts are known.
    """

    def __init__(self, groups: list[list[int]], histograms: list[np.ndarray], hot: list[dict[int, int]]) -> None:
        self.histograms, self.kept, self.wide, self.low, self.reach, self.own, self.near = histograms, [], [], [], [], [], []
        for group, counts, of in zip(groups, histograms, hot, strict=True):
            kept = len(counts).bit_length() - 1
            self.kept.append(kept)
            self.wide.append(len(group) - kept)
            self.low.append((1 << kept) - 1)
            # Probes come from fingerprints of the value itself and of those one bit away (farther probes
            # are rare: thresholds over 1 cost hundreds of look-ups each).
            at = np.arange(len(counts))
            self.reach.append(counts * (1 + self.wide[-1]) + sum((counts[at ^ (1 << b)] for b in range(kept)), np.zeros_like(counts)))
            near: dict[int, int] = dict(of)
            for value, n in of.items():
                for b in range(len(group)):
                    near[value ^ (1 << b)] = near.get(value ^ (1 << b), 0) + n
            self.own.append(self._sorted(of))
            self.near.append(self._sorted(near))

    @staticmethod
    def _sorted(table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(table), np.int64)
        return keys, np.array([table[k] for k in keys.tolist()], np.int64)

    @staticmethod
    def _known(table: tuple[np.ndarray, np.ndarray], values: np.ndarray, expected: np.ndarray) -> np.ndarray:
        keys, counts = table
        if not len(keys):
            return expected
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, np.maximum(counts[at], expected), expected)

    def rows(self, g: int, values: np.ndarray) -> np.ndarray:
        return self._known(self.own[g], values, self.histograms[g][values & self.low[g]] >> self.wide[g])

    def probes(self, g: int, values: np.ndarray) -> np.ndarray:
        return self._known(self.near[g], values, self.reach[g][values & self.low[g]] >> self.wide[g])

    def blocks(self, g: int, values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Into how many blocks the indexed rows and the probes of each value are dealt."""
        rows, probes = (np.minimum(4095, 1 + n // block) for n in (self.rows(g, values), self.probes(g, values)))
        return rows, probes


def hot_values(fps: DataFrame, groups: list[list[int]], histograms: list[np.ndarray], block: int) -> list[dict[int, int]]:
    """For each part, its values that more than ``block`` fingerprints have, with their counts, if the
    histogram doesn't tell; at most ``HOT_VALUES`` in all, the most common ones."""
    out: list[dict[int, int]] = [{} for _ in groups]
    wide = [len(h) < 1 << len(g) for g, h in zip(groups, histograms, strict=True)]
    if not any(wide):
        return out
    shared = fps.sparkSession.sparkContext.broadcast(histograms)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch.column(0).to_numpy(zero_copy_only=False), groups)
            for g in range(len(groups)):
                if wide[g]:
                    own, counts = values[:, g], shared.value[g]
                    own = own[counts[own & (len(counts) - 1)] > block]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g), pa.int32()), pa.array(own, pa.int64())], names=["part", "value"])

    counts = fps.select("fp").mapInArrow(full, "part int, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
    for r in counts.where(F.col("n") > block).orderBy(F.desc("n"), "part", "value").limit(HOT_VALUES).collect():
        out[r["part"]][r["value"]] = r["n"]
    return out


def thresholds(values: np.ndarray, groups: list[list[int]], crowds: Crowds, bits: int) -> np.ndarray:
    """Thresholds of each fingerprint in each part, -1 (no probe) to ``bits``: the least expected number
    of candidates and probes such that the sum of the thresholds + 1 is ``bits`` + 1."""
    n, budget = len(values), bits + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((len(groups), n, budget + 1), np.int8)
    for g in range(len(groups)):
        wide, kept = crowds.wide[g], crowds.kept[g]
        # Candidates within t bits: the value's own count, and counts of the values within t bits of the
        # kept bits; the others are taken as spread evenly.
        counts = crowds.histograms[g]
        low = values[:, g] & crowds.low[g]
        cost, costs = np.zeros(n), [np.zeros(n)]
        for masks in _masks(kept, 1 if wide else bits)[: budget]:
            if len(masks) > 600:  # far probes: as many values of mean count
                cost = cost + len(masks) * (2 + counts.mean())
            else:
                for m in masks.tolist():
                    cost = cost + 2 + (counts[low ^ m] / (1 << wide) if m or not wide else crowds.rows(g, values[:, g]))
            costs.append(cost)
        while len(costs) < budget + 1:
            costs.append(costs[-1] * 16 + 1e6)
        new = np.full((n, budget + 1), np.inf)
        for used in range(budget + 1):
            for t in range(used + 1):
                total = best[:, used - t] + costs[t]
                better = total < new[:, used]
                new[better, used] = total[better]
                choice[g, better, used] = t
        best = new
    out, left = np.zeros((n, len(groups)), np.int64), np.full(n, budget)
    for g in range(len(groups) - 1, -1, -1):
        t = choice[g, np.arange(n), left].astype(np.int64)
        out[:, g] = t - 1
        left = left - t
    return out


def _forest(keys: np.ndarray, kinds: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: links between probes (kind 1) and indexed rows (kind 0) of equal key, as a
    spanning forest for each key."""
    from_, to = [], []
    bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)]
    sizes = np.diff(bounds)
    for a, size in zip(np.array(bounds[:-1])[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own, kind = fps[a : a + size], kinds[a : a + size]
        rows, probes = np.unique(own[kind == 0]), np.unique(own[kind == 1])
        if not len(rows) or not len(probes) or len(rows) == len(probes) == 1 and rows[0] == probes[0]:
            continue
        i_all, j_all = [], []
        for i in range(0, len(probes), BLOCK):
            for j in range(0, len(rows), BLOCK):
                p, r = probes[i : i + BLOCK], rows[j : j + BLOCK]
                near = np.bitwise_count(p.view(np.uint64)[:, None] ^ r.view(np.uint64)[None, :]) <= bits
                hit_p, hit_r = _spanning(near, p, r)
                i_all.append(hit_p)
                j_all.append(hit_r)
        from_.append(np.concatenate(i_all))
        to.append(np.concatenate(j_all))
    if not from_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(from_), np.concatenate(to)


def _spanning(near: np.ndarray, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a block of near pairs: all if they are few, else breadth first,
    a whole frontier at a time (it takes every probe that is near to a row it took)."""
    np.logical_and(near, p[:, None] != r[None, :], out=near)
    if np.count_nonzero(near) <= 8 * (len(p) + len(r)):
        i, j = np.nonzero(near)
        return p[i], r[j]
    from_, to = [], []
    todo_p, todo_r = near.any(axis=1), np.ones(len(r), bool)
    while todo_p.any():
        front = np.array([int(np.argmax(todo_p))])
        todo_p[front] = False
        while len(front):
            sub = near[front] & todo_r[None, :]
            new_r = np.flatnonzero(sub.any(axis=0))
            if not len(new_r):
                break
            from_.append(p[front[sub[:, new_r].argmax(axis=0)]])
            to.append(r[new_r])
            todo_r[new_r] = False
            sub = near[:, new_r] & todo_p[:, None]
            front = np.flatnonzero(sub.any(axis=1))
            from_.append(p[front])
            to.append(r[new_r[sub[front].argmax(axis=1)]] if len(front) else r[:0])
            todo_p[front] = False
    return np.concatenate(from_), np.concatenate(to)


def links(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, kept: int = HISTOGRAM_BITS) -> DataFrame:
    """``a, b``: links at up to ``bits`` differing bits that connect all distinct values of ``fp`` that
    such links connect. fps: distinct, already written (it is read several times). kept: bits of a part
    that its histogram keeps."""
    spark = fps.sparkSession
    n = fps.count()
    # Wider parts for more fingerprints, so that a value is shared by few of them if bits are spread.
    parts = next((m for m in (4, 3) if n >> (64 // m) < 16), 2) if bits == 3 else bits + 1
    groups = correlated_parts(fps, parts)
    keep = [min(len(g), kept) for g in groups]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << k, np.int64) for k in keep]
        for batch in batches:
            values = _values(batch.column(0).to_numpy(zero_copy_only=False), groups)
            for g, k in enumerate(keep):
                counts[g] += np.bincount(values[:, g] & ((1 << k) - 1), minlength=1 << k)
        for g, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["part", "value", "n"])

    # At most parts * 2 ** kept rows.
    table = fps.select("fp").mapInArrow(histogram, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    histograms = [np.zeros(1 << k, np.int64) for k in keep]
    for g in range(parts):
        own = table[table["part"] == g]
        histograms[g][own["value"].to_numpy()] = own["n"].to_numpy()
    shared = spark.sparkContext.broadcast(Crowds(groups, histograms, hot_values(fps, groups, histograms, block)))
    masks = [_masks(len(g), bits) for g in groups]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows (kind 0) in every part and probe rows (kind 1) within the thresholds, dealt to
        blocks of each kind: a row of a block meets all blocks of the other kind."""
        crowds = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 1 << 13):
                own = fps[at : at + (1 << 13)]
                values = _values(own, groups)
                near = thresholds(values, groups, crowds, bits)
                salt = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                for g in range(parts):
                    counts, low = crowds.histograms[g], (1 << keep[g]) - 1
                    rows = [(0, np.arange(len(own)), values[:, g])]
                    for t in range(bits + 1):
                        who = np.flatnonzero(near[:, g] >= t)
                        for m in masks[g][t].tolist() if len(who) else ():
                            rows.append((1, who, values[who, g] ^ m))
                    for kind, who, value in rows:
                        if kind:
                            hit = counts[value & low] > 0
                            who, value = who[hit], value[hit]
                        blocks = crowds.blocks(g, value, block)
                        mine, copies = salt[who] % blocks[kind], blocks[1 - kind]
                        again = np.repeat(np.arange(len(who)), copies)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                        left, right = (mine[again], other) if kind == 0 else (other, mine[again])
                        key = (value[again] * parts + g) << 24 | left << 12 | right
                        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.full(len(again), kind), pa.int8()), pa.array(own[who[again]], pa.int64())], names=["key", "kind", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64))
        for batch in batches:
            now = tuple(np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest))
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            rest = tuple(x[last:] for x in now)
            if last:
                a, b = _forest(*(x[:last] for x in now), bits)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(rest[0]):
            a, b = _forest(*rest, bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = fps.select("fp").mapInArrow(spread, "key long, kind byte, fp long")
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return ordered.mapInArrow(verified, "a long, b long")


def classes_of(own: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, kept: int = HISTOGRAM_BITS) -> DataFrame:
    """``fp, root`` for every distinct fingerprint of ``own``; fingerprints of a component share a root."""
    classes = cut(own.select("fp").distinct(), "classes")
    roots = components(links(classes, bits, block, kept))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id`` (the smallest doc_id of the component).

    One row for each row of ``docs``. Texts without words have fingerprint zero and link like others; a
    null doc_id never names a component unless all its ids are null; an empty table gives no rows.
    """
    own = cut(fingerprints(docs), "fingerprints")
    roots = cut(classes_of(own, bits), "roots")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the row with the smallest doc_id
    (an id before none), then by hashes of the text and of all columns. All columns stay."""
    text, row = F.xxhash64(F.col("text").cast("string")), F.xxhash64(*docs.columns)
    own = cut(fingerprints(docs, text, row), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_0", "_1")
    # The least row of each fingerprint first, so that a hot one is summed up before it meets its root.
    least = own.groupBy("fp").agg(F.min(order).alias("m")).join(classes_of(own, bits), "fp").groupBy("root").agg(F.min("m").alias("m"))
    text_, row_, t, r, turn = free(docs, "_text", "_row", "_t", "_r", "_turn")
    chosen = cut(least.select("m._0", "m._1").distinct(), "chosen").toDF(text_, row_)
    rows = docs.withColumn(t, text).withColumn(r, row)
    same = (F.col(t) == F.col(text_)) & (F.col(r) == F.col(row_))
    # Repeated rows share both hashes; the window keeps the join's partitioning, so texts move once.
    again = F.row_number().over(Window.partitionBy(t, r).orderBy(r))
    return rows.join(chosen, same, "left_semi").withColumn(turn, again).where(F.col(turn) == 1).select(*docs.columns)
