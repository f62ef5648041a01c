"""Language-model scoring by a weighted backoff automaton.

Training tokens give counts of words and of pairs. With absolute discounting (d1, d2) the model is an
automaton:

* the root has an arc for every known word, of weight log10 P(w) = log10((c - d1) / N), and one for all
  unknown words, log10(d1 * V / N);
* every known word h is a state, with an arc for every word w that followed it twice or more, of weight
  log10((c(hw) - d2) / c(h));
* a state without an arc for the next word takes its failure arc to the root, of weight log10 a(h): the
  mass that its arcs leave, over the root's mass of the words that it has no arc for. So the words that can
  follow a state have probabilities that sum to one, however many words there are.

Reading word w leads to state w if it is known, else to the root. Each text is read once, from left to
right, from the root, with the state carried on from token to token, and the weights of the arcs that it
takes add up. No task holds all arcs; a slice of texts reads with those that its texts can meet:

1. words are counted; the most frequent ones are broadcast, as names that are short and weights at hand;
2. each slice of text asks for its distinct pairs (state, word), with their counts in training texts, in
   packed blocks by part of about ``PART_TOKENS`` tokens; a part has all arcs of its states, but for the most
   frequent states, which are dealt over several parts by word. The texts go on as numbers of tokens;
3. a part adds up its pairs' counts, and answers each slice with those of the asked arcs that there are and
   with the failure arcs of their states; words that aren't broadcast are looked up by a join with the table
   of all words, for the root's arcs and for what they add to the failure arcs of states that have arcs for them;
4. a slice's texts and answers meet in one task (``Reader``), which reads the texts.

Every pair is counted and every token of a text is read, whatever their number. Words are named by 63 bits of
their hash; among V words V * V / 2 ** 64 clashes are expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, slices

#: So many of the most frequent words are broadcast, 24 bytes each.
CACHED_WORDS = 1 << 18
#: A part has about so many tokens; a state with over a sixteenth of that is dealt over several parts.
PART_TOKENS = 1_500_000
SLICE_BYTES = 4 << 20
#: The token at a text's end; no word holds white space.
END = b"\n"
FOLDS, HELD_OUT = 7, 2
#: Rows of the packed tables: texts, a part's arcs and who asked for them (or its answers), sums of dealt
#: states, counts of counts, arcs for words that aren't broadcast.
TEXTS, ARCS, STATES, COUNTS, RARE = range(5)
PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("slice", pa.int64()), ("n", pa.int64()), ("data", pa.list_(pa.binary()))])
PACKED_DDL = "part int, kind int, slice long, n long, data array<binary>"


def is_held_out() -> F.Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts one after the other, and the number in each text."""
    out: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        out += own
        out.append(END)
        counts[i] = len(own) + 1
    return out, counts


def _numbers(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct tokens in order of appearance, and each token's number."""
    number = dict.fromkeys(tokens)
    for i, w in enumerate(number):
        number[w] = i
    return list(number), np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).astype(np.int64)


def _follows(counts: np.ndarray) -> np.ndarray:
    """Which tokens, from the second on, follow another one of their text."""
    same = np.ones(max(0, int(counts.sum()) - 1), bool)
    same[np.cumsum(counts)[:-1] - 1] = False
    return same


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane, so that small ones take little."""
    planes = np.ascontiguousarray(np.asarray(values, np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def count_words(train: DataFrame) -> DataFrame:
    """``key long, n long``: counts of all tokens. Each task adds up what it reads first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for batch in (part for whole in batches for part in slices(whole)):
            words, numbers = _numbers(_tokens(batch.column(0).to_pylist())[0])
            held.append((_hashes(words), np.bincount(numbers, minlength=len(words))))
            size += len(words)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return train.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class Words:
    """The broadcast words: hashes in order, each with its place among the most frequent, and their counts
    by place. A word's id is its place; the id of any other word is ~hash, a negative number."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int, d1: float, keys: np.ndarray) -> None:
        by_count = np.lexsort((hashes, -counts))
        place = np.empty(len(hashes), np.int32)
        place[by_count] = np.arange(len(hashes), dtype=np.int32)
        order = np.argsort(hashes)
        self.hashes, self.places, self.counts = hashes[order], place[order], counts[by_count]
        self.total, self.types, self.d1, self.keys = total, types, d1, keys
        #: Over how many parts each of the first words is dealt as a state; all others have one.
        spread = -(-self.counts * 16 // PART_TOKENS)
        self.dealt = spread[: np.count_nonzero(spread > 1)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return ~hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], ~hashes)

    @cached_property
    def share(self) -> np.ndarray:
        """P(w) of the root's arcs."""
        return (self.counts - self.d1) / max(1, self.total)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Weights of the root's arcs for words of such counts; 0 is an unknown word."""
        unknown = np.log10(max(self.d1 * self.types, 1e-300) / self.total) if self.total else 0.0
        return np.where(counts > 0, np.log10(np.maximum(counts - self.d1, 1e-300) / max(1, self.total)), unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.types + 1))

    def part(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        dealt, salt = self.dealt, np.zeros(len(h), np.int64)
        hot = (h >= 0) & (h < len(dealt))
        salt[hot] = (_mixed(w[hot], w[hot]) % dealt[h[hot]].astype(np.uint64)).astype(np.int64)
        return (_mixed(h, salt) % np.uint64(len(self.keys))).astype(np.int64)


def _keys(spark: SparkSession, parts_each: int) -> np.ndarray:
    """Numbers of the parts, such that Spark's hash deals so many of them to each shuffle partition."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(n * (32 * parts_each + 32)).select(F.col("id").cast("int").alias("key")).withColumn("p", F.pmod(F.hash("key"), F.lit(n)))
    first = numbers.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("key"))).where(F.col("r") <= parts_each)
    return np.sort(np.array([r["key"] for r in first.select("key").collect()], np.int64))


def frequent_words(counts: DataFrame, spark: SparkSession) -> Words:
    """The broadcast words of the table ``key, n``: all that are counted at least so often that no more
    than ``CACHED_WORDS`` are, and the end."""
    end = int(_hashes([END])[0])
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).first()
    # There are no more distinct counts than the root of twice the tokens.
    least, kept = 1 << 62, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("v")).collect(), reverse=True):
        if kept + r["v"] > CACHED_WORDS:
            break
        least, kept = r["n"], kept + r["v"]
    often = counts.where((F.col("n") >= least) | (F.col("key") == end)).toArrow()
    each = -(-row["n"] // (PART_TOKENS * int(spark.conf.get("spark.sql.shuffle.partitions")))) or 1
    return Words(often.column("key").to_numpy(), often.column("n").to_numpy(), row["n"], row["v"], _discount(row["ones"], row["twos"]), _keys(spark, each))


def ask(docs: DataFrame, words: Words) -> DataFrame:
    """Each slice's texts, as numbers of its words (ids in order), and what it asks of the parts: distinct
    pairs (states in order, words) with their counts in training texts. docs: doc_id, text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batch: pa.RecordBatch, number: int) -> list[tuple]:
        model = shared.value
        tokens, counts = _tokens(batch.column(1).to_pylist())
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        found, numbers = _numbers(tokens)
        del tokens
        of_word = model.ids(_hashes(found))
        order = np.argsort(of_word)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        numbers, ids = rank[numbers], of_word[order]
        size, names = len(ids), batch.column(0)
        texts = [names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False), held, counts, _steps(ids), numbers]
        lengths = np.array([len(x) for x in texts], np.int64).tobytes()
        out = [(int(model.keys[number % len(model.keys)]), TEXTS, number, len(counts), [lengths, *map(squeeze, texts)])]
        at = np.flatnonzero(_follows(counts))
        key, k = np.unique((numbers[at] * size + numbers[at + 1]) * 2 + np.repeat(held, counts)[at], return_counts=True)
        if not len(key):
            return out
        k[key % 2 == 1] = 0
        key >>= 1
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, k = key[first], np.add.reduceat(k, first)
        h, w = ids[key // size], ids[key % size]
        part = model.part(h, w)
        order = np.argsort(part.astype(np.uint16) if len(model.keys) <= 1 << 16 else part, kind="stable")
        part, h, w, k = (x[order] for x in (part, h, w, k))
        bounds = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            out.append((int(model.keys[part[a]]), ARCS, number, b - a, [squeeze(_steps(h[a:b])), squeeze(w[a:b]), squeeze(k[a:b])]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            yield _packed(rows(batch, number))
            number += 1

    needed = docs.select(F.col("doc_id").cast("long"), "text", is_held_out().alias("held"))
    return needed.mapInArrow(run, PACKED_DDL)


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for each pair; exact for broadcast words, 63 bits of a hash for others."""
    return np.where((h >= 0) & (w >= 0), h << 32 | np.maximum(w, 0), -1 - (_mixed(h, w) >> np.uint64(1)).astype(np.int64))


def merge_parts(dealt: DataFrame, words: Words) -> DataFrame:
    """Each part's blocks as one row: its pairs (states, words, counts) and who asked for them; beside them
    the sums of dealt states, counts of pairs counted once and twice, and the texts as they are."""
    shared = dealt.sparkSession.sparkContext.broadcast(words)

    def merged(part: int, blocks: list[tuple]) -> list[tuple]:
        model = shared.value
        sizes = np.array([n for _, n, _ in blocks], np.int64)
        h = np.concatenate([np.cumsum(expand(d[0], n)) for _, n, d in blocks])
        w, k = (np.concatenate([expand(d[i], n) for _, n, d in blocks]) for i in (1, 2))
        _, first, arc = np.unique(_pair_keys(h, w), return_index=True, return_inverse=True)
        n = np.bincount(arc, weights=k).astype(np.int64)
        h, w = h[first], w[first]
        data = [h, w, n, np.array([s for s, _, _ in blocks], np.int64), sizes, _steps(arc)]
        out = [(part, ARCS, len(blocks), len(n), [np.array([len(x) for x in data], np.int64).tobytes(), *map(squeeze, data)])]
        out.append((part, COUNTS, np.count_nonzero(n == 1), np.count_nonzero(n == 2), []))
        rare = (n > 1) & (w < 0)
        if rare.any():
            out.append((part, RARE, 0, np.count_nonzero(rare), [squeeze(_steps(h[rare])), squeeze(w[rare])]))
        own = (n > 1) & (h >= 0) & (h < len(model.dealt))
        if own.any():
            states, at = np.unique(h[own], return_inverse=True)
            shares = np.where(w[own] >= 0, model.share[np.maximum(w[own], 0)], 0.0)
            sums = [np.bincount(at, weights=n[own]).astype(np.int64), np.bincount(at)]
            out.append((part, STATES, 0, len(states), [*map(squeeze, [states, *sums]), np.bincount(at, weights=shares).tobytes()]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == TEXTS:
                    yield _packed([tuple(row.values())])
                    continue
                if current != row["part"] and held:
                    yield _packed(merged(current, held))
                    held = []
                current = row["part"]
                held.append((row["slice"], row["n"], row["data"]))
        if held:
            yield _packed(merged(current, held))

    return dealt.repartition("part").sortWithinPartitions("part", "slice").mapInArrow(run, PACKED_DDL)


def rare_shares(parts: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """``h, share``: of each state that has arcs for words that aren't broadcast, the root's share of those
    words. None of them is frequent, and shares are added up by state before they travel."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                steps, ids = (expand(d, r["n"]) for d in r["data"])
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(steps)), pa.array(~ids)], names=["h", "key"])

    arcs = parts.where(F.col("kind") == RARE).mapInArrow(unpacked, "h long, key long")
    share = (F.col("n") - F.lit(words.d1)) / F.lit(float(max(1, words.total)))
    return arcs.join(counts, "key").groupBy("h").agg(F.sum(share).alias("share"))


class Failures:
    """What a part needs besides its arcs: d2; for the dealt states the sums over all parts: counts of
    arcs, their number, and the root's share of their broadcast words; and for all broadcast states the
    share of their other words. rare: as ``rare_shares`` gives it."""

    def __init__(self, parts: DataFrame, words: Words, rare: DataFrame) -> None:
        row = parts.where(F.col("kind") == COUNTS).agg(F.coalesce(F.sum("slice"), F.lit(0)).alias("ones"), F.coalesce(F.sum("n"), F.lit(0)).alias("twos")).first()
        self.d2 = _discount(row["ones"], row["twos"])

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    states, used, arcs = (expand(d, r["n"]) for d in r["data"][:3])
                    yield pa.RecordBatch.from_arrays([pa.array(states), pa.array(used), pa.array(arcs), pa.array(np.frombuffer(r["data"][3]))], names=["h", "used", "arcs", "share"])

        sums = parts.where(F.col("kind") == STATES).mapInArrow(unpacked, "h long, used long, arcs long, share double").groupBy("h").agg(F.sum("used").alias("used"), F.sum("arcs").alias("arcs"), F.sum("share").alias("share"))
        own = sums.toArrow()  # dealt states only, so no more rows than CACHED_WORDS
        self.used, self.arcs, self.share = (np.zeros(len(words.dealt)) for _ in range(3))
        at = own.column("h").to_numpy()
        for name in ("used", "arcs", "share"):
            getattr(self, name)[at] = own.column(name).to_numpy()
        self.rare = np.zeros(len(words.counts))
        shares = rare.where(F.col("h") >= 0).toArrow()  # broadcast states only
        self.rare[shares.column("h").to_numpy()] = shares.column("share").to_numpy()


def answers(parts: DataFrame, words: Words, failures: Failures) -> DataFrame:
    """What each slice gets of each part: the asked arcs that there are (states, words, counts), and the
    states among the asked ones that have arcs, with the weights of their failure arcs; with those that aren't
    broadcast also the share that the weight counts, without their words that aren't. Texts as they are."""
    shared = parts.sparkSession.sparkContext.broadcast((words, failures))

    def answered(row: dict) -> Iterator[tuple]:
        model, failures = shared.value
        sizes = np.frombuffer(row["data"][0], np.int64).tolist()
        h, w, n, numbers, lengths, arc = (expand(d, m) for d, m in zip(row["data"][1:], sizes, strict=True))
        arc = np.cumsum(arc)
        has = n > 1
        states, at = np.unique(h, return_inverse=True)
        shares = np.where(w >= 0, model.share[np.maximum(w, 0)], 0.0) if len(model.share) else np.zeros(len(w))
        # All arcs of a state that isn't broadcast are in this part.
        count, used, arcs, share = (np.bincount(at, weights=x) for x in (n, n * has, has, shares * has))
        hot = (states >= 0) & (states < len(failures.used))
        own = states[hot]
        count[hot], used[hot], arcs[hot], share[hot] = model.counts[own], failures.used[own], failures.arcs[own], failures.share[own]
        often = states >= 0
        share[often] += failures.rare[states[often]]
        failure = np.log10(1 - (used - failures.d2 * arcs) / np.maximum(count, 1)) - np.log10(1 - share)
        ends = np.cumsum(lengths)
        for number, a, b in zip(numbers.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
            asked = arc[a:b]
            taken = asked[has[asked]]
            met = np.unique(at[asked])
            met = met[arcs[met] > 0]
            if len(met):
                rare = np.count_nonzero(states[met] < 0)
                data = [squeeze(_steps(h[taken])), squeeze(w[taken]), squeeze(n[taken]), squeeze(_steps(states[met])), failure[met].tobytes(), share[met[:rare]].tobytes()]
                yield (0, ARCS, number, len(taken), [np.int64(len(met)).tobytes(), *data])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                done = list(answered(row)) if row["kind"] == ARCS else [tuple(row.values())]
                if done:
                    yield _packed(done)

    return parts.where(F.col("kind").isin(TEXTS, ARCS)).mapInArrow(run, PACKED_DDL)


def _texts(data: list[bytes]) -> list[np.ndarray]:
    """Of a row of texts: names, which are null, which are held out, numbers of tokens, ids, tokens."""
    out = [expand(d, n) for d, n in zip(data[1:], np.frombuffer(data[0], np.int64).tolist(), strict=True)]
    out[4] = np.cumsum(out[4])
    return out


def other_words(parts: DataFrame, counts: DataFrame, rare: DataFrame) -> DataFrame:
    """``slice, at, n, share``: each slice's words that aren't broadcast, by number, with their counts and, as
    states, the root's share of their words that aren't either. None is frequent, so no key is hot."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, (lengths, *_, steps, _) = (batch.column(j)[i].as_py() for j in range(2))
                ids = np.cumsum(expand(steps, int(np.frombuffer(lengths, np.int64)[4])))
                ids = ids[ids < 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["slice", "at", "id"])

    rows = parts.where(F.col("kind") == TEXTS).select("slice", "data").mapInArrow(unpacked, "slice long, at long, id long")
    known = rows.join(counts.select(F.bitwise_not("key").alias("id"), "n"), "id")
    return known.join(rare.withColumnRenamed("h", "id"), "id", "left").select("slice", "at", "n", F.coalesce("share", F.lit(0.0)).alias("share"))


class Reader:
    """The automaton as a slice's texts can meet it. Words are numbers below ``size``, and so are their
    states; ``size`` itself is the root. ``root``: weight of the root's arc for each word; ``failure``: weight of
    each state's failure arc, 0.0 of the root; ``arcs``: weights by ``state * size + word``; ``leads``: the
    state after each word, whichever arc is taken."""

    def __init__(self, root: list[float], failure: list[float], arcs: dict[int, float], known: list[bool]) -> None:
        self.size, self.root, self.failure, self.arcs = len(root), root, failure, arcs
        self.leads = [w if k else self.size for w, k in enumerate(known)]

    def read(self, tokens: list[int]) -> float:
        """Read one text from left to right, from the root; the sum of the weights of the arcs taken."""
        size, root, failure, leads, arc = self.size, self.root, self.failure, self.leads, self.arcs.get
        state, total = size, 0.0
        for w in tokens:
            weight = arc(state * size + w)
            total += failure[state] + root[w] if weight is None else weight
            state = leads[w]
        return total


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _reader(model: Words, d2: float, ids: np.ndarray, counts: np.ndarray, shares: np.ndarray, rows: list[dict]) -> Reader:
    """A slice's reader: ids and counts of its words, shares of its states' words that aren't broadcast,
    and the parts' answers."""
    size, failure, arcs = len(ids), np.zeros(len(ids) + 1), {}
    for r in rows:
        met, h, w, n, states, failed, counted = r["data"]
        h, w, n = np.cumsum(expand(h, r["n"])), expand(w, r["n"]), expand(n, r["n"])
        h, w = np.searchsorted(ids, h), np.searchsorted(ids, w)
        arcs.update(zip((h * size + w).tolist(), np.log10((n - d2) / counts[h]).tolist(), strict=True))
        states = np.searchsorted(ids, np.cumsum(expand(states, int(np.frombuffer(met, np.int64)[0]))))
        failure[states] = np.frombuffer(failed)
        counted = np.frombuffer(counted)
        rare = states[: len(counted)]
        failure[rare] += np.log10(1 - counted) - np.log10(1 - counted - shares[rare])
    return Reader(model.root(counts).tolist(), failure.tolist(), arcs, (counts > 0).tolist())


def read_texts(answered: DataFrame, others: DataFrame, words: Words, d2: float) -> DataFrame:
    """Every text's scores: a slice's texts, answers and other words meet in one task."""
    shared = answered.sparkSession.sparkContext.broadcast(words)

    def read(mine: pa.Table, found: pa.Table) -> pa.Table:
        model = shared.value
        rows = mine.to_pylist()
        (texts,) = [r for r in rows if r["kind"] == TEXTS]
        names, none, held, lengths, ids, tokens = _texts(texts["data"])
        counts, shares = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        at = found.column("at").to_numpy()
        counts[at], shares[at] = found.column("n").to_numpy(), found.column("share").to_numpy()
        counts[ids >= 0] = model.counts[ids[ids >= 0]]
        reader = _reader(model, d2, ids, counts, shares, [r for r in rows if r["kind"] == ARCS])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        score = [reader.read(tokens[a:b].tolist()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        known, base = np.add.reduceat((counts > 0).astype(np.int64)[tokens], starts), np.add.reduceat(model.base(counts)[tokens], starts)
        columns = [pa.array(names, mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known), pa.array(np.full(len(names), model.total)), pa.array(base), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    needed = answered.select("slice", "kind", "n", "data")
    return needed.groupBy("slice").cogroup(others.groupBy("slice")).applyInArrow(read, SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all whole texts (null: empty): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the automaton), both log10 probabilities.

    One row for each row of ``docs``; a null doc_id counts as training; an empty text is its end token.
    Without training texts every token is unknown, of probability one for the automaton. Columns other than
    doc_id and text are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = cut(count_words(docs.where(~is_held_out())), "words")
    words = frequent_words(counts, spark)
    parts = cut(merge_parts(ask(docs, words), words), "parts")
    rare = cut(rare_shares(parts, counts, words), "rare")
    failures = Failures(parts, words, rare)
    return read_texts(answers(parts, words, failures), other_words(parts, counts, rare), words, failures.d2)
