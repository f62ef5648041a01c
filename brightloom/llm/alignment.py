"""Two tokenizers' tokens aligned by their bytes, with counts of linked ids over the corpus.

Both tokenizers end a token before a single space between other characters, so a text is cut there and
each distinct chunk of a slice of texts is aligned once. In a task, DuckDB takes the chunks' tokens as two
tables of intervals on one axis: an ASOF join links each A token to the B token that holds its first byte,
a range join to those that begin inside it, and window sums over common ends number the groups. A slice
keeps its pairs of ids with partial counts and, for each document, how often which of them is linked.
Spark merges the partial counts by pair, marks each B id's most frequent pairs, and sends every slice the
values of its own pairs, so nothing is as large as the corpus anywhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut
from .encoding import Pieces, byte_symbols, tokenizer_path, vocabulary
from .piece_prefix import SHORT, _inner_space, chunks

#: Characters of text of a slice (or one longer text), and A tokens of one run of DuckDB (or one longer group).
SLICE, WINDOW = 2 << 20, 1 << 17
#: Chunks whose ids a worker keeps.
CACHED = 200_000
SLICES = "slice string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, kinds array<int>, codes binary, times binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, groups string"

LINKS = """
SELECT a.chunk, a.id AS x, b.id AS y FROM a ASOF JOIN b ON a.first >= b.first
UNION ALL
SELECT a.chunk, a.id, b.id FROM a JOIN b ON b.first > a.first AND b.first < a.next
"""
#: The group of each token: how many ends before its own are ends of both.
GROUPED = """
SELECT sum(common) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) - common AS grouped
FROM (SELECT t.n, CAST(o.next IS NOT NULL AS INTEGER) AS common FROM {} t LEFT JOIN {} o ON t.next = o.next) ORDER BY n
"""
PAIRS = "SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS code FROM (SELECT DISTINCT x, y FROM links)"
#: How often a document holds which pair linked.
HELD = """
SELECT d.document, p.code, CAST(sum(d.times * l.times) AS BIGINT) AS times
FROM (SELECT document, chunk, count(*) AS times FROM occurrences GROUP BY ALL) d
JOIN (SELECT chunk, x, y, count(*) AS times FROM links GROUP BY ALL) l USING (chunk) JOIN pairs p USING (x, y)
GROUP BY ALL ORDER BY ALL
"""


class PlainPieces(Pieces):
    """Byte-level ids of chunks; the strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()


class Aligner:
    """Tokens of both vocabularies, with their bytes and what a group's text writes for them."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        back = {c: b for b, c in byte_symbols().items()}
        vocab, _, special = vocabulary(byte_path)
        self.pieces = PlainPieces(byte_path)
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = [b""] * (max(max(vocab.values()), *special.values(), 0) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in token) if token not in special else token.encode()
        ids = range(self.model.get_piece_size())
        self.b_bytes = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # An id with what follows it in a group: , inside a side, | after A's last, ; after B's last.
        self.a_text = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"]
        self.b_text = [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;"]
        self.text = self.a_text + self.b_text
        self.text_size = np.array([len(t) for t in self.text], np.int64)

    def tokens(self, distinct: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The ids of all chunks (with the space before each) and how many each has, on both sides; a chunk
        whose tokens' bytes aren't its own has none."""
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        a = list(map(self.pieces.__getitem__, distinct))
        for chunk in distinct:
            if len(chunk) > SHORT:
                self.pieces.pop(chunk)
        b = self.model.encode([c[1:] for c in distinct], num_threads=1)
        a_ids, b_ids = np.frombuffer(b"".join(a), "<u2").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)) // 2, np.fromiter(map(len, b), np.int64, len(b))
        data = list(map(str.encode, distinct))
        size = np.fromiter(map(len, data), np.int64, len(data))
        wrong = np.zeros(len(data), bool)
        for ids, n, sizes, texts in ((a_ids, n_a, self.a_size, self.a_bytes), (b_ids, n_b, self.b_size, self.b_bytes)):
            ends = np.r_[0, np.cumsum(n)]
            total = np.r_[0, np.cumsum(sizes[ids])][ends]
            wrong |= np.diff(total) != size
            joined = b"".join(map(texts.__getitem__, ids.tolist()))
            if wrong.any() or joined != b"".join(data):
                wrong |= np.array([joined[x:y] != d for x, y, d in zip(total.tolist(), total[1:].tolist(), data, strict=False)], bool)
        if wrong.any():
            a_ids, b_ids = a_ids[~np.repeat(wrong, n_a)], b_ids[~np.repeat(wrong, n_b)]
            n_a, n_b = np.where(wrong, 0, n_a), np.where(wrong, 0, n_b)
        return (a_ids, n_a), (b_ids, n_b)


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(byte_path, piece_path)


class Numbers(dict):
    """Chunk -> its number, in order of appearance."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


class Slice:
    """The distinct chunks of some texts, and each text as numbers of chunks."""

    def __init__(self) -> None:
        self.ids: list = []
        self.texts: list[np.ndarray] = []
        self.chunks = Numbers()
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        known, parts, at = self.chunks, [], 0
        while at < len(text):  # long texts are cut up some at a time
            border = _inner_space.search(text, at + SLICE) if len(text) - at > SLICE else None
            part, at = (text[at : border.start()], border.end()) if border else (text[at:], len(text))
            parts.append(np.fromiter(map(known.__getitem__, chunks(part)), np.int64))
        self.ids.append(doc_id)
        self.texts.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        self.size += len(text)


def windows(a_next: np.ndarray, b_next: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of tokens of both sides that end at common ends, as (a from, a to, b from, b to)."""
    a, b = 0, 0
    while a < len(a_next):
        to = min(a + WINDOW, len(a_next))
        while True:  # the next end that both sides have
            other = np.searchsorted(b_next, a_next[to - 1])
            if b_next[other] == a_next[to - 1]:
                break
            to += 1
        yield a, to, b, other + 1
        a, b = to, other + 1


def align(part: Slice, own: Aligner) -> dict:
    """All of a slice: per chunk token, group and link counts and the groups' text; the slice's pairs;
    and for each document how often it holds which pair."""
    distinct = [" " + c for c in part.chunks]
    (a_ids, n_a), (b_ids, n_b) = own.tokens(distinct)
    a_next, b_next = np.cumsum(own.a_size[a_ids]), np.cumsum(own.b_size[b_ids])
    a_chunk, b_chunk = np.repeat(np.arange(len(distinct)), n_a), np.repeat(np.arange(len(distinct)), n_b)
    a_group, b_group, groups = [], [], 0
    with duckdb.connect(config={"threads": 1}) as db:
        db.execute("CREATE TABLE links (chunk INTEGER, x INTEGER, y INTEGER)")
        for a0, a1, b0, b1 in windows(a_next, b_next):
            for name, x0, x1, ids, ends, sizes, chunk in (("a", a0, a1, a_ids, a_next, own.a_size, a_chunk), ("b", b0, b1, b_ids, b_next, own.b_size, b_chunk)):
                table = pa.table({"n": np.arange(x0, x1), "chunk": chunk[x0:x1], "id": ids[x0:x1], "first": ends[x0:x1] - sizes[ids[x0:x1]], "next": ends[x0:x1]})
                db.register(name, table)
            db.execute(f"INSERT INTO links {LINKS}")
            for side, out in (("ab", a_group), ("ba", b_group)):
                out.append(db.execute(GROUPED.format(*side)).fetchnumpy()["grouped"].astype(np.int64) + groups)
            groups = a_group[-1][-1] + 1
        valid = np.array([not (len(t) and (n_a[t] == 0).any()) for t in part.texts], bool)
        occurrences = [t if ok else t[:0] for t, ok in zip(part.texts, valid, strict=True)]
        lengths = np.array([len(t) for t in occurrences], np.int64)
        flat = np.concatenate([*occurrences, np.zeros(0, np.int64)])
        db.register("occurrences", pa.table({"document": np.repeat(np.arange(len(lengths)), lengths), "chunk": flat}))
        db.execute(f"CREATE TABLE pairs AS {PAIRS}")
        held = db.execute(HELD).fetchnumpy()
        pairs = db.execute("SELECT x, y FROM pairs ORDER BY code").fetchnumpy()
        links = db.execute("SELECT chunk, count(*) AS links FROM links GROUP BY chunk").fetchnumpy()
    n_links = np.zeros(len(distinct), np.int64)
    n_links[links["chunk"]] = links["links"]
    a_group, b_group = (np.concatenate([*g, np.zeros(0, np.int64)]) for g in (a_group, b_group))
    last_a, last_b = (np.diff(g, append=groups) > 0 for g in (a_group, b_group))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(a_chunk[last_a], minlength=len(distinct)), "n_links": n_links,
        "texts": _texts(own, (a_ids, a_group, last_a), (b_ids, b_group, last_b), n_a + n_b),
        "occurrences": occurrences, "held": held, "pairs": pairs,
    }


def _texts(own: Aligner, a: tuple, b: tuple, sizes: np.ndarray) -> list[str]:
    """The groups of each chunk as text, each group with its A ids first and with a ; at its end."""
    (a_ids, a_group, last_a), (b_ids, b_group, last_b) = a, b
    keys = np.empty(len(a_ids) + len(b_ids), np.int64)
    keys[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = 2 * a_ids + last_a
    keys[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")] = len(own.a_text) + 2 * b_ids + last_b
    text = "".join(map(own.text.__getitem__, keys.tolist()))
    borders = np.r_[0, np.cumsum(own.text_size[keys])][np.r_[0, np.cumsum(sizes)]].tolist()
    return [text[x:y] for x, y in zip(borders, borders[1:], strict=False)]


def _slices(docs: DataFrame, schema: str, finish) -> DataFrame:
    """Gather slices of texts in each task and give each to ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Slice()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if part.ids and part.size + len(text) > SLICE:
                    yield finish(part)
                    part = Slice()
                part.add(doc_id, text)
        if part.ids:
            yield finish(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def alignments(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3`` (decimal ids in order; empty without tokens)."""
    paths = byte_path or tokenizer_path("byte_bpe_50k.json"), piece_path or tokenizer_path("piece_bpe_32k.model")

    def finish(part: Slice) -> pa.RecordBatch:
        found = align(part, aligner(*paths))
        groups = ["".join(map(found["texts"].__getitem__, t.tolist()))[:-1] for t in found["occurrences"]]
        return pa.RecordBatch.from_arrays([pa.array(part.ids, pa.int64()), pa.array(groups)], names=["doc_id", "groups"])

    return _slices(docs, GROUPS, finish)


def slice_rows(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row of ``SLICES`` for each slice of texts: its documents' counts, and its pairs with theirs."""
    paths = byte_path or tokenizer_path("byte_bpe_50k.json"), piece_path or tokenizer_path("piece_bpe_32k.model")
    schema = _arrow(SLICES)

    def finish(part: Slice) -> pa.RecordBatch:
        found = align(part, aligner(*paths))
        sums = {k: [int(found[k][t].sum()) for t in found["occurrences"]] for k in ("n_a", "n_b", "n_groups", "n_links")}
        digests = []
        for t in found["occurrences"]:
            digest = hashlib.sha256()
            for at in range(0, len(t), 1 << 17):
                text = "".join(map(found["texts"].__getitem__, t[at : at + (1 << 17)].tolist()))
                digest.update(text[: len(text) - (at + (1 << 17) >= len(t))].encode())
            digests.append(digest.hexdigest() if len(t) else "")
        held, pairs = found["held"], found["pairs"]
        row = {
            "slice": uuid.uuid4().hex, "doc_id": part.ids, **sums, "groups_sha256": digests,
            "kinds": np.bincount(held["document"].astype(np.int64), minlength=len(part.ids)).tolist(),
            "codes": held["code"].astype("<u4").tobytes(), "times": held["times"].astype("<u8").tobytes(),
            "pair_a": pairs["x"].tolist(), "pair_b": pairs["y"].tolist(),
            "pair_n": np.bincount(held["code"].astype(np.int64), held["times"].astype(np.float64), len(pairs["x"])).astype(np.int64).tolist(),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    return _slices(docs, SLICES, finish)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _pairs(slices: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("pair_a", "pair_b", "pair_n")
    rows = slices.select("slice", F.posexplode(zipped).alias("code", "pair"))
    return rows.select("slice", "code", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), F.col("pair.pair_n").alias("n"))


def pair_counts(slices: DataFrame) -> DataFrame:
    """How many links of the corpus hold each pair of ids (a, b), and whether that is its B id's highest."""
    counts = _pairs(slices).where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy("b"))  # a B id has at most a vocabulary of partners
    return counts.select("a", "b", "count", (F.col("count") == top).alias("best"))


def document_alignment(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Token, group and link counts of each document, sums of its links' counts over the corpus, and a
    digest of its groups, as ``DIGESTS``. Null and empty texts, and those that hold U+2581 (which the
    pieces write for a space), have no tokens: zeros and an empty digest. Null ids stay; repeated rows
    each count and each give a row; other columns are ignored. A task holds one slice of texts, or one
    longer text."""
    slices = cut(slice_rows(docs, byte_path, piece_path), "slices")
    valued = _pairs(slices).where("n > 0").join(pair_counts(slices), ["a", "b"])
    values = valued.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("code", "count", "best"))).alias("values"))  # its own pairs
    rows = slices.drop("pair_a", "pair_b", "pair_n").join(values, "slice", "left")
    rows = rows.withColumns({name: F.col(f"values.{name}") for name in ("code", "count", "best")}).drop("slice", "values")
    names = _arrow(DIGESTS).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                kinds, codes, times = np.array(row["kinds"].as_py(), np.int64), np.frombuffer(row["codes"].as_py(), "<u4"), np.frombuffer(row["times"].as_py(), "<u8").astype(np.int64)
                count, best = np.zeros(int(codes.max(initial=0)) + 1, np.int64), np.zeros(int(codes.max(initial=0)) + 1, np.int64)
                if row["code"].is_valid:
                    code = row["code"].values.to_numpy()
                    count[code], best[code] = row["count"].values.to_numpy(), row["best"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(kinds)
                sums = []
                for value in (best, count):
                    total = np.r_[0, np.cumsum(value[codes] * times)]
                    sums.append(pa.array(total[ends] - total[ends - kinds], pa.int64()))
                same = {name: row[name].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                yield pa.RecordBatch.from_pydict({**same, "n_best": sums[0], "count_sum": sums[1]}).select(names)

    return rows.mapInArrow(run, DIGESTS)
