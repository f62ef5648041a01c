"""Maximum inner product search: score-aware anisotropic quantisation, four-bit scans, exact reranking.

A vector is cut into subspaces of ``SUB`` dimensions, and each part is coded as one of 16 centres. The
loss that codes and centres are chosen by weighs the residual along the vector itself ``eta`` times as
much as the residual across it, because the former is what moves large inner products. A query builds a
table of its products with the centres; two codes share a byte, so one look-up in a table of 256 sums
serves two subspaces. The best ``DEPTH`` of a block by that sum are scored on the original vectors, and
then all others of the block that could still beat the worst answer so far: those whose sum reaches it
with ``SIGMAS`` standard errors of their own residual, taken as spread evenly over the dimensions. So the
depth follows how crowded the answers are, not the size of the table or of a block.

Centres come from about ``SAMPLE`` vectors of each length at most (chosen by a hash); all vectors are
coded and scanned. The stated query set meets all rows in blocks of bounded size. Copies of a vector are
one row in a scan and become rows again afterwards, so ties go to the smaller id. Vectors travel as they
are stored, single or double, and are widened where they are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

TOP = 20
QUERY_STEP = 20
SUB = 2
CENTRES = 16
SAMPLE = 10_000
DEPTH = 40
SIGMAS = 2.0
#: Most rows and queries of a block, and how many blocks there are at least (of 512 rows or more).
ROWS, QUERIES, SPREAD = 8192, 4096, 16
#: Share of a vector's norm above which an inner product counts; it sets the weight of parallel error.
THRESHOLD = 0.2
#: The least weight of parallel error; in few dimensions the threshold alone would ask for none.
LEAST_WEIGHT = 2.0


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual over the orthogonal one, for unit vectors of ``dim`` dimensions."""
    return max(LEAST_WEIGHT, (dim - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """Centres of each subspace, shape (subspaces, 16, SUB), and the weight of parallel error."""

    def __init__(self, dim: int, centres: np.ndarray, eta: float) -> None:
        self.dim, self.centres, self.eta = dim, centres, eta

    @staticmethod
    def parts(vectors: np.ndarray) -> np.ndarray:
        """(n, subspaces, SUB), the last part filled with zeros."""
        n, dim = vectors.shape
        padded = np.zeros((n, -(-dim // SUB) * SUB))
        padded[:, :dim] = vectors
        return padded.reshape(n, -1, SUB)

    def encode(self, vectors: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, subspaces): by nearest centre first, then by coordinate descent on the loss
        |r|^2 + (eta - 1) (r . x / |x|)^2, in which all subspaces share the parallel residual."""
        if len(vectors) > 2048:
            return np.concatenate([self.encode(vectors[i : i + 2048], rounds) for i in range(0, len(vectors), 2048)])
        parts = self.parts(vectors)
        unit = parts / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None, None]
        gap = parts[:, :, None, :] - self.centres[None]  # (n, m, 16, SUB)
        square = (gap**2).sum(-1)
        along = (gap * unit[:, :, None, :]).sum(-1)
        codes = square.argmin(-1)
        at = np.arange(len(vectors))
        total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(1)
        for _ in range(rounds):
            for m in range(parts.shape[1]):
                rest = total - along[at, m, codes[:, m]]
                best = (square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                codes[:, m] = best
                total = rest + along[at, m, best]
        return codes

    @classmethod
    def train(cls, vectors: np.ndarray, rounds: int = 6) -> Quantiser:
        """Alternate codes and centres; the centres solve the weighted least squares of their members."""
        n, dim = vectors.shape
        parts = cls.parts(vectors)
        m = parts.shape[1]
        start = np.linspace(0, n - 1, CENTRES).astype(int)
        order = np.argsort(parts[:, :, 0], axis=0)
        centres = np.stack([parts[order[start, k], k] for k in range(m)])
        self = cls(dim, centres, parallel_weight(dim))
        unit = parts / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None, None]
        for _ in range(rounds):
            codes = self.encode(vectors, 1)
            shown = self.centres[np.arange(m), codes]
            residual = ((parts - shown) * unit).sum(-1)
            total = residual.sum(1)
            for k in range(m):
                # Minimise sum |x - c|^2 + (eta - 1) (rest + u . (x - c))^2 over each centre c.
                rest = total - residual[:, k]
                u, x = unit[:, k], parts[:, k]
                weight = np.eye(SUB)[None] + (self.eta - 1) * u[:, :, None] * u[:, None, :]
                aim = x + (self.eta - 1) * u * (rest + (u * x).sum(1))[:, None]
                left = np.zeros((CENTRES, SUB, SUB))
                right = np.zeros((CENTRES, SUB))
                np.add.at(left, codes[:, k], weight)
                np.add.at(right, codes[:, k], aim)
                used = np.flatnonzero(np.bincount(codes[:, k], minlength=CENTRES))
                self.centres[k, used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
        return self

    def shown(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows, subspaces) stand for."""
        return self.centres[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dim]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate products (queries, rows) from packed codes (rows, bytes of two codes)."""
        parts = self.parts(queries)
        tables = np.einsum("qms,mcs->qmc", parts, self.centres)
        if tables.shape[1] % 2:
            tables = np.concatenate([tables, np.zeros((len(queries), 1, CENTRES))], axis=1)
        # The byte a + 16 b: code a of the first subspace of a pair, b of the second.
        pairs = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)
        out = np.zeros((len(queries), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            out += pairs[:, j][:, packed[:, j]]
        return out


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
    return (codes[:, 0::2] + CENTRES * codes[:, 1::2]).astype(np.uint8)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, dim``: distinct rows with an id and a vector of finite components, not
    all zero. Nulls, NaN and infinities keep a vector out."""
    v = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    # A negative zero is zero, so that equal vectors are one class.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(dict(rows.dtypes)["v"][6:-1])).otherwise(x)))
    return rows.distinct().withColumn("dim", F.size("v"))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Sums along rows in one fixed order, so equal vectors score alike wherever they stand.
    return (a * b).sum(axis=-1)


def trained(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``dim, centres``: centres of each length of vectors, trained on about ``SAMPLE`` of them (all, if
    there are no more), each length in a task."""
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    place = F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(1 << 20))
    few = rows.join(sizes.select("dim", share.alias("share")), "dim").where(place <= F.col("share") * (1 << 20)).select("dim", "vec_id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        model = Quantiser.train(np.stack(pdf["v"].to_numpy()).astype(float))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "centres": [model.centres.astype("<f8").tobytes()]})

    return few.groupBy("dim").applyInPandas(run, "dim int, centres binary")


def search(vectors: DataFrame, top: int = TOP, step: int = QUERY_STEP, depth: int = DEPTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each usable row whose vec_id is divisible by ``step``, the
    ``top`` rows found with the largest inner products, but for rows of its own vec_id.

    Vectors of different length don't meet. Repeated rows count once; different vectors of one vec_id
    are a candidate each, and their query's answers share a ranking. Fewer candidates give fewer rows; an empty
    table gives none.
    """
    rows = cut(usable(vectors), "vectors")
    kind = dict(rows.dtypes)["v"]
    # One row for each length of vectors.
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % step == 0).alias("q"))
    counts = sizes.collect()
    models = {r["dim"]: Quantiser(r["dim"], np.frombuffer(r["centres"]).reshape(-1, CENTRES, SUB), parallel_weight(r["dim"])) for r in trained(rows, sizes).collect()}
    n_blocks = max([1, *(max(math.ceil(r["n"] / ROWS), min(SPREAD, math.ceil(r["n"] / 512))) for r in counts)])
    q_blocks = max([1, *(math.ceil(r["q"] / QUERIES) for r in counts)])
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                model, v = shared.value[int(dim)], np.stack(own["v"].to_numpy()).astype(float)
                codes = model.encode(v)
                yield own.assign(code=[x.tobytes() for x in pack(codes)], residual=np.linalg.norm(v - model.shown(codes), axis=1))

    # A class is a vector with its copies, named by their smallest id; classes are coded and scanned.
    classes = rows.groupBy("dim", "v").agg(F.min("vec_id").alias("vec_id"), F.bool_or(F.col("vec_id") % step == 0).alias("asks"))
    coded = cut(classes.select("vec_id", "v", "dim", "asks").mapInPandas(code, f"vec_id long, v {kind}, dim int, asks boolean, code binary, residual double"), "coded")
    deal = F.xxhash64("vec_id", F.lit(1))
    data = coded.select("vec_id", "v", "dim", "code", "residual", F.pmod(deal, F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("group"), F.lit(False).alias("query"))
    queries = coded.where("asks").select("vec_id", "v", "dim", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("residual"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(deal, F.lit(q_blocks)).cast("int").alias("group"), F.lit(True).alias("query"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        model = shared.value[int(pdf["dim"].iloc[0])]
        q, d = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("vec_id")
        if not len(q) or not len(d):
            return pd.DataFrame({"q": [], "d": [], "score": []}).astype({"q": "int64", "d": "int64", "score": "float64"})
        qv, dv = np.stack(q["v"].to_numpy()).astype(float), np.stack(d["v"].to_numpy()).astype(float)
        packed = np.frombuffer(b"".join(d["code"]), np.uint8).reshape(len(d), -1)
        qi, di, slack = q["vec_id"].to_numpy(), d["vec_id"].to_numpy(), SIGMAS * d["residual"].to_numpy() / math.sqrt(dv.shape[1])
        k, most = min(max(depth, top + 1), len(d)), min(top + 1, len(d))  # one more than asked for, as a query may find itself
        for at in range(0, len(q), 128):
            asked = qv[at : at + 128]
            near = model.scan(asked, packed)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            score = np.stack([_exact(dv[b], x[None, :]) for b, x in zip(best, asked, strict=True)])
            worst = np.partition(score, k - most, axis=1)[:, k - most]
            able = near + np.linalg.norm(asked, axis=1)[:, None] * slack[None, :] >= worst[:, None]
            np.put_along_axis(able, best, False, axis=1)
            for i, x in enumerate(asked):
                more = np.flatnonzero(able[i])
                rows_, scores = np.append(best[i], more), np.append(score[i], _exact(dv[more], x[None, :]))
                order = np.lexsort((di[rows_], -scores))[:most]
                found.append((di[rows_[order]], scores[order]))
        return pd.DataFrame({"q": np.repeat(qi, most), "d": np.concatenate([d for d, _ in found]), "score": np.concatenate([s for _, s in found])})

    pairs = data.unionByName(queries).groupBy("dim", "block", "group").applyInPandas(scan, "q long, d long, score double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    kept = cut(pairs.withColumn("r", best).where(F.col("r") <= top + 1).drop("r"), "kept")
    # Classes become rows again. Of a class only the smallest ids can be among the best: one more than
    # asked for, as a query may be one of them.
    ids = cut(rows.join(classes.select("v", F.col("vec_id").alias("class")), "v").select("vec_id", "class"), "ids")
    turn = F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))
    few = ids.withColumn("k", turn).where(F.col("k") <= top + 1).select("vec_id", F.col("class").alias("d"))
    asking = ids.where(F.col("vec_id") % step == 0).toDF("query_id", "q")
    found = kept.join(few, "d").join(asking, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
