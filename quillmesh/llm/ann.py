"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of several learned rotations (principal
axes turned so that signs lose least, by alternating least squares). A code is cut
into 16-bit substrings (about the logarithm of a block's rows), each of which has its
own table. If two codes differ in at most r bits, then in some substring they differ in
no more than its share of r: probing every value within that share in every table
retrieves each code within r. Those are verified by counting bits and reranked by
the exact cosine.

A query's radius grows until k codes lie within it; then it is widened once by a margin
learned from a sample: what the codes of true neighbours lie beyond the k-th nearest
code there. So queries with near neighbours probe little.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import search_blocks
from .common import checkpointed, column, ranges, tidy

#: Bits of a code; vectors from which rotations and the margin are learned; the share of true neighbours that the margin must hold there.
BITS, TRAIN_VECTORS, HELD = 256, 4_096, 0.985
#: Bits of a substring; differing bits up to which its values are listed, beyond which the table's are compared.
SUB, LISTED = 16, 2

_FLIPS = [np.array([sum(1 << i for i in c) for n in range(s + 1) for c in combinations(range(SUB), n)], dtype=np.uint16) for s in range(LISTED + 1)]


class Codes:
    """Learned rotations, and the margin by which the nearest neighbours of the sample lie beyond the k-th nearest code."""

    def __init__(self, sample: np.ndarray, k: int, bits: int = BITS, seed: int = 5):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean, self.bits = unit.mean(axis=0), -(-bits // 64) * 64
        rows, dim = unit.shape
        draw, parts = np.random.default_rng(seed), []
        axes = np.linalg.svd(unit - self.mean, full_matrices=True)[2].T if rows > 1 else np.eye(dim)
        x = (unit - self.mean) @ axes
        for _ in range(-(-self.bits // dim)):
            turn = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
            for _ in range(15):
                u, _, v = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
                turn = (u @ v).T
            parts.append(axes @ turn)
        self.rotation = np.concatenate(parts, axis=1)[:, : self.bits]
        self.margin = self.bits
        if rows > 4 * k:
            some = draw.permutation(rows)[:256]
            like = unit[some] @ unit.T
            like[np.arange(len(some)), some] = -2
            best = np.argpartition(-like, k, axis=1)[:, :k]
            code = self.encode(sample)
            apart = np.stack([differing(code, code[i]) for i in some])
            apart[np.arange(len(some)), some] = 2 * self.bits
            kth = np.partition(apart, k - 1, axis=1)[:, k - 1]
            self.margin = int(np.quantile(np.take_along_axis(apart, best, axis=1) - kth[:, None], HELD))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings, one row per vector."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.rotation >= 0, axis=1).view("<u2")


def differing(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """In how many bits each of ``codes`` differs from ``code``."""
    return np.bitwise_count(np.ascontiguousarray(codes).view(np.uint64) ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1, dtype=np.int64)


class Tables:
    """One table per substring over a block of codes: places ordered by the substring's value."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.columns = [np.ascontiguousarray(code[:, j]) for j in range(code.shape[1])]
        self.order = [np.argsort(c, kind="stable") for c in self.columns]
        self.value = [c[o] for c, o in zip(self.columns, self.order)]
        self.probed = 0  # codes that the last search retrieved before it verified them

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all codes within ``radius`` bits of ``query``, and in how many bits each differs."""
        m = len(self.columns)
        hit = np.zeros(len(self.code), dtype=bool)
        share, more = divmod(radius + 1, m)  # shares + 1 sum to radius + 1, so not all can be exceeded
        for j in range(m):
            s = share - 1 + (j < more)
            if 0 <= s <= LISTED:
                values = _FLIPS[s] ^ query[j]
                low = np.searchsorted(self.value[j], values)
                hit[self.order[j][ranges(low, np.searchsorted(self.value[j], values, side="right") - low)]] = True
            elif s > LISTED:
                hit |= np.bitwise_count(self.columns[j] ^ query[j]) <= s
        at = np.flatnonzero(hit)
        self.probed = len(at)
        apart = differing(self.code[at], query)
        return at[apart <= radius], apart[apart <= radius]

    def near(self, query: np.ndarray, others: np.ndarray, k: int, margin: int) -> np.ndarray:
        """Places (of ``others`` only) of at least k codes, if there are so many, and of all within ``margin`` bits beyond the k-th nearest."""
        m, k = len(self.columns), min(k, int(others.sum()))
        for radius in range(m - 1, m * SUB + m, m):
            at, apart = self.within(query, radius)
            apart = apart[others[at]]
            if len(apart) >= k:
                break
        if not k:
            return np.zeros(0, dtype=np.int64)
        reach = int(np.partition(apart, k - 1)[k - 1]) + margin
        at, _ = self.within(query, min(reach, m * SUB))
        return at[others[at]]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines found for each row whose id is divisible by ``every``.

    All rows but those of the query's own id are candidates; all are indexed. A query
    gets k rows, or all candidates if there are fewer. Ties go to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component, take no part. Vectors are compared with those of their own
    length; each length has an index of its own. Components of any size are fine, as
    vectors are scaled by a power of two. Repeated rows count once. Other columns are
    left out, so their names cannot clash; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)).distinct()
    rows = checkpointed(rows)
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # an embedding column has one, or a few
    found = [_of_length(rows.where(F.size("v") == n), every, k, bits) for n in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring the largest component near 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _of_length(rows: DataFrame, every: int, k: int, bits: int) -> DataFrame:
    """query_id, vec_id, score: each block's k best, of rows (id, v) of one length."""
    sample = rows.select("v", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h", "v").limit(TRAIN_VECTORS).collect()
    learned = rows.sparkSession.sparkContext.broadcast(Codes(scaled(np.array([r["v"] for r in sample])), k, bits))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks()
        return scaled(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(queries):
            codes = learned.value
            x, ids = matrix(index), index.column("id").to_numpy()
            norm, tables = np.linalg.norm(x, axis=1), Tables(codes.encode(x))
            qs = matrix(queries)
            for qid, q, code in zip(queries.column("id").to_pylist(), qs, codes.encode(qs)):
                at = tables.near(code, ids != qid, k, codes.margin)
                # Summed in one order for every row, so equal vectors have equal scores wherever they lie; a matrix product does not promise that.
                score = np.einsum("ij,j->i", x[at], q) / (norm[at] * np.linalg.norm(q))
                for i in np.lexsort((ids[at], -score))[:k].tolist():
                    out.append((qid, int(ids[at[i]]), float(score[i])))
            tidy()
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    return search_blocks(rows, rows.where(F.col("id") % every == 0), "id", search, "query_id long, vec_id long, score double")
