"""Centroid clustering by Lloyd's rounds with Hamerly's bounds, in exact integers.

Each vector keeps an upper bound on the distance to its own centroid and one lower bound on
that to the second nearest. When centroids have moved, the first grows by its own centroid's
drift and the second shrinks by the largest drift of the others. While the upper bound stays below the
lower one, or below half the way from its centroid to the nearest other, the assignment holds and the vector
is not looked at. What is left gets its true distance, and if that does not decide, a full scan of
all centroids in integers. Bounds are rounded outwards, so they never decide a tie.

Vectors are stored once, in blocks, as a table bucketed by block. A round reads them beside the bounds
of the round before (bucketed alike, so nothing is shuffled) and writes new bounds: about 17 bytes a
vector, not the vectors. Sums are exact, so only vectors that change their cluster are added and taken off.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, column, discard, shared_dir, tidy

#: Components saturate here, so that a squared distance of 64 of them fits a long.
MOST = 1 << 27
#: Vectors of a bucket: a bucket is one task of a round.
BUCKET_ROWS = 250_000
#: Vectors of a block at most. A worker takes its blocks one after the other.
BLOCK_ROWS = 4_096
#: Relative slack of a bound: far more than the rounding of a square root and a sum.
SLACK = 1e-12


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of each row of ``x`` to each row of ``c`` (both int64)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every product and sum is an integer that a double holds exactly
        y, d = x.astype(np.float64), c.astype(np.float64)
        return ((y * y).sum(axis=1)[:, None] - 2 * (y @ d.T) + (d * d).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), and the bounds: at least its distance, at most the second's."""
    d = squared(x, centroids)
    at = d.argmin(axis=1)
    near = d[np.arange(len(x)), at]
    if len(centroids) == 1:
        second = np.full(len(x), np.inf)
    else:
        d[np.arange(len(x)), at] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64))
    return at.astype(np.uint16), np.sqrt(near.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)


class Round:
    """What a round knows of its centroids: how far each has moved, and half the way to the nearest other."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        self.drift = moved
        # What the others may have come nearer by: the largest drift, for its own centroid the second largest.
        order = np.argsort(-moved, kind="stable")
        self.others = np.full(k, moved[order[0]])
        self.others[order[0]] = moved[order[1]] if k > 1 else 0.0
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Assignments and bounds after this round's centroids moved, and how many vectors were scanned in full."""
        upper, lower = (upper + self.drift[at]) * (1 + SLACK), (lower - self.others[at]) * (1 - SLACK)
        hold = np.maximum(self.half[at], lower)
        loose = np.flatnonzero(~(upper < hold))
        if len(loose):
            own = ((x[loose] - self.centroids[at[loose]]) ** 2).sum(axis=1)
            upper[loose] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
            loose = loose[~(upper[loose] < hold[loose])]
        if len(loose):
            at = at.copy()
            at[loose], upper[loose], lower[loose] = scan(x[loose], self.centroids)
        return at, upper, lower, len(loose)


def change(x: np.ndarray, at: np.ndarray, before: np.ndarray | None, k: int) -> bytes | None:
    """What a block adds to each cluster's sums and count, as int64; None for nothing."""
    out = np.zeros((k, x.shape[1] + 1), dtype=np.int64)
    moved = np.arange(len(x)) if before is None else np.flatnonzero(at != before)
    if not len(moved):
        return None
    ones = np.concatenate([x[moved], np.ones((len(moved), 1), dtype=np.int64)], axis=1)
    for c, sign in ((at[moved], 1), (None if before is None else before[moved], -1)):
        if c is not None:
            for j in np.unique(c).tolist():
                out[j] += sign * ones[c == j].sum(axis=0)
    return out.tobytes()


BLOCK, BOUNDS = "block long, ids array<long>, x binary", "block long, cluster binary, upper binary, lower binary, change binary, scanned long"
FIELDS = pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("change", pa.binary()), ("scanned", pa.int64())])


def blocks(kept: DataFrame, dim: int) -> DataFrame:
    """Rows (id, v: array<long>) as blocks: ids, and components as one int32 matrix. A task's blocks are numbered by its partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()])], names=["block", "ids", "x"])
                n += 1
        tidy()

    return kept.mapInArrow(run, BLOCK)


class Store:
    """Bucketed tables of one run in the shared folder; ``drop`` deletes them."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.tag, self.count = spark, buckets, uuid.uuid4().hex, 0
        self.paths: dict[str, str] = {}

    def put(self, rows: DataFrame) -> str:
        self.count += 1
        name, path = f"quillmesh_{self.tag}_{self.count}", f"{shared_dir(self.spark)}/quillmesh/{self.tag}/{self.count}"
        rows.write.bucketBy(self.buckets, "block").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self.paths.pop(name))


def _changes(bounds: DataFrame, k: int, dim: int) -> tuple[list[list[int]], int]:
    """The sum of all blocks' changes as Python integers, and how many vectors were scanned. Each task gives one row of k x (dim + 1) numbers."""
    width = k * (dim + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanned = np.zeros(width, dtype=np.int64), 0
        for b in batches:
            scanned += sum(b.column("scanned").to_pylist())
            for one in b.column("change").to_pylist():
                if one is not None:
                    total += np.frombuffer(one, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([*total.tolist(), scanned], pa.int64())], names=["at", "n"])

    found = bounds.select("change", "scanned").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    flat = [0] * (width + 1)
    for r in found:
        flat[r["at"]] = int(r["n"])
    return [flat[j * (dim + 1) : (j + 1) * (dim + 1)] for j in range(k)], flat[-1]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", said: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid: every kept vector after ``rounds`` rounds and a last assignment.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x becomes the integer
    floor(scale * x). The first centroids are the k kept vectors of least sha256 of ``seed:id``. A centroid becomes the
    floor of its vectors' mean; an empty one stays. Ties go to the smaller number. Rounds in which nothing moves any
    more are left out: they would change nothing. ``said`` gets the number of vectors scanned in full, round by round.

    Repeated rows are vectors of their own. Rows with a null id are clustered, and become
    first centroids only after all others; of equal ids the smaller vector comes first. With fewer kept vectors than k there are as many
    clusters. Components beyond 2^27 either way saturate there, as a squared distance is a long. Other
    columns are left out, so their names cannot clash; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vec_col).cast("array<double>").alias("v")).where(F.size(v) == dim)
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(2.0 * MOST)), F.lit(-2.0 * MOST))), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    kept = rows.select("id", whole.alias("v"))
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids, k = np.array([r["v"] for r in first], dtype=np.int64), len(first)
    # Buckets follow the number of vectors, so that one is a task's worth at every size.
    store = Store(spark, max(spark.sparkContext.defaultParallelism, math.ceil(kept.count() / BUCKET_ROWS)))
    made = blocks(kept, dim)
    at_rest = store.put(made.repartition(store.buckets, "block"))
    data, state, sums, before = spark.table(at_rest), None, [[0] * (dim + 1) for _ in range(k)], None

    def beside(name: str) -> DataFrame:
        return data.join(spark.table(name).select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")

    for _ in range(rounds):
        now = Round(centroids, before)
        new = store.put((data if state is None else beside(state)).drop("ids").mapInArrow(_round(now, k, dim), BOUNDS))
        if state is not None:
            store.drop(state)
        state = new
        delta, scanned = _changes(spark.table(state), k, dim)
        if said is not None:
            said.append(scanned)
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, delta)]
        before, centroids = centroids, np.array([[s // x[-1] for s in x[:-1]] if x[-1] else c for x, c in zip(sums, centroids.tolist())], dtype=np.int64)
        if (before == centroids).all():
            break
    rows = checkpointed((data if state is None else beside(state)).mapInArrow(_last(Round(centroids, before), dim), "vec_id long, cluster int, distance long"))
    for name in list(store.paths):
        store.drop(name)
    total = {r["cluster"]: int(r["n"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    table = spark.createDataFrame([(c, n, sum(total.values()), centroids[c].tolist()) for c, n in total.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _matrix(x: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(x, dtype="<i4").reshape(-1, dim).astype(np.int64)


def _round(now: Round, k: int, dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _matrix(row["x"], dim)
            if "cluster" in row:
                old = np.frombuffer(row["cluster"], dtype=np.uint16)
                at, upper, lower, scanned = now.assign(x, old, np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))
            else:
                old, (at, upper, lower), scanned = None, scan(x, now.centroids), len(x)
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "cluster": at.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "change": change(x, at, old, k), "scanned": scanned}], schema=FIELDS)
        tidy()

    return run


def _last(now: Round, dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _matrix(row["x"], dim)
            if "cluster" in row:
                at = now.assign(x, np.frombuffer(row["cluster"], dtype=np.uint16), np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))[0]
            else:
                at = scan(x, now.centroids)[0]
            own = ((x - now.centroids[at]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(at.astype(np.int32)), pa.array(own)], names=["vec_id", "cluster", "distance"])
        tidy()

    return run

