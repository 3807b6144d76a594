"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most
three bits differ in at most three bytes, so they share five of them or more. Any
five of eight positions hold three of the first four or three of the last four:
posting lists are kept for those eight triples of positions, which finds every
such pair and keeps lists short. In a list, pairs are tallied for shared positional
bytes (by comparing their eight bytes at once, not list by list, which would count
each pair of copies up to eight times), those with the guaranteed five or more are kept and verified by counting bits.

A list longer than ``LIST`` is replaced by finer ones, one for each five positions
above its triple; a pair in it shares one of these. Equal fingerprints are one
entry throughout, and a list yields the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, lean, text_slices
from .components import components

#: Entries up to which a posting list is handled as one row.
LIST = 1024
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the runs of ``shingle`` lower-cased A-Z words, in order; of all words if they are fewer, none of no words."""
    words = text.lower().split()
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_of(joined, seed)] if words else [], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-1])
    return np.array([hash_of(joined[a:z], seed) for a, z in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of lower-cased A-Z words: a bit is set if it is in over half of the shingles' hashes."""
    h = shingle_hashes(text, shingle, seed)
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65536):
        votes += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; a null text has no words, so its fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fp = [fingerprint((t or "").encode("utf-8"), shingle, seed) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    lean(docs)
    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near(one: np.uint64, many: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``many`` share enough positional bytes with ``one`` and, verified, differ in at most ``bits`` bits."""
    other = many ^ one
    tally = (other.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    hit = tally >= 8 - bits
    hit[hit] = np.bitwise_count(other[hit]) <= bits
    return hit


def forest(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints.

    Each entry is taken once and compared with those not yet reached, so a dense
    group costs little more than reading it. Among many that share five bytes the
    other 24 bits are probed instead: every pattern of up to ``bits`` flips.
    """
    left, a, b = fps.copy(), [], []
    varying = int(np.bitwise_or.reduce(fps ^ fps[0])) if len(fps) else 0
    places = [i for i in range(64) if varying >> i & 1]
    flips = None
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            now = queue.pop()
            if flips is None and len(left) > 50_000 and len(places) <= 24:
                flips = np.array([sum(1 << i for i in c) for n in range(1, bits + 1) for c in combinations(places, n)], dtype=np.uint64)
                left = np.sort(left)
            if flips is not None:
                want = flips ^ now
                at = np.minimum(np.searchsorted(left, want), len(left) - 1)
                at = np.unique(at[left[at] == want])
                found = left[at]
                # Removing by place keeps the rest sorted; nothing found costs nothing.
                left = np.delete(left, at) if len(at) else left
            else:
                hit = near(now, left, bits)
                found = left[hit]
                left = left[~hit] if len(found) else left
            queue.extend(found)
            a.extend([int(now)] * len(found))
            b.extend(found.tolist())
    return a, b


def _edges(rows: Iterator[np.ndarray], bits: int) -> pa.RecordBatch:
    a: list[int] = []
    b: list[int] = []
    for fps in rows:
        if len(fps) == 2:
            x = int(fps[0] ^ fps[1])
            if x.bit_count() > bits or sum(x >> s & 255 == 0 for s in range(0, 64, 8)) < 8 - bits:
                continue
            more = [int(fps[0])], [int(fps[1])]
        else:
            more = forest(fps, bits)
        a += more[0]
        b += more[1]
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])


def _byte(fp, i: int):
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _key(fp, positions: tuple[int, ...], tag: int):
    out = F.lit(tag).cast("long")
    for i in positions:
        out = F.shiftleft(out, 8) + _byte(fp, i)
    return out


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """a, b: edges that connect exactly the fingerprints (column fp, distinct) which chains of at most ``bits`` bits' difference connect."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees links of up to three bits")

    def of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            flat, at = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets)
            at = at - at[0] if len(at) else at
            yield _edges((flat[x:z] for x, z in zip(at.tolist(), at[1:].tolist())), bits)

    def of_group(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_edges(iter([np.unique(group.column("fp").to_numpy().view(np.uint64))]), bits)])

    def sized(posts: DataFrame) -> DataFrame:
        """Posting rows with their list's length, those alone left out; stored, as they are read more than once."""
        many = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return checkpointed(posts.join(many, "key"))

    def short(posts: DataFrame) -> DataFrame:
        return posts.where(F.col("n") <= LIST).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(of_lists, "a long, b long")

    fp = F.col("fp")
    first = sized(distinct.select("fp", F.explode(F.array(*(_key(fp, t, n) for n, t in enumerate(TRIPLES)))).alias("key")))
    finer = [F.when(F.shiftright("key", 24) == n, F.array(*(_key(fp, five, sum(1 << i for i in five)) for five in combinations(range(8), 5) if set(t) <= set(five)))) for n, t in enumerate(TRIPLES)]
    second = sized(first.where(F.col("n") > LIST).select("fp", F.explode(F.coalesce(*finer)).alias("key")).distinct())
    long = second.where(F.col("n") > LIST).groupBy("key").applyInArrow(of_group, "a long, b long")
    return short(first).unionByName(short(second)).unionByName(long)


#: Share of all rows from which a fingerprint is hot; there are fewer hot ones than one over it.
HOT_SHARE = 0.001


def near_duplicates(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable by links of at most ``bits`` differing bits.

    One row per input row. Texts without words (null, empty) have fingerprint zero
    and are linked like any other. Rows with a null id are linked too but never name
    a component; if a component has no id at all, its component_id is null.
    Repeated rows are copies of each other. Other columns are left out, so their
    names cannot clash; an empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    least = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(least.select("fp"), bits))
    tree = least.join(roots, least["fp"] == roots["node"]).select("fp", "root", "low")
    named = tree.join(tree.groupBy("root").agg(F.min("low").alias("component")), "root").select("fp", "component")
    answers = checkpointed(least.join(named, "fp", "left").select("fp", "n", F.coalesce("component", "low").alias("component_id")))
    # Fingerprints of over HOT_SHARE of all rows, fewer than one over it, are looked up where the rows lie; no task gets all their rows.
    floor = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * HOT_SHARE
    hot = answers.where(F.col("n") > floor).select("fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot"))
    rows = prints.join(F.broadcast(hot), "fp", "left")
    cold = rows.where("_is_hot is null").select("doc_id", "fp").join(answers.where(F.col("n") <= floor).select("fp", "component_id"), "fp")
    return cold.select("doc_id", "fp", "component_id").unionByName(rows.where("_is_hot").select("doc_id", "fp", F.col("_hot").alias("component_id")))


def keep_first(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the least id, with all its columns.

    Rows with a null id cannot be named by a component, so they all stay. Of repeated
    rows of one id and text the least by its other columns' JSON stays; rows of one id whose
    texts differ stay each. An empty table stays empty; columns may have any name.
    """
    found = near_duplicates(docs, bits, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    number, text = column(docs, id_col).cast("long"), column(docs, text_col).cast("string")
    rows = docs.select(F.struct(*(column(docs, c) for c in docs.columns)).alias("_row"), number.alias("_id"), F.xxhash64(text, F.length(text)).alias("_key"))
    first = rows.join(found, rows["_id"] == found["_kept"], "left_semi").groupBy("_id", "_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return first.unionByName(docs.where(number.isNull()))
