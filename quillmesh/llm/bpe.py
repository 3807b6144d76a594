"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. Tier one: a minimal
perfect hash over the vocabulary's byte strings resolves a pre-token that is
itself a token. Tier two: any other pre-token starts as a doubly linked list of
bytes, and a heap of (rank, place) yields the next merge until none is left.

The vocabulary is read on the driver from a path given as a parameter and
broadcast; it is bounded by the vocabulary's size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, mix64, offsets, text_slices

#: Pre-tokens remembered by a Python worker; beyond that it forgets them all.
REMEMBERED = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each rank, from lines of ``base64 rank``."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [token for _, token in pairs]


class PerfectHash:
    """A minimal perfect hash: n keys to 0..n-1 by one stored seed per bucket (hash and displace).

    ``slot`` gives some place for any key; the caller compares the key that is
    stored there, so a foreign key is never mistaken for a member.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        codes = np.array([self.code(k) for k in keys], dtype=np.uint64)
        if len(np.unique(codes)) != self.n:
            raise ValueError("two keys are equal, or share 64 bits of their digest")
        bucket = (codes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = offsets(size)
        self.seeds, taken = np.zeros(self.buckets, dtype=np.int64), np.zeros(self.n, dtype=bool)
        tried = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            mine, base = codes[order[start[b] : start[b + 1]]], 0
            while True:  # 256 seeds at a time; the first that puts the bucket on free places of its own
                at = self.place(mine[None, :], tried[:, None] + np.uint64(base))
                line = np.sort(at, axis=1)
                good = np.flatnonzero((line[:, 1:] != line[:, :-1]).all(axis=1) & ~taken[at].any(axis=1))
                if len(good):
                    break
                base += len(tried)
            taken[at[good[0]]], self.seeds[b] = True, base + good[0]
        alone = np.flatnonzero(size == 1)
        self.seeds[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]  # a bucket of one names its place outright

    @staticmethod
    def code(key: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")

    def place(self, codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix64(codes + seeds * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, all at once."""
        codes = np.array([self.code(k) for k in keys], dtype=np.uint64)
        seeds = self.seeds[(codes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(seeds < 0, -1 - seeds, self.place(codes, np.maximum(seeds, 0).astype(np.uint64)))


class Encoder:
    """Encodes and decodes with one vocabulary; cheap to pickle, so it can be broadcast."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        self.at = np.zeros(len(tokens), dtype=np.int64)  # rank by slot
        self.at[self.hash.slot(tokens)] = np.arange(len(tokens))
        self._ready = False

    def __getstate__(self):
        return self.__dict__ | {"_ready": False, "_byte": None, "_pair": None, "_split": None, "_known": None}

    def _wake(self) -> None:
        if not self._ready:
            rank = {t: i for i, t in enumerate(self.tokens)}
            self._byte = [rank[bytes([b])] for b in range(256)]
            # Which token two neighbours make: every way of cutting a token into two tokens.
            self._pair = {x << 32 | y: i for i, t in enumerate(self.tokens) for k in range(1, len(t)) if (x := rank.get(t[:k])) is not None and (y := rank.get(t[k:])) is not None}
            self._split = regex.compile(self.pattern)
            self._known: dict[str, bytes] = {}
            self._ready = True

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: linked bytes, merged lowest rank first, leftmost of equals first."""
        pair = self._pair.get
        ids = [self._byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or pair(ids[i] << 32 | ids[j]) != r:
                continue  # merged away, or one side has grown since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pair(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := pair(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Resolve pre-tokens that are not remembered: the perfect hash first, then merges."""
        pieces = [w.encode("utf-8") for w in words]
        ranks = self.at[self.hash.slot(pieces)].tolist() if pieces else []
        for word, piece, r in zip(words, pieces, ranks):
            if self.tokens[r] == piece:
                self._known[word] = r.to_bytes(4, "little")
            else:
                self._known[word] = b"".join([x.to_bytes(4, "little") for x in self.merge(piece)])

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self._wake()
        words = [self._split.findall(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known = {}
        fresh = set().union(*words).difference(self._known) if words else set()
        self.learn(list(fresh))
        known = self._known.__getitem__
        return [b"".join(map(known, w)) for w in words]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Token ids of every whole text, as doc_id, ids (binary: little-endian unsigned 32-bit).

    With ``decode`` the ids are also decoded again, as column ``decoded`` (binary).
    One row per input row, repeated rows and null ids included. A null text counts
    as empty; an empty text has no ids. A very long text is split by the pattern
    like any other, so memory is a small multiple of its own size. Only the two
    columns named are read, so other columns' names cannot clash.
    """
    lean(docs)
    shared = docs.sparkSession.sparkContext.broadcast(encoder(vocabulary, pattern))
    schema = "doc_id long, ids binary" + ", decoded binary" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for part in text_slices(batches):
            packed = coder.encode_packed(["" if t is None else t for t in part.column("text").to_pylist()])
            out = [part.column("doc_id"), pa.array(packed, pa.binary())]
            if decode:
                out.append(pa.array([coder.decode(p) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows (doc_id, ids) as ``encode_documents`` makes them; null ids count as empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(encoder(vocabulary, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.decode(p or b"") for p in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(run, "doc_id long, decoded binary")
