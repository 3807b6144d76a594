"""Phrases mined by hashed counting (PCY, DHP) and Apriori pruning.

Pass p over the texts counts phrases of p words exactly, and on the way counts phrases of p + 1 words in
hashed buckets. A bucket that stays under the least count holds no frequent phrase. So two bitmaps are
broadcast to the next pass: buckets that reach the least count, and hashes of the frequent phrases of p words. A longer phrase
is counted only if its bucket's bit is set and both its parts without the last and the first word are (perhaps)
frequent. Bitmaps only ever let too much through, and what they let through is counted exactly.

A pass works on whole blocks of bytes: words become numbers of the block's own dictionary, and phrases are
told apart by those numbers, never by a hash. What a block counts is added up before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, lean, mix64, stored, text_slices, tidy

#: Bytes of text of a block; buckets of a bitmap at least and at most, a power of two (a bit each when broadcast, a byte each in a task).
BLOCK_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 1 << 16, 1 << 27
#: Bytes of text to a bucket: about four phrases.
BYTES_PER_BUCKET = 24
#: Buckets of a chunk, in which counts are added up.
CHUNK = 1 << 16
#: Parts that the first selection of a language's best is made in.
PARTS = 16

# Byte classes: 0 of a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Block:
    """The words of some texts: numbers of a dictionary, languages, hashes of phrases, and which words end a piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        text = pc.fill_null(text, "").cast(pa.large_string())
        at = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kind = _CLASS[data]
        word = kind == 0
        before = np.zeros(len(word) + 1, dtype=bool)
        before[1:] = word
        before[at] = False  # a text's first byte begins a word
        begin = np.flatnonzero(word & ~before[:-1])
        self.n = len(begin)
        place = np.cumsum(word)
        offsets = np.append(place[begin] - 1, place[-1] if len(place) else 0).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data][word])]).dictionary_encode()
        self.words, self.index = words.dictionary, words.indices.to_numpy().astype(np.int64)
        doc = np.searchsorted(at, begin, side="right") - 1
        langs = pc.fill_null(lang, "und").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)[doc]
        piece = np.cumsum(kind == 2)[begin] if self.n else np.zeros(0, dtype=np.int64)
        #: Whether a word and the next are of one piece.
        self.goes_on = np.zeros(self.n, dtype=bool)
        self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        hashed = lambda values: np.array([xxhash.xxh64_intdigest(v) for v in values.to_pylist()], dtype=np.uint64)
        self.hashes = [mix64(hashed(self.words)[self.index] + hashed(self.langs)[self.lang] * np.uint64(3))] if self.n else [np.zeros(0, dtype=np.uint64)]

    def hash(self, p: int) -> np.ndarray:
        """A hash of the p words from each word on, made of that of p - 1 words and the last one's."""
        while len(self.hashes) < p:
            last = np.zeros_like(self.hashes[0])
            k = len(self.hashes)
            last[: self.n - k] = self.hashes[0][k:]
            self.hashes.append(mix64(self.hashes[-1] * np.uint64(0x9E3779B97F4A7C15) + last))
        return self.hashes[p - 1]

    def in_piece(self, p: int) -> np.ndarray:
        """Where p words of one piece begin."""
        out = np.ones(self.n, dtype=bool)
        for k in range(p - 1):
            out &= shifted(self.goes_on, k)
        return out

    def counts(self, where: np.ndarray, p: int) -> pa.RecordBatch:
        """lang, phrase, n of the phrases of p words that begin at ``where``, counted exactly."""
        parts = [self.index[where + k] for k in range(p)]
        key = self.lang[where] * len(self.words) + parts[0]
        for part in parts[1:]:  # what is told apart so far gets small numbers, which keep the key within 64 bits
            key = np.unique(key, return_inverse=True)[1] * len(self.words) + part
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        spelt = [pc.take(self.words, pa.array(part[first])) for part in parts]
        phrase = spelt[0] if p == 1 else pc.binary_join_element_wise(*spelt, pa.scalar(" ", pa.large_string()))
        return rows(pc.take(self.langs, pa.array(self.lang[where[first]])).cast(pa.string()), phrase.cast(pa.string()), n)


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    """The value k words on; False beyond the end."""
    out = np.zeros_like(x)
    out[: max(0, len(x) - k)] = x[k:]
    return out


COUNTED = "lang string, phrase string, n long, chunk int, counts binary"


def rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["lang", "phrase", "n", "chunk", "counts"])


class Buckets:
    """Counts of hashed phrases in one task, none above ``least``: what only has to be reached need not be counted further."""

    def __init__(self, buckets: int, least: int):
        self.mask, self.least, self.count = np.uint64(buckets - 1), least, np.zeros(buckets, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique((hashes & self.mask).astype(np.uint32), return_counts=True)
        self.count[at] = np.minimum(self.count[at].astype(np.int64) + n, self.least)

    def chunks(self) -> Iterator[pa.RecordBatch]:
        """The counts, a chunk a row: all of them, or places and counts where those are shorter."""
        for k in range(0, len(self.count), CHUNK):
            part = self.count[k : k + CHUNK]
            some = np.flatnonzero(part)
            if len(some):
                data = part.tobytes() if 3 * len(some) >= CHUNK - 1 else some.astype("<u2").tobytes() + part[some].tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k // CHUNK], pa.int32()), pa.array([data])], names=["lang", "phrase", "n", "chunk", "counts"])


def bitmap(counted: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bits of the buckets whose counts reach ``least``: at most MOST_BUCKETS / 8 bytes.

    Chunks are dealt by number and added one row at a time; each comes to the driver as its bits alone.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(CHUNK, dtype=np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["chunk", "bits"])

        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, total = chunk, np.zeros(CHUNK, dtype=np.int64)
                if len(data) == CHUNK:
                    total += np.frombuffer(data, dtype=np.uint8)
                else:
                    n = len(data) // 3
                    total[np.frombuffer(data, dtype="<u2", count=n)] += np.frombuffer(data, dtype=np.uint8, offset=2 * n)
        if now is not None:
            yield done()

    out = np.zeros(max(buckets, CHUNK) // 8, dtype=np.uint8)
    chunks = counted.where("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    for r in chunks.mapInArrow(add, "chunk int, bits binary").collect():
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def is_set(bits: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    at = hashes & np.uint64(buckets - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _frequent(table: DataFrame, p: int, buckets: int) -> DataFrame:
    """Hashes of counted phrases (lang, phrase) of p words, as chunks of buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(buckets, 1)
        for b in batches:
            block = Block(b.column("phrase"), b.column("lang"))  # each phrase is a text of p words
            seen.add(block.hash(p)[::p])
        yield from seen.chunks()
        tidy()

    return table.select("lang", "phrase").mapInArrow(run, COUNTED)


def mined(docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, f: every phrase of up to ``longest`` words that occurs at least ``least`` times in a language, and (words 0, phrase '') the number of all its words.

    Words and pieces are as ``collocations`` has them. The result is a stored table.
    """
    if not 1 <= least <= 255 or longest < 2:
        raise ValueError("the least count must be 1 to 255, and phrases have two words at least")
    spark = docs.sparkSession
    lean(docs)
    source = docs.select(column(docs, text_col).cast("string").alias("text"), column(docs, lang_col).cast("string").alias("lang"))
    size = int(source.agg(F.sum(F.octet_length("text").cast("decimal(38,0)")).alias("n")).first()["n"] or 0)
    buckets = min(max(1 << max(0, (size // BYTES_PER_BUCKET - 1).bit_length()), LEAST_BUCKETS), MOST_BUCKETS)
    shared = spark.sparkContext.broadcast
    frequent = reached = None
    tables: list[DataFrame] = []
    for p in range(1, longest + 1):
        raw, at = stored(source.mapInArrow(_pass(p, p < longest, buckets, least, frequent, reached), COUNTED))
        f = F.sum("n").alias("f")
        words = F.when(F.col("phrase") == "", 0).otherwise(p).alias("words")
        counted, _ = stored(raw.where("chunk is null").groupBy("lang", "phrase").agg(f).where(f"f >= {least} or phrase = ''").select("lang", "phrase", words, "f"))
        tables.append(counted)
        if p < longest:
            reached = shared(bitmap(raw, buckets, least))
            frequent = shared(bitmap(_frequent(counted.where("words > 0"), p, buckets), buckets, 1))
        discard(spark, at)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _pass(p: int, more: bool, buckets: int, least: int, frequent, reached):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = Buckets(buckets, least) if more else None
        for b in text_slices(batches, chars=BLOCK_BYTES):
            block = Block(b.column("text"), b.column("lang"))
            if not block.n:
                continue
            here = block.in_piece(p)
            if p == 1:
                n = np.bincount(block.lang, minlength=len(block.langs))
                yield rows(block.langs.cast(pa.string()), pa.array([""] * len(n), pa.string()), n)
            else:
                known = is_set(frequent.value, block.hash(p - 1), buckets)
                here &= known & shifted(known, 1)
                here[here] = is_set(reached.value, block.hash(p)[here], buckets)
            if where := len(at := np.flatnonzero(here)):
                yield block.counts(at, p)
            if more and where:
                both = here & shifted(here, 1) & block.in_piece(p + 1)
                longer.add(block.hash(p + 1)[both])
        if more:
            yield from longer.chunks()
        tidy()

    return run


def first_words(phrase: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(1), k), " ")


def last_words(phrase: Column, words: Column, k: Column) -> Column:
    """What follows the first k words."""
    return F.array_join(F.slice(F.split(phrase, " "), k + 1, words - k), " ")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends (0A-0D), words at blanks and tabs. ``a`` counts a phrase's occurrences
    within pieces, overlaps included, and is at least ``least``; ``n`` counts all words of the language. A cut after
    k words has l and r for its two parts, and the score floor(1000000 a a / (l r)); the lowest score
    counts, of equal ones the first cut. A phrase inside a longer one that occurs at least ``share`` % as often is dropped.
    The best come by score, then a, then phrase in byte order.

    A null language is ``und``; a null or empty text has no words; repeated rows are counted each. Numbers are exact. Columns other
    than the two named are not read, so their names cannot clash; an empty table gives no rows. A text may be of any length that a row can have.
    """
    counted = mined(docs, least, longest, text_col, lang_col)
    sizes = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    some = counted.where("words > 0").select("lang", "phrase", "words", "f")
    found = some.where("words > 1").withColumnRenamed("f", "a")

    # Cuts: each part's count is found by an equi-join. Parts of a frequent phrase are frequent, so none is missing.
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", first_words(F.col("phrase"), F.col("k")).alias("left"), last_words(F.col("phrase"), F.col("words"), F.col("k")).alias("right"))
    part = lambda name, count: some.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.select("lang", "phrase", "words", "k", "a", "l", "r", (F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a")).alias("_over"), (wide("l") * wide("r")).alias("_under"))
    cuts = cuts.withColumn("score", F.expr("_over div _under").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    # Phrases inside a longer one.
    inner = found.where("words > 2").select("lang", "words", "a", "phrase", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "phrase", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    inner = inner.groupBy("lang", F.array_join(F.slice(F.split("phrase", " "), F.col("s"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)).drop("most")

    # The best of each part of a language first, so that no task sees a language whole.
    order = (F.desc("score"), F.desc("a"), "phrase")
    mine = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    parts = left.withColumn("_part", mine).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = parts.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # a row for each language
