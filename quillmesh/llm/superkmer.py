"""Windows dealt out as super-k-mers, and the sorting that finds equal ones.

Units are words or bytes. Every window of ``window`` units has a minimiser: the
least hash among its runs of ``gram`` units. Equal windows have equal minimisers,
so they meet in one bucket; consecutive windows of one minimiser travel there as
one packed string instead of one string each.

* Documents are dealt to homes by a hash of their id. A home first sends its
  distinct minimisers alone (six bytes each) and is told, a bit for each, which
  occur in another document too. A window whose minimiser does not goes no further.
  The hashes only ever rule windows out; what is equal is decided on the bytes.
* Grams that a sample shows to be frequent come last in the order, so a window that
  touches a frequent passage has a minimiser of its own surroundings, and only those
  within it share one. Which windows are equal does not depend on the sample.
* Of equal strings in a home only the one of the smallest document travels; for the
  others the answer is known at once. A bucket does the same with what it gets. A
  group of copies, however large, so sends one string per home.
* In a bucket, strings of a minimiser that only one document is left with are done.
  The windows of the others are sorted by most-significant digits; after each pass
  only groups of two or more that span two documents go on. What is left after the
  last digit is equal, byte for byte.

The result is, per document, the runs of units which a window covers that also
starts in a document of a smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema as _to_arrow_schema

from .common import distinct, lean, mix64, offsets, ranges, text_slices, tidy

#: Bytes of text that share a home, on average, up to so many homes. Every home may write to every bucket, so beyond
#: that homes and their number grow alike, with the square root of the input: 100 TB are 160,000 homes of 650 MB.
HOME_BYTES, HOMES = 16 << 20, 4_096
#: Documents looked at for frequent grams, at least; documents there that make one frequent; bits of the table of frequent grams, and most of these.
HOT_SAMPLE, HOT_DOCS, HOT_BITS, HOT_MOST = 4_000, 5, 22, 400_000
#: Windows of a bucket sorted at once; more are taken in turns by their minimisers.
SORT_WINDOWS = 400_000

WORDS, BYTES = "words", "bytes"
#: Space and 0x09-0x0D part words.
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


class Units:
    """The units of some texts (a string or binary array without nulls), one text after the other."""

    def __init__(self, texts: pa.Array, kind: str):
        self.kind = kind
        if kind == WORDS:
            data = np.frombuffer(b"".join(x + b" " for x in texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
            size = np.asarray(pc.binary_length(texts)).astype(np.int64) + 1
            blank = _BLANK[data]
            last = blank.copy()  # the blank right after a word
            last[1:] &= ~blank[:-1]
            last[:1] = False
            keep = ~blank | last
            self.bytes = np.where(blank, np.uint8(32), data)[keep]
            self.start = np.append(0, np.flatnonzero(self.bytes == 32) + 1)  # where words begin, and the end
            self.count = np.diff(np.append(0, np.cumsum(last)[np.cumsum(size) - 1])) if len(size) else np.zeros(0, dtype=np.int64)
        else:
            texts = texts.cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            self.count = np.diff(ends)
            body = texts.buffers()[2]
            self.bytes = np.frombuffer(body, dtype=np.uint8)[ends[0] : ends[-1]] if body is not None and len(texts) else np.zeros(0, dtype=np.uint8)

    def codes(self) -> np.ndarray:
        """A 64-bit number per unit; equal units have equal ones."""
        if self.kind == BYTES:
            return self.bytes
        return range_hash(self.bytes, self.start[:-1], self.start[1:] - 1)

    def span(self, first: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of runs of units."""
        if self.kind == BYTES:
            return first, first + units
        return self.start[first], self.start[first + units] - 1


def view64(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian numbers; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    view, size = view64(data), end - start
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(len(start))
    for k in range(int(-(-size.max() // 8)) if len(size) else 0):
        at = at[size[at] > 8 * k]
        out[at] = scramble(out[at] ^ digit(view, start[at], end[at], k))
    return mix64(out)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hash(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` units; one entry per run. ``codes`` are bytes, or a number per word."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if codes.dtype == np.uint8 and gram % 8 == 0:
        view = view64(codes)
        parts = [view[k : k + n] for k in range(0, gram, 8)]
    else:
        parts = [codes[k : k + n] for k in range(gram)]
    out = np.full(n, gram, dtype=np.uint64)
    for x in parts:
        out ^= x.astype(np.uint64)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width or not len(x) else np.minimum(x[: len(x) - (width - have)], x[width - have :])


class Runs:
    """Runs of consecutive windows of one text with one minimiser: text number, first unit, windows, minimiser's hash.

    ``hot`` tells by the leading bits of a gram's hash whether it comes last in the order.
    """

    def __init__(self, units: Units, window: int, gram: int, hot: np.ndarray | None = None):
        at = offsets(units.count)
        many = np.maximum(units.count - window + 1, 0)
        n = int(at[-1]) - window + 1
        self.text = self.first = self.many = np.zeros(0, dtype=np.int64)
        self.least = np.zeros(0, dtype=np.uint64)
        if n <= 0 or not many.any():
            return
        grams = gram_hash(units.codes(), gram)
        if hot is not None:
            grams >>= np.uint64(1)
            grams |= hot.take((grams >> np.uint64(63 - HOT_BITS)).view(np.int64)).astype(np.uint64) << np.uint64(63)
        least = sliding_min(grams, window - gram + 1)[:n]
        new = np.empty(n + 1, dtype=bool)
        new[0] = new[n] = True
        np.not_equal(least[1:], least[:-1], out=new[1:n])
        new[np.minimum(at, n)] = True  # a text begins
        new[np.minimum((at[:-1] + many)[units.count >= window], n)] = True  # windows that would run into the next text begin
        cut = np.flatnonzero(new)
        first, size = cut[:-1], np.diff(cut)
        text = np.searchsorted(at, first, side="right") - 1
        whole = first < at[text] + many[text]
        self.text, self.first, self.many, self.least = text[whole], first[whole], size[whole], least[first[whole]]


def digit(view: np.ndarray, at: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each range as a big-endian number, zeros after its end."""
    place = at + 8 * k
    out = view[np.minimum(place, len(view) - 1)].astype(np.uint64)
    short = np.clip(8 - (end - place), 0, 8).astype(np.uint64) * np.uint64(8)
    partial = short > 0
    out[partial] = np.where(short[partial] >= 64, np.uint64(0), out[partial] >> np.minimum(short[partial], np.uint64(63)) << np.minimum(short[partial], np.uint64(63)))
    return out


def split_groups(rows: np.ndarray, group: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: rows sorted by (group, key); only new groups that span two documents stay."""
    order = np.argsort(key, kind="stable")
    by = group[order]
    order = order[np.argsort(by.astype(np.uint16) if len(by) and by.max() < 1 << 16 else by, kind="stable")]
    rows, group, key = rows[order], group[order], key[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    if len(first):
        mine = doc[rows]
        size = np.where(np.minimum.reduceat(mine, first) < np.maximum.reduceat(mine, first), size, 0)
    return rows[ranges(first[size > 0], size[size > 0])], np.repeat(np.arange((size > 0).sum()), size[size > 0])


def least_of_groups(doc: np.ndarray, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the least document of its group (its own, if it is in none)."""
    least = doc.copy()
    if len(rows):
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        least[rows] = np.repeat(np.minimum.reduceat(doc[rows], heads), np.diff(np.append(heads, len(rows))))
    return least


def least_documents(data: np.ndarray, at: np.ndarray, end: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each byte range the least document among the equal ranges of its group here (its own, if none is equal)."""
    view, size = view64(data), end - at
    rows, group = split_groups(np.arange(len(at)), group, size.astype(np.uint64), doc)
    k = 0
    while len(rows) and 8 * k < int(size[rows].max()):
        rows, group = split_groups(rows, group, digit(view, at[rows], end[rows], k), doc)
        k += 1
    return least_of_groups(doc, rows, group)


def merged(doc: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit ranges by document, with overlapping ones joined: doc, key, first, last (exclusive)."""
    order = np.lexsort((first, key, doc))
    doc, key, first, last = doc[order], key[order], first[order], last[order]
    if not len(doc):
        return doc, key, first, last
    other = np.ones(len(doc), dtype=bool)
    other[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    number = np.cumsum(other)
    wide = int(last.max()) + 1
    reach = np.maximum.accumulate(last + number * wide) - number * wide  # the furthest end so far in this document
    fresh = other.copy()
    fresh[1:] |= first[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], key[at], first[at], reach[np.append(at[1:], len(doc)) - 1]


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for longs, as unsigned numbers."""
    one, two, three, four, five = (np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = turn(x.view(np.uint64) * two, 31) * one ^ (five + np.uint64(50))
    h = turn(h, 27) * one + four
    h ^= h >> np.uint64(33)
    h *= two
    h ^= h >> np.uint64(29)
    h *= three
    return h ^ h >> np.uint64(32)


def home_of(doc: np.ndarray, homes: int) -> np.ndarray:
    """The home of each document: where its text and all that is found out about it meet."""
    return np.mod(spark_xxhash64(doc).view(np.int64), homes)


#: What a packed string is known by: document, text, first unit, units, bytes, minimiser.
HOLDER = np.dtype([("doc", "<i8"), ("key", "<i8"), ("first", "<i4"), ("units", "<i4"), ("size", "<i4"), ("least", "<u8")])
#: Bits of a minimiser's hash that do not travel in the first pass.
SHORT = np.uint64(16)


def _binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def to_arrow_schema(schema) -> pa.Schema:
    return _to_arrow_schema(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))


def cuts(sorted_values: np.ndarray) -> list[int]:
    """Where each value of a sorted array begins, and the end."""
    return np.append(np.flatnonzero(np.diff(sorted_values, prepend=-1)), len(sorted_values)).tolist()


class Splitter:
    """Sizes, alphabet and the order of grams: what the tasks of one job share."""

    def __init__(self, kind: str, window: int, gram: int, parts: int, hot: np.ndarray | None):
        self.kind, self.window, self.gram, self.parts, self.hot = kind, window, gram, parts, hot
        self._table: np.ndarray | None = None

    def runs(self, home: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, Units, Runs]]:
        """Ids, keys, units and runs of a home's texts, a slice at a time."""
        if self.hot is not None and self._table is None:
            self._table = np.zeros(1 << HOT_BITS, dtype=np.uint8)
            self._table[self.hot] = 1
        for batch in text_slices(home.to_batches()):
            batch = batch.filter(pc.and_(batch.column("doc_id").is_valid(), batch.column("text").is_valid()))
            if batch.num_rows:
                units = Units(batch.column("text"), self.kind)
                yield np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key")), units, Runs(units, self.window, self.gram, self._table)

    def asked(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shortened minimisers, those of one bucket together and ascending, and their buckets."""
        key = distinct(key)
        part = (mix64(key) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        return key[order], part[order]


def ask(split: Splitter, home: pa.Table) -> pa.Table:
    """A home's distinct minimisers, and which of them two of its documents have, by bucket."""
    docs, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for ids, _, _, runs in split.runs(home):
        docs.append(ids[runs.text])
        keys.append(runs.least >> SHORT)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    doc, key = doc[order], key[order]
    head = np.flatnonzero(np.diff(key, prepend=np.uint64(1) << np.uint64(63)) != 0)
    both = np.zeros(0, dtype=np.uint64)
    if len(key):
        both = key[head][np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)]
    key, part = split.asked(key)
    at, number = cuts(part), home.column("home")[0].as_py() if home.num_rows else 0
    twice = np.zeros(len(key), dtype=bool)
    if len(both):
        twice = both[np.minimum(np.searchsorted(both, key), len(both) - 1)] == key
    squeeze, packs = zstandard.ZstdCompressor(level=1), []
    for a, z in zip(at, at[1:]):
        planes = key[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
        packs.append(squeeze.compress(np.ascontiguousarray(planes).tobytes()) + np.packbits(twice[a:z]).tobytes())
    many = np.diff(at)
    tidy()
    return pa.table({"part": pa.array(part[at[:-1]], pa.int32()), "home": pa.array(np.full(len(packs), number), pa.int32()), "n": pa.array(many, pa.int32()), "pack": _binary(packs)})


def answer(group: pa.Table) -> pa.Table:
    """For each home that asked a bucket, a bit per minimiser: whether another document has it too."""
    expand = zstandard.ZstdDecompressor()
    many = group.column("n").to_numpy().astype(np.int64)
    at = offsets(many)
    key, twice = np.zeros((int(at[-1]), 8), dtype=np.uint8), np.zeros(int(at[-1]), dtype=bool)
    for x, n, a in zip(group.column("pack").to_pylist(), many.tolist(), at.tolist()):
        bits = -(-n // 8)
        key[a : a + n, :6] = np.frombuffer(expand.decompress(x[: len(x) - bits]), dtype=np.uint8).reshape(6, n).T
        twice[a : a + n] = np.unpackbits(np.frombuffer(x[len(x) - bits :], dtype=np.uint8), count=n)
    key = key.view("<u8").ravel()
    order = np.argsort(key)
    same = key[order]
    same = same[1:] == same[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # A minimiser that one home has twice is alone there, or marked above with its equals.
    bits = [np.packbits(twice[a:z]).tobytes() for a, z in zip(at.tolist(), at[1:].tolist())]
    part = group.column("part").combine_chunks()
    out = pa.table({"home": group.column("home").combine_chunks(), "part": part, "bits": _binary(bits)})
    del key, twice, order, same
    tidy()
    return out


def told(split: Splitter, key: np.ndarray, bits: pa.Table) -> np.ndarray:
    """The shared ones, ascending, of a home's shortened minimisers."""
    key, part = split.asked(key)
    at, shared = cuts(part), np.zeros(len(key), dtype=bool)
    begin = dict(zip(part[at[:-1]].tolist(), zip(at, at[1:])))
    for p, x in zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist()):
        a, z = begin[p]
        shared[a:z] = np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=z - a)
    return np.sort(key[shared])


def equal_before(data: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of byte ranges by minimiser, and which of them in it equal the one before, byte for byte."""
    order = np.lexsort((view64(data)[start].astype(np.uint64), size, least))
    a, z = order[:-1], order[1:]
    maybe = np.flatnonzero((least[a] == least[z]) & (size[a] == size[z]))
    equal = np.zeros(len(order), dtype=bool)
    for some in np.array_split(maybe, max(1, int(size[a[maybe]].sum()) >> 22)) if len(maybe) else []:
        n = size[a[some]]
        same = data[ranges(start[a[some]], n)] == data[ranges(start[z[some]], n)]
        equal[some + 1] = np.logical_and.reduceat(same, offsets(n)[:-1])
    return order, equal


def decided(data: np.ndarray, start: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings a smaller document has too; and for all strings a number, equal for those of one minimiser."""
    order, equal = equal_before(data, start, head["size"].astype(np.int64), head["least"])
    done, family = np.zeros(len(head), dtype=bool), np.zeros(len(head), dtype=np.int64)
    if len(head):
        doc, least = head["doc"][order], head["least"][order]
        low = np.minimum.reduceat(doc, np.flatnonzero(~equal))
        done[order] = doc > low[np.cumsum(~equal) - 1]
        family[order] = np.cumsum(np.append(True, least[1:] != least[:-1])) - 1
    return done, family


def whole(head: np.ndarray) -> tuple[np.ndarray, ...]:
    """The unit ranges of strings, joined by document."""
    first = head["first"].astype(np.int64)
    return merged(head["doc"], head["key"], first, first + head["units"])


#: What goes from a home to a bucket: packed strings, or ranges that are decided and only pass through.
STRINGS, RANGES = 0, 1


def send(split: Splitter, home: pa.Table, bits: pa.Table) -> pa.Table:
    """A home's strings of shared minimisers, by bucket."""
    heads, strings = [], []
    if bits.num_rows:
        slices = list(split.runs(home))
        shared = told(split, np.concatenate([r.least >> SHORT for _, _, _, r in slices]), bits)
        for ids, keys, units, runs in slices if len(shared) else ():
            short = runs.least >> SHORT
            at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short)
            if not len(at):
                continue
            text, first = runs.text[at], runs.first[at]
            head = np.zeros(len(at), dtype=HOLDER)
            head["doc"], head["key"], head["least"] = ids[text], keys[text], runs.least[at]
            head["units"] = runs.many[at] + split.window - 1
            start, end = units.span(first, head["units"].astype(np.int64))
            head["size"], head["first"] = end - start, first - offsets(units.count)[text]
            heads.append(head)
            strings.append(units.bytes[ranges(start, end - start)])
    if not heads:
        return pa.table({"part": pa.array([], pa.int32()), "what": pa.array([], pa.int32()), "pack": _binary([])})
    head, data = np.concatenate(heads), np.concatenate(strings)
    del heads, strings
    start = offsets(head["size"].astype(np.int64))[:-1]
    done, _ = decided(data, start, head)
    known = whole(head[done])
    head, start = head[~done], start[~done]
    part = (mix64(head["least"] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(split.parts)).astype(np.int32)
    order = np.lexsort((head["doc"], part))
    head, start, part = head[order], start[order], part[order]
    at, squeeze, packs = cuts(part), zstandard.ZstdCompressor(level=1), []
    for a, z in zip(at, at[1:]):
        body = data[ranges(start[a:z], head["size"][a:z].astype(np.int64))]
        # Each field by itself: neighbours in it are alike.
        fields = b"".join(np.ascontiguousarray(head[f][a:z]).tobytes() for f in HOLDER.names)
        packs.append((z - a).to_bytes(8, "little") + squeeze.compress(fields + body.tobytes()))
    where, what = part[at[:-1]].tolist(), [STRINGS] * len(packs)
    if len(known[0]):
        number = home.column("home")[0].as_py()
        packs.append(squeeze.compress(np.stack(known).astype("<i8").tobytes()))
        where, what = [*where, number % split.parts], [*what, RANGES]
    del data, head, start
    tidy()
    return pa.table({"part": pa.array(where, pa.int32()), "what": pa.array(what, pa.int32()), "pack": _binary(packs)})


def by_home(found: tuple[np.ndarray, ...], homes: int) -> pa.Table:
    """home, pack: ranges (doc, key, first, last) packed by their document's home; as many rows as homes at most."""
    home = home_of(found[0], homes)
    order = np.lexsort((*found[::-1], home))
    home, found = home[order], tuple(c[order].astype(np.int64, copy=False) for c in found)
    at, squeeze = cuts(home), zstandard.ZstdCompressor(level=1)
    packs = [squeeze.compress(b"".join(c[a:z].tobytes() for c in found)) for a, z in zip(at, at[1:])]
    return pa.table({"home": pa.array(home[at[:-1]].astype(np.int32)), "pack": _binary(packs)})


def unpacked(packs: list[bytes]) -> tuple[np.ndarray, ...]:
    """The ranges (doc, key, first, last) of packs."""
    expand, parts = zstandard.ZstdDecompressor(), [np.zeros((4, 0), dtype=np.int64)]
    parts += [np.frombuffer(expand.decompress(x), dtype=np.int64).reshape(4, -1) for x in packs]
    return tuple(np.concatenate(parts, axis=1))


def windows_of(kind: str, window: int, data: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of strings that lie one after the other: byte ranges, string numbers, places in the string."""
    units, size = head["units"].astype(np.int64), head["size"].astype(np.int64)
    begin = offsets(size)[:-1]
    many = units - window + 1
    owner = np.repeat(np.arange(len(head)), many)
    relative = ranges(np.zeros(len(head), dtype=np.int64), many)
    if kind == BYTES:
        at = begin[owner] + relative
        return at, at + window, owner, relative
    # Words begin at a string's start and after each blank in it; a string has units - 1 blanks.
    starts = np.sort(np.concatenate([begin, np.flatnonzero(data == 32) + 1]))
    word = (offsets(units)[:-1])[owner] + relative
    last = word + window - 1
    ends = np.append(starts[1:] - 1, len(data))
    ends[offsets(units)[1:] - 1] = begin + size
    return starts[word], ends[last], owner, relative


def meet(split: Splitter, find: Callable, group: pa.Table) -> pa.Table:
    """A bucket: the ranges of its strings that a smaller document has too, by home."""
    expand, heads, body, known = zstandard.ZstdDecompressor(), [np.zeros(0, dtype=HOLDER)], [np.zeros(0, dtype=np.uint8)], []
    for x, what in zip(group.column("pack").to_pylist(), group.column("what").to_pylist()):
        if what == RANGES:
            known.append(x)
            continue
        n, raw, at = int.from_bytes(x[:8], "little"), expand.decompress(x[8:]), 0
        head = np.zeros(n, dtype=HOLDER)
        for f in HOLDER.names:
            head[f] = np.frombuffer(raw, dtype=HOLDER[f], count=n, offset=at)
            at += n * HOLDER[f].itemsize
        heads.append(head)
        body.append(np.frombuffer(raw, dtype=np.uint8, offset=at))
    head, data = np.concatenate(heads), np.concatenate(body)
    del heads, body
    out = [unpacked(known)]
    start = offsets(head["size"].astype(np.int64))[:-1]
    done, family = decided(data, start, head)
    out.append(whole(head[done]))
    # Of the rest, minimisers that one document is left with have nothing more to find.
    go = np.flatnonzero(~done)
    order = go[np.lexsort((head["doc"][go], family[go]))]
    if len(order):
        doc, mine = head["doc"][order], family[order]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        many = np.diff(np.append(first, len(order)))
        order = order[np.repeat(doc[first] < doc[first + many - 1], many)]
    # Turns of whole families.
    windows = np.cumsum(head["units"][order].astype(np.int64) - split.window + 1)
    turn = windows // SORT_WINDOWS
    fresh = np.diff(family[order], prepend=-1) != 0
    turn = turn[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    at = cuts(turn)
    for a, z in zip(at, at[1:]):
        mine = order[a:z]
        some = head[mine]
        text = data[ranges(start[mine], some["size"].astype(np.int64))]
        place, end, owner, relative = windows_of(split.kind, split.window, text, some)
        doc = some["doc"][owner]
        number = np.cumsum(np.diff(family[mine], prepend=-1) != 0)
        hit = find(text, place, end, doc, number[owner]) < doc
        owner, relative = owner[hit], relative[hit]
        unit = some["first"][owner].astype(np.int64) + relative
        out.append(merged(doc[hit], some["key"][owner], unit, unit + split.window))
    del data, head, start, family, done
    found = merged(*(np.concatenate([o[i] for o in out]) for i in range(4)))
    out = by_home(found, split.parts)
    tidy()
    return out


def frequent_grams(docs: DataFrame, n: int, kind: str, gram: int, parts: int) -> np.ndarray | None:
    """Leading bits of grams that HOT_DOCS documents of a sample have, HOT_MOST at most; the sample grows with the number of buckets."""
    share = min(1.0, max(HOT_SAMPLE, 2 * parts) / max(n, 1))
    sample = docs.select("text").where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    dealt = 12

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            units = Units(part.column("text"), kind)
            h = gram_hash(units.codes(), gram) >> np.uint64(1)
            at = offsets(units.count)
            many = np.maximum(units.count - gram + 1, 0)
            text = np.repeat(np.arange(len(many)), many)
            h = h[ranges(at[:-1], many)] >> np.uint64(63 - 40)  # 40 bits of the hash and 20 of the text's number
            h = distinct(h << np.uint64(20) | text.astype(np.uint64) & np.uint64((1 << 20) - 1)) >> np.uint64(20)
            to = (h % np.uint64(dealt)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            h, to = h[order], to[order]
            cut = cuts(to)
            yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]], pa.int32()), _binary([h[a:z].astype("<u8").tobytes() for a, z in zip(cut, cut[1:])])], ["part", "pack"])
        tidy()

    def count(group: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x, dtype="<u8") for x in group.column("pack").to_pylist()]))
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.diff(np.append(head, len(h)))
        keep = many >= HOT_DOCS
        value, many = h[head][keep], many[keep]
        top = np.argsort(-many, kind="stable")[: HOT_MOST // dealt]
        tidy()
        return pa.table({"h": pa.array((value[top] >> np.uint64(40 - HOT_BITS)).astype(np.int64))})

    found = sample.mapInArrow(read, "part int, pack binary").groupBy("part").applyInArrow(count, "h long").distinct().toArrow()
    hot = found.column("h").to_numpy()
    return np.sort(hot) if len(hot) else None


def without_repeats(docs: DataFrame, kind: str, window: int, gram: int, cut: Callable[[pa.RecordBatch, Callable[[int, int], np.ndarray | None]], pa.RecordBatch], schema, find: Callable = least_documents) -> DataFrame:
    """``cut`` applied to all rows of ``docs`` (doc_id, text, text_key, ...), a batch at a time.

    ``cut(batch, hits)`` returns a batch of ``schema``; ``hits(row, n)`` tells which
    of the row's n units lie in a window that a smaller doc_id has too, or None if
    none does. Rows with a null id or text are never hit. ``find`` sorts windows; see
    ``least_documents``.
    """
    lean(docs)
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    wanted = -(-size["bytes"] // HOME_BYTES)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), wanted if wanted <= HOMES else int((wanted * HOMES) ** 0.5))
    usable = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    # At most HOT_MOST numbers.
    shared = spark.sparkContext.broadcast(Splitter(kind, window, gram, parts, frequent_grams(usable, size["n"], kind, gram, parts)))
    empty_result = to_arrow_schema(schema).empty_table()

    def finish(home: pa.Table, packs: pa.Table) -> pa.Table:
        doc, key, first, last = unpacked(packs.column("pack").to_pylist())
        order = np.lexsort((key, doc))
        doc, key, first, last = doc[order], key[order], first[order], last[order]
        out = []
        for batch in text_slices(home.to_batches()):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()

            def hits(row: int, n: int) -> np.ndarray | None:
                if ids[row] is None or keys[row] is None:
                    return None
                a, z = int(np.searchsorted(doc, ids[row])), int(np.searchsorted(doc, ids[row], side="right"))
                mine = np.arange(a, z)[key[a:z] == keys[row]]
                return covered(first[mine], last[mine], n) if len(mine) else None

            out.append(cut(batch, hits))
        del doc, key, first, last, order
        tidy()
        return pa.Table.from_batches(out) if out else empty_result

    # The three meetings read the documents dealt by home in the same form, so Spark makes that exchange once.
    home = F.pmod(F.xxhash64(F.coalesce("doc_id", "text_key", F.lit(0).cast("long"))), F.lit(parts).cast("long")).cast("int")
    housed = docs.withColumn("home", home)
    asked = housed.groupBy("home").applyInArrow(lambda t: ask(shared.value, t), "part int, home int, n int, pack binary")
    bits = asked.groupBy("part").applyInArrow(answer, "home int, part int, bits binary")
    sent = housed.groupBy("home").cogroup(bits.groupBy("home")).applyInArrow(lambda t, b: send(shared.value, t, b), "part int, what int, pack binary")
    runs = sent.groupBy("part").applyInArrow(lambda t: meet(shared.value, find, t), "home int, pack binary")
    return housed.groupBy("home").cogroup(runs.groupBy("home")).applyInArrow(finish, schema)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in any of the ranges."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:n]) > 0
