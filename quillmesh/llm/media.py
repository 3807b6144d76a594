"""Media columns: chroma fingerprints of audio, and alignment of recordings.

A recording's spectrum is folded into twelve pitch classes per frame. Over an
integral image of these frames, sixteen filters compare the energy of rectangles
(two halves, stripes, checkers); each answer is quantised to two bits in Gray code,
so a frame gives a packed 32-bit integer. Equal integers of two recordings vote for
the offset between them, and the share of differing bits at the offset with most
votes tells whether they align.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import search_blocks
from .common import checkpointed, column, offsets, ranges

#: Samples of a frame and between frames; lowest and highest pitch counted, in hertz.
FRAME, HOP, LOW, HIGH = 1024, 256, 100.0, 1800.0
#: Filters: kind, first pitch class, pitch classes, frames. Thresholds of a filter are multiples of this.
WIDTH, QUANTUM = 8, 0.12
FILTERS = [(kind, low, high, wide) for kind, wide in (("halves", 8), ("stripes", 6), ("checkers", 8), ("rise", 4)) for low, high in ((0, 12), (0, 6), (6, 6), (3, 6))]
#: Shared integers that an alignment needs at its offset, and bits that may differ.
MIN_VOTES, MAX_ERROR = 4, 0.25


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in -1..1, channels averaged, and their rate; none for what is not 8-, 16-, 24- or 32-bit PCM."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), 0
    if width == 3:  # to 32 bits, with an empty lowest byte
        raw = raw[: len(raw) // (3 * channels) * 3 * channels]
        wide = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    kinds = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    if width not in kinds:
        return np.zeros(0), 0
    kind, zero, full = kinds[width]
    x = (np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], dtype=kind).astype(float) - zero) / full
    return x.reshape(-1, channels).mean(axis=1), rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def pitch_classes(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12: each frame's share of energy by pitch class."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0 or rate <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hertz >= LOW) & (hertz <= HIGH)
    fold = np.zeros((use.sum(), 12))
    fold[np.arange(use.sum()), np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % 12] = 1
    chroma = power[:, use] @ fold
    total = np.linalg.norm(chroma, axis=1, keepdims=True)
    return np.where(total > 1e-9, chroma / np.maximum(total, 1e-9), 0)


def packed_integers(chroma: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer per place where the widest filter fits."""
    n = len(chroma) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, low, high, wide in FILTERS:
        mid, top, half = low + high // 2, low + high, wide // 2
        if kind == "halves":
            a, b = area(0, wide, low, mid), area(0, wide, mid, top)
        elif kind == "stripes":
            a, b = area(0, wide, low + high // 3, top - high // 3), area(0, wide, low, top) - area(0, wide, low + high // 3, top - high // 3)
        elif kind == "checkers":
            a, b = area(0, half, low, mid) + area(half, wide, mid, top), area(0, half, mid, top) + area(half, wide, low, mid)
        else:
            a, b = area(half, wide, low, mid), area(0, half, low, mid)
        ratio = np.log((1 + a) / (1 + b))
        level = np.digitize(ratio, (-QUANTUM, 0.0, QUANTUM)).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprint(recordings: DataFrame, id_col: str = "vec_id", audio_col: str = "audio") -> DataFrame:
    """id, prints (array<long>): packed integers of every recording (binary WAV).

    Null, empty, foreign or very short audio has no integers; silence has those of
    silence. One row per input row, repeated rows and null ids included; other
    columns are left out, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                prints = [packed_integers(pitch_classes(*decode_wav(x))).astype(np.int64) for x in part.column("audio").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.list_(pa.int64()))], ["id", "prints"])

    return recordings.select(column(recordings, id_col).cast("long").alias("id"), column(recordings, audio_col).cast("binary").alias("audio")).mapInArrow(run, "id long, prints array<long>")


def alignments(flat: np.ndarray, start: np.ndarray, order: np.ndarray, query: np.ndarray, skip: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Every recording (by number) that aligns with ``query``: number, offset, votes, bit error.

    ``flat`` holds all recordings' integers, ``start`` where each begins, ``order``
    sorts ``flat``. Of a recording's offsets with MIN_VOTES and at most MAX_ERROR
    that of most votes counts, then the lower.
    """
    values = flat[order]
    low, high = np.searchsorted(values, query), np.searchsorted(values, query, side="right")
    hits = order[ranges(low, high - low)]
    if not len(hits):
        return []
    owner = np.searchsorted(start, hits, side="right") - 1
    offset = (hits - start[owner]) - np.repeat(np.arange(len(query)), high - low)
    wide = 1 << 32
    pair, votes = np.unique(owner * wide + (offset + wide // 2), return_counts=True)
    enough = (votes >= MIN_VOTES) & ~skip[pair // wide]
    pair, votes = pair[enough], votes[enough]
    out: dict[int, tuple[int, int, int, float]] = {}
    for i in np.lexsort((pair, -votes, pair // wide)).tolist():
        k, off = int(pair[i] // wide), int(pair[i] % wide) - wide // 2
        if k in out:
            continue
        a, z = max(0, off), min(int(start[k + 1] - start[k]), len(query) + off)
        mine = flat[start[k] + a : start[k] + z] ^ query[a - off : z - off]
        error = float(np.bitwise_count(mine).sum()) / (32 * len(mine))
        if error <= MAX_ERROR:
            out[k] = (k, off, int(votes[i]), error)
    return list(out.values())


def align(prints: DataFrame, every: int = 100, best_only: bool = False) -> DataFrame:
    """vec_id, n_prints, prints_crc32, class_id, match_id, match_offset, match_votes, match_error.

    Recordings of equal integers are one class, named by its least id; classes are
    searched, copies are not repeated. For each row whose id is divisible by
    ``every`` each alignment with another class is given, a row for each: all classes
    that have MIN_VOTES shared integers at one offset and at most MAX_ERROR differing
    bits there, or one row of nulls if none has; other rows have nulls. With ``best_only``
    the best of them alone is given (by bit errors, then votes, then id). ``match_id`` is
    a class: its copies are the rows of that class_id. ``match_offset`` is the frame of the
    match at which the query begins. Recordings without integers, and null ids, match nothing.
    Repeated rows are answered alike. An empty table gives no rows.
    """
    text = F.array_join("prints", ",")
    rows = checkpointed(prints.select("id", "prints", F.sha2(text, 256).alias("digest"), F.crc32(text).alias("prints_crc32")))
    classes = checkpointed(rows.where("id is not null and size(prints) > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.first("prints").alias("prints")))
    asked = rows.where((F.col("id") % every == 0) & (F.size("prints") > 0)).select("digest").distinct().join(classes, "digest").select("class_id", "prints")

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(queries):
            ids = index.column("class_id").to_numpy()
            by = np.argsort(ids, kind="stable")
            index, ids = index.take(pa.array(by)), ids[by]
            lists = index.column("prints").combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            start = offsets(np.array([len(x) for x in lists]))
            order = np.argsort(flat, kind="stable")
            for qid, q in zip(queries.column("class_id").to_pylist(), queries.column("prints").to_pylist()):
                found = alignments(flat, start, order, np.array(q, dtype=np.uint32), ids == qid)
                out += [(qid, int(ids[f[0]]), *f[1:]) for f in found]
        kinds = (("class_id", pa.int64()), ("match_id", pa.int64()), ("match_offset", pa.int64()), ("match_votes", pa.int64()), ("match_error", pa.float64()))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(kinds)})

    found = search_blocks(classes.select("class_id", "prints"), checkpointed(asked), "class_id", search, "class_id long, match_id long, match_offset long, match_votes long, match_error double")
    if best_only:
        found = found.groupBy("class_id").agg(F.min(F.struct("match_error", -F.col("match_votes"), "match_id", "match_offset", "match_votes")).alias("b"))
        found = found.select("class_id", "b.match_id", "b.match_offset", "b.match_votes", "b.match_error")
    found = found.withColumnRenamed("class_id", "_c")
    named = rows.join(classes.select("digest", "class_id"), "digest", "left")
    joined = named.join(found, (named["class_id"] == found["_c"]) & (named["id"] % every == 0), "left")
    return joined.select(F.col("id").alias("vec_id"), F.size("prints").cast("long").alias("n_prints"), "prints_crc32", "class_id", "match_id", "match_offset", "match_votes", "match_error")


def render(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rate: int = 4000, note: float = 0.09) -> DataFrame:
    """vec_id, audio: a WAV recording of each vector, one note per component, its pitch rising with the value (semitones from A3).

    A null vector has null audio, an empty one a rest; null or non-finite components are rests.
    One row per input row, repeated rows and null ids included; other columns are left out, so
    their names cannot clash; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(int(rate * note)) / rate
        fade = np.minimum(1, np.minimum(np.arange(len(t)), np.arange(len(t))[::-1]) / 20)
        notes = {n: np.sin(2 * math.pi * 220 * 2 ** (n / 12) * t) * fade * 0.5 for n in range(36)}
        rest = np.zeros(len(t))
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                audio = []
                for v in part.column("v").to_pylist():
                    keys = [None if x is None or not math.isfinite(x) else int(min(35, max(0, 18 + x * 48))) for x in v or ()]
                    audio.append(None if v is None else encode_wav(np.concatenate([rest if k is None else notes[k] for k in keys] or [rest]), rate))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(audio, pa.binary())], ["vec_id", "audio"])

    return vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, audio binary")
