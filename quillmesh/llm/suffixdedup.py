"""Suffix-array dedup: a radix sort of suffixes by most significant digits, only as deep as the threshold.

The first digit of a suffix is the least hashed 24-byte run within the threshold,
which equal windows share wherever it lies in them: it deals the suffixes out, and
those whose digit no other document has are dropped before any text moves. So
neighbouring suffixes of a text share one packed string; see ``superkmer``. Dealt by
their leading bytes each would have to move its 50 bytes by itself. In a
bucket every further pass is a counting sort of the suffixes still in play by their
next two bytes, from the first bytes to the threshold; those that have become unique,
or lie in one document only, drop out. The groups left after the last pass are the
windows that repeat, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, keyed
from .superkmer import BYTES, least_of_groups, split_groups, without_repeats

#: Bytes of the run by which suffixes are dealt out.
GRAM = 24

CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def equal_suffixes(data: np.ndarray, at: np.ndarray, end: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each suffix, cut off at ``end``, the least document among the equal ones of its group (its own, if none is equal).

    All are cut off at one depth. A digit is two bytes; a pass sorts stably by it (numpy counts 16-bit keys) and then by the groups so far.
    """
    rows, depth = np.arange(len(at)), int(end[0] - at[0]) if len(at) else 0
    for k in range(0, depth, 2):
        place = at[rows] + k
        key = data[place].astype(np.uint16) << np.uint16(8)
        if k + 1 < depth:
            key |= data[place + 1]
        rows, group = split_groups(rows, group[rows] if not k else group, key, doc)
        if not len(rows):
            break
    return least_of_groups(doc, rows, group)


def _kept(raw: bytes, hit: np.ndarray | None) -> bytes:
    return raw if hit is None else np.frombuffer(raw, dtype=np.uint8)[~hit].tobytes()


def remove_repeated_bytes(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop each byte covered by a ``window``-byte string that also starts in a document of a smaller id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (binary: the bytes left; cuts can fall inside a character).

    A null text counts as empty. Rows with a null id are returned unchanged and
    remove nothing elsewhere. Repeated rows of one id and text get the same answer;
    equal ids never remove each other's bytes. Texts shorter than the window stay
    whole. Other columns are left out, so their names cannot clash; an empty table
    gives no rows.
    """

    def cut(b: pa.RecordBatch, hits) -> pa.RecordBatch:
        n, gone, spans, kept = [], [], [], []
        for row, text in enumerate(b.column("text").to_pylist()):
            raw = (text or "").encode("utf-8")
            hit = hits(row, len(raw))
            n.append(len(raw))
            kept.append(_kept(raw, hit))
            gone.append(len(raw) - len(kept[-1]))
            spans.append(0 if hit is None else int((hit & ~np.append(False, hit[:-1])).sum()))
        numbers = [pa.array(x, pa.int64()) for x in (n, gone, spans)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return without_repeats(keyed(docs, id_col, text_col), BYTES, window, min(GRAM, window), cut, CUT, equal_suffixes)


def dedup_texts(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text_col``; all columns and rows stay.

    Where a cut leaves half a character, that character's remaining bytes go too,
    so the text stays valid. Nulls stay null.
    """
    text = column(docs, text_col).cast("string")
    rest = F.struct(column(docs, id_col).alias("id"), *(column(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col))
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.length(text)).alias("text_key"), rest.alias("rest"))

    def cut(b: pa.RecordBatch, hits) -> pa.RecordBatch:
        kept = []
        for row, t in enumerate(b.column("text").to_pylist()):
            raw = (t or "").encode("utf-8")
            kept.append(None if t is None else _kept(raw, hits(row, len(raw))).decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays([b.column("rest"), pa.array(kept, pa.string())], ["rest", "text"])

    out = without_repeats(rows, BYTES, window, min(GRAM, window), cut, T.StructType([rows.schema["rest"], T.StructField("text", T.StringType())]), equal_suffixes)
    return out.select(*((F.col("text") if c == text_col else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(docs.columns)))
