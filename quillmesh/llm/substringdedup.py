"""Substring dedup by super-k-mer partitioning of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .superkmer import WORDS, without_repeats

#: Words of a minimiser.
GRAM = 6


def remove_repeated_words(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop each word covered by ``window`` consecutive words that also start in a document of a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, kept (the words
    left, joined by one space). Words are runs of bytes other than space and
    0x09-0x0D. All windows are judged on the input.

    A null text has no words; so has an empty one. Rows with a null id are
    returned unchanged and remove nothing elsewhere. Repeated rows of one id and
    text get the same answer; equal ids never remove each other's words. Very long
    texts are one row like any other. Other columns are left out, so their names
    cannot clash; an empty table gives no rows.
    """

    def cut(b: pa.RecordBatch, hits) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        for row, text in enumerate(b.column("text").to_pylist()):
            words = (text or "").encode("utf-8").split()
            n.append(len(words))
            hit = hits(row, len(words))
            if hit is not None:
                words = [words[i] for i in np.flatnonzero(~hit).tolist()]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return without_repeats(keyed(docs, id_col, text_col), WORDS, window, min(GRAM, window), cut, "doc_id long, n_words long, n_removed long, kept string")
