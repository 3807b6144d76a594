"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # the GNU C library has it
except (AttributeError, OSError):
    _TRIM = None

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000
#: Text handled at once inside a Python worker, in characters.
SLICE_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process, a temporary folder is set; on a
    cluster that is an error, as no folder of one machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/quillmesh-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder, with its lineage cut, and where it is.

    The files are an ordinary Parquet table, so a lost executor costs no more
    than the tasks that it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; it stays there, as results may be read at any time."""
    return stored(df)[0]


def in_few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more partitions than ``each`` rows fill: a small table should not be hundreds of files."""
    return df.coalesce(max(1, -(-rows // each)))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lean(df: DataFrame) -> None:
    """Let Arrow batches of this session hold BATCH_ROWS rows at most: one with texts exists several times, in Spark and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))


def column(df: DataFrame, name: str):
    """The column called ``name``, dots and backquotes in it taken literally."""
    return df["`" + name.replace("`", "``") + "`"]


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``chars`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one keeps another task cannot have."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Starts of runs of these lengths, with the total at the end."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Each value once, ascending."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    at = offsets(lengths)
    return np.arange(at[-1], dtype=np.int64) + np.repeat(starts - at[:-1], lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_key of ``docs``; rows of one id and one text share a key."""
    text = column(docs, text_col).cast("string")
    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text, F.length(text)).alias("text_key"))
