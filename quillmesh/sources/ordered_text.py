"""One text file in order, larger than a row or a task: written by many tasks, stitched at byte offsets.

Lines are dealt by ranges of their order, so a task holds a part of the file; it writes that part beside
the target and tells its size. Sums of the sizes are the parts' offsets. On a file system that can write in the middle
of a file every part is then copied to its place by a task of its own; elsewhere one task copies them one after the other, a
piece at a time. The target is made under another name and moved, so it is whole or not there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import Folder

#: Lines of a part, about; bytes copied at a time.
PART_LINES, PIECE = 1_000_000, 1 << 22


def _parts(root: str):
    """Write a task's lines; gives its place (ranges are numbered in order), and its part's name and size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = Folder(root)._at()
        name, size = uuid.uuid4().hex, 0
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in batches:
                data = "".join(x for x in b.column("_text").to_pylist() if x is not None).encode("utf-8")
                size += len(data)
                out.write(data)
        yield pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "size": pa.array([size], pa.int64())})

    return run


def _copy(where: fs.FileSystem, part: str, write) -> None:
    with where.open_input_stream(part, compression=None) as f:
        while piece := f.read(PIECE):
            write(piece)


def _placed(root: str, target: str):
    """Copy parts to their offsets in a file that is there already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = Folder(root)._at()
        for b in batches:
            for name, offset in zip(b.column("name").to_pylist(), b.column("offset").to_pylist()):
                out = os.open(target, os.O_WRONLY)
                try:
                    os.lseek(out, offset, os.SEEK_SET)
                    with os.fdopen(os.dup(out), "wb") as f:
                        _copy(where, f"{base}/{name}", f.write)
                finally:
                    os.close(out)
            yield b

    return run


def _joined(root: str, target: str):
    """Copy all parts, in order, into one file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = Folder(root)._at()
        with where.open_output_stream(target, compression=None) as out:
            for b in batches:
                for name in b.column("name").to_pylist():
                    _copy(where, f"{base}/{name}", out.write)
                yield b

    return run


def write_ordered(lines: DataFrame, order: list[str], text: Column, path: str, head: str = "", parts: int | None = None) -> int:
    """Write ``head`` and then ``text`` of every row of ``lines``, by ``order`` (ascending, nulls first), as one file; its size in bytes.

    A text has its own line end, if it is to have one; a null one is left out. Rows of equal order come in the order of their texts. Without rows the file is the head alone.
    An existing file is replaced.
    """
    spark, folder = lines.sparkSession, path.rpartition("/")[0] or "."
    root = f"{folder}/_parts-{uuid.uuid4().hex}"
    rows = lines.select(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), text.cast("string").alias("_text"))
    names = [f"_o{k}" for k in range(len(order))]
    parts = parts or max(1, -(-rows.count() // PART_LINES))
    schema = "place int, name string, size long"
    dealt = rows.repartitionByRange(parts, *names, "_text").sortWithinPartitions(*names, "_text")
    made = dealt.mapInArrow(_parts(root), schema)
    made.write.parquet(f"{root}/made")
    # A row for each part: their offsets are sums of their sizes.
    found = spark.read.schema(schema).parquet(f"{root}/made").orderBy("place").collect()
    offsets, at = [], len(head.encode("utf-8"))
    for r in found:
        offsets.append((r["name"], at))
        at += r["size"]
    where, base = Folder(folder)._at()
    last = path.rpartition("/")[2]
    new = f"_{last}.{uuid.uuid4().hex}"
    where.create_dir(base, recursive=True)
    table = spark.createDataFrame(offsets, "name string, offset long")
    if isinstance(where, fs.LocalFileSystem):
        with open(f"{base}/{new}", "wb") as f:
            f.write(head.encode("utf-8"))
            f.truncate(at)
        table.repartition(max(1, len(offsets))).mapInArrow(_placed(root, f"{base}/{new}"), table.schema).write.format("noop").mode("overwrite").save()
    else:
        Folder(root).write("head", head.encode("utf-8"))
        whole = spark.createDataFrame([("head", -1), *offsets], "name string, offset long")
        whole.coalesce(1).sortWithinPartitions("offset").mapInArrow(_joined(root, f"{base}/{new}"), whole.schema).write.format("noop").mode("overwrite").save()
    where.move(f"{base}/{new}", f"{base}/{last}")
    Folder(root).delete("")
    return at


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, sha256 and size of a file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), F.col("length").alias("size"))
