"""EPUB books: a scan of many books into chapters, and a sink that writes copies with other bodies.

Archives are read as binary files by Spark, so any store that Spark reads will do;
each is opened in memory in the task that holds it.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import html as h
from ..functions.text import entry_path

CHAPTER = "book_id string, chapter_no int, file_path string, xhtml string, plain_text string, body_inner_html string, block_fragments array<string>"
SPINE = "book_id string, spine int, file_path string, xhtml string"


def normal_path(path: str) -> str:
    return path.replace("\\", "/").strip("/")


def spine_of(data: bytes, book_id: str) -> list[tuple[str, int, str, str]]:
    """(book_id, place, path, xhtml) of the spine's documents in reading order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = {normal_path(n): n for n in z.namelist()}
            tag = lambda e: e.tag.rpartition("}")[2]
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = normal_path(next(e.attrib["full-path"] for e in container.iter() if tag(e) == "rootfile"))
            package = ElementTree.fromstring(z.read(names[opf]))
            items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if tag(e) == "item"}
            out = []
            for place, ref in enumerate(e for e in package.iter() if tag(e) == "itemref"):
                path = normal_path(posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref.attrib["idref"]])))
                out.append((book_id, place, path, z.read(names[path]).decode("utf-8-sig")))
            return out
    except Exception as e:
        raise ValueError(f"Failed to read EPUB: {book_id}: {e}") from e


def chapters_of(spine: list[tuple[str, int, str, str]]) -> list[tuple]:
    """Rows of CHAPTER: documents without text are left out before chapters are numbered."""
    out: list[tuple] = []
    for book, _, path, xhtml in spine:
        plain = h.plain_text_of(xhtml)
        if xhtml.strip() and plain.strip():
            out.append((book, len(out) + 1, path, xhtml, plain, h.body_inner_of(xhtml), h.block_fragments_of(xhtml)))
    return out


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of all ``*.epub`` books under a path, one task per group of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path).select("path", "content")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHAPTER.split(", ")]
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(chapters_of(spine_of(bytes(content), name)), columns=names)

    return files.mapInPandas(scan, CHAPTER)


class EpubSource(DataSource):
    """``spark.read.format("epub").load(path)``: chapters of one local book or folder of books."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return CHAPTER

    def reader(self, schema) -> DataSourceReader:
        return _EpubReader(self.options["path"])


class _EpubReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.[eE][pP][uU][bB]"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            yield from chapters_of(spine_of(f.read(), partition.value))


def copy_with(data: bytes, bodies: dict[str, str]) -> bytes:
    """A copy of an archive with other bodies in the documents named; everything else as it is, mimetype first and stored."""
    bodies = {normal_path(p): b for p, b in bodies.items()}
    if "mimetype" in bodies:
        raise ValueError("mimetype cannot be replaced")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        infos = sorted(old.infolist(), key=lambda i: normal_path(i.filename) != "mimetype")
        missing = set(bodies) - {normal_path(i.filename) for i in infos}
        if missing:
            raise ValueError(f"not in the book: {', '.join(sorted(missing))}")
        for info in infos:
            path = normal_path(info.filename)
            raw = old.read(info)
            if path in bodies:
                raw = h.replace_body_of(raw.decode("utf-8-sig"), bodies[path]).encode("utf-8")
            new.writestr(info, raw, zipfile.ZIP_STORED if path == "mimetype" else info.compress_type)
    return out.getvalue()


def write_books(books: DataFrame, bodies: DataFrame) -> DataFrame:
    """book_id, content: copies of books (book_id, content) with bodies (book_id, file_path, body) put in."""
    parts = bodies.select("book_id", entry_path(F.col("file_path")).alias("p"), "body").groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "body"))).alias("_bodies"))
    rows = books.join(parts, "book_id", "left")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"book_id": b["book_id"], "content": [copy_with(bytes(c), {} if m is None else dict(m)) for c, m in zip(b["content"], b["_bodies"])]})

    return rows.select("book_id", "content", "_bodies").mapInPandas(copy, "book_id string, content binary")
