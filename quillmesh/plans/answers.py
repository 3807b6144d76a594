"""The log of a run's answers: written by the tasks, an answer at a time, as soon as it is there.

An answer costs money and does not come twice, so nothing that happens after it may lose it: not a failing
task, not a lost executor, not the end of the driver. Each outcome is a file of its own under a name
made of its chunk, moved into place whole. A task that is run again finds what it asked already and
does not ask again. One file, ``stop``, ends the asking for all tasks: what is in flight ends and is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folder import Folder

#: An outcome as it is logged: of a call (or several tries of it), by whom it was asked, and when.
LOGGED = "chunk_id string, seq long, status string, html string, reason string, attempts int, prompt_tokens long, cached_tokens long, completion_tokens long, job string, started double, ended double"


class AnswerLog:
    """Outcomes in ``root``/answers. ``job`` names one asking: its failures count for it, done answers for every later one."""

    def __init__(self, root: str, job: str):
        self.root, self.job = root, job
        self.folder = Folder(root)

    def _name(self, chunk_id: str, status: str) -> str:
        key = hashlib.sha256(chunk_id.encode()).hexdigest()[:40]
        return f"answers/{key}-done.json" if status == "done" else f"answers/{key}-{self.job}.json"

    def put(self, outcome: dict) -> None:
        self.folder.write(self._name(outcome["chunk_id"], outcome["status"]), json.dumps(outcome | {"job": self.job}).encode())

    def known(self, chunk_id: str) -> dict | None:
        """What is logged of a chunk that is done, or that this job has asked before."""
        for status in ("done", "failed"):
            data = self.folder.read(self._name(chunk_id, status))
            if data is not None:
                return json.loads(data)
        return None

    def stop(self, chunk_id: str) -> None:
        self.folder.write("stop", chunk_id.encode())

    def stopped(self) -> bool:
        return self.folder.exists("stop")

    def open(self) -> None:
        """Let calls be made; for the driver, before it asks."""
        self.folder.delete("stop")


#: Names, and outcomes, that are handed on together.
NAMES, ROWS = 10_000, 500


def _names(spark: SparkSession, root: str) -> DataFrame:
    """name: the files of a run's answers, in as many parts as there are slots. One task lists them; the driver sees none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            names = Folder(root).names("answers")
            for k in range(0, len(names), NAMES):
                yield pa.RecordBatch.from_pydict({"name": names[k : k + NAMES]})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name string").repartition(spark.sparkContext.defaultParallelism)


def _alone(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes (LOGGED) that are in files of their own. Very many small files are read by Arrow, which opens one at a small part of the cost of a Spark file scan."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in LOGGED.split(", "))])
    text = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) else x  # noqa: E731  half a pair of units is no UTF-8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(root)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for k in range(0, len(names), ROWS):
                found = (folder.read(f"answers/{n}") for n in names[k : k + ROWS])
                rows = [{c: text(v) for c, v in json.loads(data).items()} for data in found if data is not None]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _names(spark, root).mapInArrow(run, LOGGED)


def logged(spark: SparkSession, root: str) -> DataFrame:
    """All outcomes (LOGGED) in a run's folder: those packed, and those in files of their own."""
    parts = []
    for folder, read in ((f"{root}/packed/*", lambda p: spark.read.schema(LOGGED).parquet(p)), (f"{root}/answers", lambda p: spark.read.schema(LOGGED).json(p))):
        try:
            parts.append(read(folder))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    out = spark.createDataFrame([], LOGGED)
    for p in parts:
        out = out.unionByName(p)
    return out


def last_of_each(outcomes: DataFrame) -> DataFrame:
    """The last outcome of each chunk, a done one before any other."""
    last = Window.partitionBy("chunk_id").orderBy(F.desc(F.col("status") == "done"), F.desc("ended"), "job")
    return outcomes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def pack(spark: SparkSession, root: str) -> None:
    """Bring the files of a run that is over together into Parquet; they go when their answers are there."""
    folder = Folder(root)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                folder.delete(f"answers/{name}")
            yield batch

    if folder.exists("answers"):
        _alone(spark, root).write.parquet(f"{root}/packed/{uuid.uuid4().hex}")
        _names(spark, root).mapInArrow(delete, "name string").write.format("noop").mode("overwrite").save()
        folder.delete("answers")
