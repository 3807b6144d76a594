"""Streams that follow a run's answer log while calls are made: the glossary flushed in plan order, and progress lines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import glossary
from ..plans.answers import LOGGED, AnswerLog
from ..plans.completer import eta_seconds
from ..plans.progress import progress_line
from ..sources import glossary_md
from ..sources.folder import Folder, replace_all
from ..sources.state import EXTRACT_STATE, RunStore
from .ordered import ordered_outputs, stream_session

#: How often the log is looked at.
EVERY = "300 milliseconds"


@contextmanager
def following(spark: SparkSession, log: AnswerLog, name: str, take: Callable[[DataFrame, int], None], shape: Callable[[DataFrame], DataFrame] = lambda s: s) -> Iterator[None]:
    """Give new outcomes (``shape`` of LOGGED) to ``take`` in micro-batches while the body runs, and all that is left when it ends.

    Where a run's stream stands is kept in its folder, so a later run goes on there; a batch may come again after a crash, with its number.
    If ``take`` fails no further call is made, and its error is raised when the body is over.
    """

    def safely(batch: DataFrame, number: int) -> None:
        try:
            take(batch, number)
        except BaseException:
            log.stop(name)
            raise

    stream = shape(stream_session(spark).readStream.schema(LOGGED).json(f"{log.root}/answers"))
    query = stream.writeStream.foreachBatch(safely).trigger(processingTime=EVERY).option("checkpointLocation", f"{log.root}/flush/{name}").start()
    try:
        yield
    finally:
        try:
            query.processAllAvailable()
        finally:
            query.stop()


class GlossaryFlush:
    """A glossary that grows by a run's answers strictly in plan order, each batch of ready steps on disk before the next one.

    A batch replaces three files, or none: the glossary (in the run's folder, and at ``out`` if that is given), the run's state, and last the
    number of the batch with the table of entries that belongs to it. A batch that comes again is passed over by its number.
    """

    def __init__(self, run: RunStore, log: AnswerLog, docs: DataFrame, entries: DataFrame, steps: DataFrame, state: dict, out: str | None = None):
        self.run, self.log, self.steps, self.state, self.out = run, log, steps, state, out
        self.doc = docs.first().asDict()  # one document: its title and preamble
        if self.committed() is None:
            first = f"flush/entries-{uuid.uuid4().hex}"
            entries.write.parquet(f"{run.root}/{first}")
            run.folder.write("flush/committed.json", json.dumps({"batch": -1, "next": 1, "entries": first, "before": None}).encode())

    def committed(self) -> dict | None:
        data = self.run.folder.read("flush/committed.json")
        return None if data is None else json.loads(data)

    def entries(self, spark: SparkSession | None = None) -> DataFrame:
        """The entries as they stand."""
        return (spark or self.run.spark).read.schema(glossary_md.ENTRY).parquet(f"{self.run.root}/{self.committed()['entries']}")

    def text(self, entries: DataFrame) -> DataFrame:
        """doc_id, text: the glossary as Markdown."""
        doc = entries.sparkSession.createDataFrame([(self.doc["doc_id"], self.doc["title"], self.doc["preamble"])], "doc_id string, title string, preamble string")
        return glossary_md.write(doc, entries.withColumn("doc_id", F.lit(self.doc["doc_id"])))

    def completed(self, next_seq: int) -> list[str]:
        """The labels of the steps before one: a run's plan is a list that fits one place."""
        return [r["label"] for r in self.steps.where(F.col("seq") < next_seq).orderBy("seq").select("label").collect()]

    def files(self, text: str, state: dict, mark: dict) -> list[tuple[Folder, str, bytes]]:
        """What a batch replaces, in this order."""
        out = [(self.run.folder, "flush/glossary.md", text.encode("utf-8"))]
        if self.out:
            above, _, name = self.out.rpartition("/")
            out.append((Folder(above or "."), name, text.encode("utf-8")))
        return [*out, (self.run.folder, *self.run.saved(state, EXTRACT_STATE)), (self.run.folder, "flush/committed.json", json.dumps(mark).encode())]

    def take(self, ready: DataFrame, batch: int) -> None:
        """Merge a batch of ready steps (seq, content) and put it on disk."""
        now = self.committed()
        if batch <= now["batch"]:
            return
        spark = ready.sparkSession
        # What a batch holds is read more than once below.
        part = f"{self.run.root}/flush/ready-{uuid.uuid4().hex}"
        ready.select("seq", "content").write.parquet(part)
        rows = spark.read.schema("seq long, content string").parquet(part)
        last = rows.agg(F.max("seq").alias("n")).first()["n"]
        if last is not None:
            made = f"flush/entries-{uuid.uuid4().hex}"
            merge_outputs(self.entries(spark), rows).select(*(f.name for f in self.entries(spark).schema)).write.parquet(f"{self.run.root}/{made}")
            text = self.text(spark.read.schema(glossary_md.ENTRY).parquet(f"{self.run.root}/{made}")).first()["text"]
            self.state = self.state | {"completedSteps": self.completed(last + 1), "pendingOutputs": {}}
            replace_all(self.files(text, self.state, {"batch": batch, "next": last + 1, "entries": made, "before": now["entries"]}))
            if now["before"]:  # the table before stays for whoever reads it
                self.run.folder.delete(now["before"])
        self.run.folder.delete(part.removeprefix(f"{self.run.root}/"))

    @contextmanager
    def running(self) -> Iterator[None]:
        """Flush while the body asks."""
        run_id = F.lit("run").alias("run_id")
        done = lambda s: ordered_outputs(s.where("status = 'done' and seq is not null").select(run_id, "seq", F.col("html").alias("content")))
        with following(self.run.spark, self.log, "order", self.take, done):
            yield


def merge_outputs(existing: DataFrame, outputs: DataFrame) -> DataFrame:
    """Entries of ``existing`` with the entries of model outputs (seq, content) merged in plan order."""
    docs = outputs.where(~is_blank(F.col("content"))).select(F.format_string("%012d", "seq").alias("doc_id"), F.col("content").alias("text"))
    found = glossary_md.parse_model_output(docs)
    # Places need no window: a step's entries lie between its number and the next one's, times the most entries of a step.
    size = found.agg(F.min(F.col("doc_id").cast("long")).alias("_first"), (F.max("ord") + 1).alias("_most"))
    place = (F.col("doc_id").cast("long") - F.col("_first")) * F.col("_most") + F.col("ord")
    return glossary.merge_glossaries(existing, found.crossJoin(F.broadcast(size)).withColumn("ord", place.cast("int")).drop("doc_id", "_first", "_most"))  # one row


class LiveProgress:
    """Progress lines of a run, written to ``out`` as outcomes come in: the bar, counts, the step that ended last, and the time to go."""

    def __init__(self, log: AnswerLog, planned: int, concurrency: int, out: TextIO, done_before: int = 0, width: int = 80):
        self.log, self.planned, self.concurrency, self.out, self.width = log, planned, concurrency, out, width
        self.done, self.failures, self.seconds, self.counted, self.tokens = done_before, 0, 0.0, 0, [None, None, None]

    def take(self, batch: DataFrame, number: int) -> None:
        names = ("prompt_tokens", "cached_tokens", "completion_tokens")
        mine = batch.where(F.col("job") == self.log.job)
        got = mine.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "done").alias("failures"), F.sum(F.col("ended") - F.col("started")).alias("s"), F.max_by("chunk_id", "ended").alias("last"), *(F.sum(c).alias(c) for c in names)).first()
        if not got["n"]:
            return
        self.done, self.failures, self.counted, self.seconds = self.done + got["n"], self.failures + got["failures"], self.counted + got["n"], self.seconds + got["s"]
        self.tokens = [a if b is None else (a or 0) + b for a, b in zip(self.tokens, (got[c] for c in names))]
        left = eta_seconds(F.lit(self.seconds / self.counted), F.lit(self.planned - self.done), F.lit(self.concurrency))
        line = progress_line(F.lit(self.done), F.lit(self.planned), F.lit(got["last"]), left, self.width)
        self.out.write(batch.sparkSession.range(1).select(line).first()[0] + "\n")
        self.out.flush()

    @contextmanager
    def running(self, spark: SparkSession) -> Iterator[None]:
        """Report while the body asks."""
        with following(spark, self.log, f"progress-{self.log.job}", self.take):
            yield
