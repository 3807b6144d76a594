"""Run state: checkpoints as JSON, and a chunk's side files."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_file_id
from .folder import Folder

TRANSLATE_STATE = "sourcePath string, glossaryPath string, outputPath string, model string, prefixHash string, planHash string, fromChapter int, toChapter int, chunks array<struct<id: string, status: string>>"
EXTRACT_STATE = "originalPath string, translationPath string, mergeIntoPath string, model string, pairsHash string, maxPairs int, contextWindowTokens int, reservedOutputTokens int, completedSteps array<string>, pendingOutputs map<string, string>"
#: What must not have changed when a run is taken up again.
TRANSLATE_KEYS, EXTRACT_KEYS = ("prefixHash", "fromChapter", "toChapter"), ("originalPath", "translationPath", "mergeIntoPath", "model", "pairsHash", "maxPairs", "contextWindowTokens", "reservedOutputTokens")
#: What a chunk's status may be.
STATUSES = ("pending", "done", "failed")


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of state; field names are matched without case; no rows where there is no file."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_state(state: DataFrame, path: str) -> None:
    """State as one JSON file in a folder; replaced as a whole."""
    state.coalesce(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def check_resume(saved: dict, now: dict, keys: tuple[str, ...]) -> None:
    """Refuse to resume a run whose fingerprint differs."""
    for k in keys:
        if saved.get(k) != now.get(k):
            raise ValueError(f"cannot resume: {k} was {saved.get(k)!r} and is {now.get(k)!r}")


def side_files(chunks: DataFrame) -> DataFrame:
    """path, value: the source, translated and error files of chunks (chunk_id, source_html, html, reason)."""
    base = F.concat(F.lit("chunks/"), safe_file_id(F.col("chunk_id")))
    files = F.array(*(F.struct(F.concat(base, F.lit(ext)).alias("path"), F.col(c).alias("value")) for ext, c in ((".source.html", "source_html"), (".translated.html", "html"), (".error.txt", "reason"))))
    return chunks.select(F.explode(files).alias("f")).select("f.path", "f.value").where("value is not null")


class RunStore:
    """The folder of one run, which the driver and all executors share: its state and plan; the log of its answers lies there too."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        if root is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if not shared:
                if not spark.sparkContext.master.startswith("local["):
                    raise ValueError("a run needs a folder for its answers, or spark.checkpoint.dir")
                shared = tempfile.mkdtemp(prefix="quillmesh-runs-")  # one process: any folder is shared
            root = f"{shared}/quillmesh-run-{uuid.uuid4().hex}"
        self.spark, self.root, self.folder = spark, root, Folder(root)

    def state(self, schema: str) -> dict | None:
        """The saved state, if there is one."""
        found = load_state(self.spark, f"{self.root}/state", schema).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def begin(self, now: dict, schema: str, keys: tuple[str, ...], resume: bool) -> dict:
        """The state to go on from: the saved one, if the run is resumed and the fingerprint agrees, else ``now``, saved."""
        saved = self.state(schema) if resume else None
        if saved:
            check_resume(saved, now, keys)
            return saved
        for name in ("answers", "packed", "flush"):  # of an earlier run in this folder: paid for, so kept, but not read
            if self.folder.exists(name):
                self.folder.move(name, f"before-{time.time_ns()}/{name}")
        self.folder.make("answers")
        self.save(now, schema)
        return now

    def save(self, state: dict, schema: str) -> None:
        self.folder.write(*self.saved(state, schema))

    @staticmethod
    def saved(state: dict, schema: str) -> tuple[str, bytes]:
        """The state's file, by name and bytes."""
        names = [c.strip().split(" ")[0] for c in _columns(schema)]
        return "state/state.json", json.dumps({n: state.get(n) for n in names}, ensure_ascii=False, indent=2).encode("utf-8")

    def add_table(self, name: str, rows: DataFrame) -> DataFrame:
        """A plan, written anew and read again: it is read many times and holds all texts."""
        path = f"{self.root}/{name}/{time.time_ns()}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def _columns(schema: str) -> list[str]:
    """The column definitions of a schema, whose types may hold commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def write_side_files(chunks: DataFrame, root: str) -> None:
    """Each side file under ``root`` by its name, from the driver: one book's, a row at a time."""
    for r in side_files(chunks).toLocalIterator():
        write_text(f"{root}/{r['path']}", r["value"])


def write_text(path: str, text: str) -> None:
    """A whole file, made beside its place and moved there."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


def read_side_files(spark: SparkSession, root: str) -> DataFrame:
    """path (from ``chunks/`` on), value of all side files under ``root``."""
    return spark.read.option("recursiveFileLookup", True).text(f"{root}/chunks", wholetext=True).select(F.concat(F.lit("chunks/"), F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("path"), "value")


def load_rules(path: str | None, fallback: str = "") -> str:
    """A prompt file's text, or the fallback where there is none."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return fallback


@dataclass(frozen=True)
class Options:
    """Settings of a run; later sources win: defaults, JSON files in order, a mapping, environment variables ``QUILLMESH_<FIELD>``."""

    context_tokens: int = 100_000
    reserved_output_tokens: int = 8_000
    max_input_tokens: int | None = None
    output_multiplier: float = 0.0
    output_reserve_tokens: int = 0
    max_retries: int = 3
    translate_concurrency: int = 2
    extract_concurrency: int = 1

    def __post_init__(self):
        for n in (self.translate_concurrency, self.extract_concurrency):
            if not 1 <= n <= 8:
                raise ValueError(f"concurrency {n} is not in 1..8")

    @classmethod
    def load(cls, given: dict | None = None, environ: dict | None = None, files: tuple[str, ...] = ()) -> Options:
        values: dict = {}
        known = {f.name.replace("_", ""): f.name for f in fields(cls)}
        for path in files:  # files that are not there are passed over; names are matched without case and underscores
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    said = json.load(f)
                values |= {known[k.replace("_", "").lower()]: v for k, v in said.items() if k.replace("_", "").lower() in known}
        values |= dict(given or {})
        for f in fields(cls):
            raw = (os.environ if environ is None else environ).get(f"QUILLMESH_{f.name.upper()}")
            if raw is not None:
                values[f.name] = float(raw) if f.name == "output_multiplier" else int(raw)
        return cls(**values)

    @property
    def joint(self) -> bool:
        """Whether blocks are costed together: any of the separate limits is set."""
        return self.max_input_tokens is not None or self.output_multiplier > 0 or self.output_reserve_tokens > 0

    def source_budget(self, prefix_tokens: int) -> int:
        """Tokens left for source beside a prefix; not positive is an error."""
        limits = [self.context_tokens - prefix_tokens - self.reserved_output_tokens]
        if self.max_input_tokens is not None:
            limits.append(self.max_input_tokens - prefix_tokens)
        if self.output_multiplier > 0:
            limits.append(int((self.reserved_output_tokens - self.output_reserve_tokens) // self.output_multiplier))
        if min(limits) <= 0:
            raise ValueError(f"no tokens are left for source: {min(limits)}")
        return min(limits)


def check_path(path: str) -> str:
    """``path`` if it names an EPUB; an error for anything else."""
    if path.lower().endswith(".pdf"):
        raise ValueError(f"PDF is not supported: {path}")
    if not path.lower().endswith(".epub"):
        raise ValueError(f"not an EPUB: {path}")
    return path


def work_dir(book: str, kind: str = "work") -> str:
    """The folder beside a book where a run keeps its state."""
    return f"{os.path.splitext(book)[0]}.{kind}"
