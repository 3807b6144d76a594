"""Secret scans: known shapes by pattern, and random-looking strings by Markov models.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: strings which the patterns report
in a bounded sample of documents, with seeded random strings beside them; and the
runs of the same alphabet there that no pattern touches, with seeded identifiers, paths, dates and
numbers beside them, in equal parts. A run is reported when
the log-likelihood ratio of the two models exceeds a threshold, unless it is a UUID.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, text_slices, tidy

#: Documents from which the models are trained, and seeded random strings and ordinary ones beside them.
TRAIN_DOCS, TRAIN_RANDOM, TRAIN_ORDINARY = 2_000, 4_000, 20_000
#: Characters that a run needs, and the log-likelihood ratio that it must exceed.
MIN_RUN, MIN_RATIO = 12, 15.0

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_ANY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{2,}")

#: Alphabets of common secrets.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
#: Words that identifiers, file names and paths are made of.
WORDS = """get set is has add remove update create delete find load save read write open close start stop run init parse format print list
map filter sort count index key value name type size length width height color text string number int float bool date time day year user
admin account login session client server request response header body path file folder dir src lib bin test data base table row column
query join model view controller service manager handler factory builder provider context config option param error exception warning
message event listener callback thread process task queue stack heap node tree graph edge link url http api json xml html css java script
python component element button input form page menu bar panel window image media audio video upload download encode decode hash token
check valid max min total average first last next previous current default max buffer cache memory disk network socket port host local""".split()
#: Runs that come from keyboards and alphabets.
ROWS = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "qwertyuiop", "asdfghjkl", "zxcvbnm", string.ascii_lowercase + string.digits)
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)

_SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
N = len(_SYMBOLS)
_CODE = np.full(256, 0, dtype=np.int64)
_CODE[np.frombuffer(_SYMBOLS.encode(), dtype=np.uint8)] = np.arange(N)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known shapes, leftmost and not overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def transitions(runs: list[str]) -> np.ndarray:
    """How often each character follows each, over runs of the alphabet."""
    counts = np.zeros(N * N, dtype=np.int64)
    for a in range(0, len(runs), 50_000):
        some = runs[a : a + 50_000]
        flat = np.frombuffer("\n".join(some).encode("ascii"), dtype=np.uint8)
        pair = _CODE[flat[:-1]] * N + _CODE[flat[1:]]
        counts += np.bincount(pair[(flat[:-1] != 10) & (flat[1:] != 10)], minlength=N * N)
    return counts


def random_strings(n: int, seed: int = 1) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(ALPHABETS[i % len(ALPHABETS)], k=draw.randint(20, 48))) for i in range(n)]


def identifiers(n: int, seed: int = 2) -> list[str]:
    """Seeded identifiers of many styles, paths, dates, numbers and keyboard rows."""
    draw, out = random.Random(seed), []
    number = lambda: str(draw.randint(0, 10 ** draw.randint(1, 12)))
    two = lambda most: f"{draw.randint(0, most):02d}"
    short = lambda x: x[0] + re.sub("[aeiou]", "", x[1:])  # noqa: E731  as in abbreviations
    styles = (
        lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w), lambda w: "_".join(w).upper(), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(w),
        lambda w: w[0].upper() + "".join(x.capitalize() for x in w[1:]), lambda w: "/".join(["", *w[:-1], w[-1].capitalize() + w[0].capitalize()]), lambda w: "_" * draw.randint(1, 2) + "_".join(w) + "_" * draw.randint(0, 2),
        lambda w: "_".join(w) + draw.choice(("", "_", "-")) + number(), lambda w: w[0] + number() + "".join(x.capitalize() for x in w[1:]), lambda w: "-".join([w[0], number(), *w[1:]]), lambda w: "/".join([w[0], number(), w[-1], number()]),
        lambda w: f"{draw.randint(1900, 2100)}-{two(12)}-{two(31)}" + draw.choice(("", f"T{two(23)}-{two(59)}-{two(59)}", "-" + w[0])), lambda w: f"{draw.randint(1900, 2100)}{two(12)}{two(31)}{draw.choice(('', '_', '-', 'T'))}{two(23)}{two(59)}{two(59)}",
        lambda w: "_".join(map(short, w)).upper(), lambda w: "_".join([short(w[0]), short(w[1]) + draw.choice("0123468"), *w[2:]]).upper(), lambda w: "_".join([w[0], short(w[1]) + short(w[-1])]).upper(), lambda w: "".join(map(short, w)),
        lambda w: "_".join([short(w[0]), w[1], str(2 ** draw.randint(0, 12)) + draw.choice(("", "B", "KB", "MB", "GB", "MS", "PX", "BIT"))]).upper(), lambda w: "_".join([*map(short, w[:2]), w[-1]]).upper(),
        lambda w: w[0] + "".join(short(x).upper() if k % 2 else x.capitalize() for k, x in enumerate(w[1:])), lambda w: number() + number(), lambda w: "=".join(w[:2]), lambda w: draw.choice(ROWS), lambda w: draw.choice("=-_+/xX") * draw.randint(8, 60),
    )
    return [styles[i % len(styles)](draw.choices(WORDS, k=draw.randint(2, 5))) for i in range(n)]


def balanced(corpus: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Counts of two kinds in equal parts, about as many as there are samples; the one that is there, if the other is empty."""
    size = samples.sum()
    return samples + (corpus * (size / corpus.sum()) if corpus.sum() else 0)


def likelihood(counts: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log-likelihood of each transition; where few were counted, that of the second character by itself."""
    n = np.asarray(counts, dtype=float).reshape(N, N)
    alone = n.sum(axis=0) + 0.5
    return np.log((n + weight * alone / alone.sum()) / (n.sum(axis=1, keepdims=True) + weight))


def ratios(secret: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition."""
    return likelihood(secret) - likelihood(ordinary)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The ratio table, from about ``train_docs`` documents drawn by a hash of their id (all, if fewer).

    Null texts teach nothing; rows with a null id are drawn together or not at all, as rows of one id are. From an
    empty table the models know the seeded random strings alone. Other columns are not read.
    """
    lean(docs)
    rows = docs.select(column(docs, id_col).cast("string").alias("doc_id"), column(docs, text_col).cast("string").alias("text")).where("text is not null")
    n = rows.count()
    share = min(1.0, train_docs / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, N * N), dtype=np.int64)
        for part in text_slices(batches):
            secret: list[str] = []
            ordinary: list[str] = []
            for text in part.column("text").to_pylist():
                at = 0
                for start, end, kind in sorted(base_spans(text)):
                    found = text[start:end]
                    secret += _ANY_RUN.findall(re.split("[:=]", found, maxsplit=1)[-1] if kind == "assign" else found)
                    ordinary += _ANY_RUN.findall(text[at:start])
                    at = max(at, end)
                ordinary += _ANY_RUN.findall(text[at:])
            sums[0] += transitions(secret)
            sums[1] += transitions(ordinary)
        for k in range(2):
            at = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(sums[k][at])], ["k", "at", "n"])

    found = sample.mapInArrow(count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()  # 2 * N * N rows at most
    sums = np.zeros((2, N * N), dtype=np.int64)
    for r in found:
        sums[r["k"], r["at"]] = r["n"]
    return ratios(sums[0] + transitions(random_strings(TRAIN_RANDOM)), balanced(sums[1], transitions(identifiers(TRAIN_ORDINARY))))


def spans(text: str, table: np.ndarray) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed: the base ones, and by the models runs, or the parts of runs outside base spans."""
    out = base_spans(text)
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    if out and runs:
        runs = [part for run in runs for part in outside(run, out) if part[1] - part[0] >= MIN_RUN]
    if runs:
        code = _CODE[np.frombuffer("\n".join(text[a:z] for a, z in runs).encode("ascii"), dtype=np.uint8)]
        step = table[code[:-1], code[1:]]
        first = np.cumsum([0, *(z - a + 1 for a, z in runs[:-1])])
        ends = np.cumsum([z - a + 1 for a, z in runs]) - 2  # the step from a run's last character to the break, and that from the break
        ends = ends[:-1]
        step[ends] = step[ends + 1] = 0
        out += [(a, z, "random") for (a, z), ratio in zip(runs, np.add.reduceat(step, first).tolist()) if ratio > MIN_RATIO and not _UUID.fullmatch(text, a, z)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def outside(run: tuple[int, int], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a range that no span touches."""
    at, parts = run[0], []
    for start, end, _ in sorted(taken):
        if end > at and start < run[1]:
            parts.append((at, start))
            at = max(at, end)
    return [(a, z) for a, z in [*parts, (at, run[1])] if a < z]


def scan(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: an array of (kind, start, end) in code points, end exclusive, of every whole text.

    Kinds: assign, access and hex are patterns; random is the models'. A null text
    counts as empty: no spans. One row per input row, repeated rows and null ids
    included; other columns are left out, so their names cannot clash.
    """
    lean(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # N x N numbers
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [[{"kind": k, "start": a, "end": z} for a, z, k in spans(t, shared.value)] if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind_of)], ["doc_id", "found"])

    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, table: np.ndarray, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span in ``text_col`` replaced by ``mask`` (overlapping spans by one).

    All rows and columns stay, of whatever names; a null text stays null, an empty one empty; repeated rows
    are masked alike; an empty table stays empty.
    """
    lean(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def one(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, end, _ in spans(text, shared.value):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield text.map(one, na_action="ignore")
        tidy()

    return docs.withColumn(text_col, hide(column(docs, text_col).cast("string")))
