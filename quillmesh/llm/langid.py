"""Language identification of mixed texts.

A word's script (by code point ranges) narrows the candidate languages to those
seen in that script. Each candidate gets a log-likelihood from hashed character
n-grams of the word. Viterbi over a text's words, with a penalty for each switch of
language, labels its spans; the language of most letters is the text's.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, lean, mix64, offsets, text_slices, tidy

#: Labelled documents of each language from whose whole texts a model is fitted.
TRAIN_DOCS = 1_500
#: Hash buckets of n-grams, lengths of n-grams.
BUCKETS, GRAMS = 1 << 17, (1, 2, 3, 4)
#: Log-likelihood that a switch of language must outweigh, the most that one word can say against a candidate,
#: and what it says against a language that its script rules out: more than any number of switches.
SWITCH, WORD_LIMIT, EXCLUDED = 12.0, 8.0, 1e6
#: Words a Python worker remembers.
REMEMBERED = 200_000
UNKNOWN = "und"

#: First and last code point of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS)
_EDGES = sorted((a, z, i) for i, ranges in enumerate(SCRIPTS.values()) for a, z in ranges)
_FIRST, _LAST, _NAME = (np.array([e[k] for e in _EDGES], dtype=np.int64) for k in range(3))
_WORD = re.compile(r"[^\W\d_]+")


def scripts(points: np.ndarray) -> np.ndarray:
    """The script number of each code point."""
    i = np.searchsorted(_FIRST, points, side="right") - 1
    return np.where((i >= 0) & (points <= _LAST[np.maximum(i, 0)]), _NAME[np.maximum(i, 0)], OTHER)


def words_of(text: str) -> list[re.Match]:
    return [m for m in _WORD.finditer(text) if any(map(str.isalpha, m[0]))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased words, marked at both ends; the word each belongs to; each word's script."""
    marked = ["\x02" + w.lower() + "\x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    size = np.array([len(w) for w in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    script = scripts(points[offsets(size)[:-1] + 1]) if len(words) else np.zeros(0, dtype=np.int64)
    bucket, of = [], []
    for n in GRAMS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        code = np.full(count, n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[k : k + count].astype(np.uint64)
        inside = owner[:count] == owner[n - 1 :]
        if n == 1:
            inside = points > 3
        bucket.append((mix64(code[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owner[:count][inside])
    return np.concatenate(bucket) if bucket else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64), script


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # log-likelihood of each bucket by language, float32
    allowed: np.ndarray  # which languages are seen in a script

    def rows(self, words: list[str]) -> np.ndarray:
        """A row per word: each language's log-likelihood less the best one's (-EXCLUDED for languages that are not written in the word's script), and last, how much likelier the best one makes the word's n-grams than no language does, to which all n-grams are alike."""
        if not words:
            return np.zeros((0, len(self.languages) + 1), dtype=np.float32)
        bucket, of, script = grams(words)
        total = np.stack([np.bincount(of, weights=self.weight[bucket, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)
        can = self.allowed[script]
        can = can | ~can.any(axis=1)[:, None]
        best = np.where(can, total, -np.inf).max(axis=1, keepdims=True)
        fit = best + np.bincount(of, minlength=len(words))[:, None] * np.log(BUCKETS)
        return np.concatenate([np.where(can, np.maximum(total - best, -WORD_LIMIT), -EXCLUDED), fit], axis=1).astype(np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """The languages' columns of ``rows``."""
        return self.rows(words)[:, :-1]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the whole texts of at most ``train_docs`` labelled documents of each language, chosen by a hash of the id.

    N-grams are counted on the executors; the driver gets one array of BUCKETS numbers per
    language, which is the model itself. Rows with a null text or label teach nothing; repeated
    rows count each time; null ids are drawn like any other. No labelled row: a model without languages.
    """
    lean(docs)
    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"), column(docs, lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    # Ids alone are ranked; a hash bound keeps about twice the sample of each language before that.
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") > 2 * train_docs, F.lit(2.0 * train_docs) / F.col("n")).otherwise(1.0)
    drawn = docs.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)).alias("draw"))
    # One row per language, as many as the model has columns.
    drawn = drawn.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(F.col("draw") <= F.col("share") * (1 << 30))
    sample = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).where(F.col("nth") <= train_docs).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        script_of: dict[str, np.ndarray] = {}
        for part in text_slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).extend(m[0] for m in words_of(text))
            for lang, words in by.items():
                for a in range(0, len(words), WORDS_READ):
                    bucket, _, script = grams(words[a : a + WORDS_READ])
                    seen[lang] = seen.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
                    script_of[lang] = script_of.get(lang, 0) + np.bincount(script, minlength=OTHER + 1)
        for lang, n in seen.items():
            every = np.concatenate([n, script_of[lang]])
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([every[at].astype("<i8").tobytes()], pa.binary())], ["lang", "at", "n"])
        tidy()

    def total(group: pa.Table) -> pa.Table:
        every = np.zeros(BUCKETS + OTHER + 1, dtype="<i8")
        for at, n in zip(group.column("at").to_pylist(), group.column("n").to_pylist()):
            every[np.frombuffer(at, dtype="<i4")] += np.frombuffer(n, dtype="<i8")
        return pa.table({"lang": group.column("lang")[:1], "n": pa.array([every.tobytes()], pa.binary())})

    counts = sample.mapInArrow(count, "lang string, at binary, n binary").groupBy("lang").applyInArrow(total, "lang string, n binary").collect()
    languages = sorted(r["lang"] for r in counts)
    weight = np.zeros((BUCKETS, max(1, len(languages))), dtype=np.float64)
    allowed = np.zeros((OTHER + 1, max(1, len(languages))), dtype=bool)
    for r in counts:
        n, k = np.frombuffer(r["n"], dtype="<i8"), languages.index(r["lang"])
        weight[:, k] = n[:BUCKETS]
        letters = n[BUCKETS:]
        allowed[:, k] = (letters > 0) & (letters >= 0.001 * letters.sum())
    weight += 0.5
    weight = np.log(weight / weight.sum(axis=0, keepdims=True)).astype(np.float32)
    return Model(languages, weight, allowed)


def label(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word when every switch costs ``switch`` (Viterbi).

    The answer is the text's best language throughout, without a search, if neither
    kind of other path can win. One that visits the best language pays at least one
    switch for each stretch elsewhere, so no stretch may gain more than that; one
    that never does pays at least one switch, so even the best word by word of the other
    languages, less a switch, may not exceed the best language's total.
    """
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(np.argmax(total))
    others = np.delete(scores, best, axis=1)
    if k == 1 or others.max(axis=1).sum(dtype=np.float64) - switch <= total[best]:
        sums = np.zeros((n + 1, k - 1))
        np.cumsum(others - scores[:, best : best + 1], axis=0, out=sums[1:])
        if k == 1 or (sums - np.minimum.accumulate(sums, axis=0)).max() <= switch:
            return np.full(n, best)
    blocks = (scores[a : a + WORDS_READ].tolist() for a in range(0, n, WORDS_READ))
    rows = chain.from_iterable(blocks)
    now, before, floors = next(rows), array("d"), array("d")
    for row in rows:
        floor = max(now) - switch
        before.extend(now)
        floors.append(floor)
        now = [(v if v >= floor else floor) + s for v, s in zip(now, row)]
    at = now.index(max(now))
    out = np.empty(n, dtype=np.int64)
    out[n - 1] = at
    for t in range(n - 2, -1, -1):
        floor = floors[t]
        if before[t * k + at] < floor:
            held = before[t * k : (t + 1) * k]
            at = held.index(max(held))
        out[t] = at
    return out


#: Characters labelled together, words read and scored together: what bounds a worker's memory, however long texts are.
TOGETHER, WORDS_READ, WORDS_SCORED = 200_000, 50_000, 10_000


class Labeller:
    """Labels texts with one model, remembering the scores of words."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 1), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        fresh = list(words.difference(self.known))
        for a in range(0, len(fresh), WORDS_SCORED):
            some = fresh[a : a + WORDS_SCORED]
            self.known.update(zip(some, range(len(self.table), len(self.table) + len(some))))
            self.table = np.concatenate([self.table, self.model.rows(some)])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        return [found[:3] for found in self.judged(texts)]

    def judged(self, texts: list[str | None]) -> list[tuple[str, float, list[dict], float]]:
        """(language, score, spans, fit) of each text; ``fit`` says how much likelier its spans' languages make it than no language does."""
        out, held, size = [], [], 0
        for text in texts:
            if text is not None and len(text) > TOGETHER:
                out += self.some(held)
                out.append(self.long(text))
                held, size = [], 0
                continue
            if size + len(text or "") > TOGETHER:
                out += self.some(held)
                held, size = [], 0
            held.append(text)
            size += len(text or "")
        return out + self.some(held)

    def some(self, texts: list[str | None]) -> list[tuple[str, float, list[dict], float]]:
        found = [list(_WORD.finditer(t)) if t and t.isascii() else words_of(t or "") for t in texts]
        words = [[m[0] for m in f] for f in found]
        if not self.model.languages or not any(words):
            return [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        self.learn(set().union(*words))
        return [self.answer(self.table[list(map(self.known.__getitem__, w))], list(map(len, w)), lambda k: matches[k].start(), lambda k: matches[k].end()) for matches, w in zip(found, words)]

    def long(self, text: str) -> tuple[str, float, list[dict], float]:
        """One text by itself, its words read in pieces."""
        words, scores, starts, ends = iter(_WORD.finditer(text)), [], [], []
        while piece := list(islice(words, WORDS_READ)):
            piece = [m for m in piece if any(map(str.isalpha, m[0]))]
            if self.model.languages and piece:
                self.learn({m[0] for m in piece})
                scores.append(self.table[[self.known[m[0]] for m in piece]])
                starts.append(np.array([m.start() for m in piece]))
                ends.append(np.array([m.end() for m in piece]))
        if not scores:
            return UNKNOWN, 0.0, [], 0.0
        first, last = np.concatenate(starts), np.concatenate(ends)
        return self.answer(np.concatenate(scores), last - first, lambda k: int(first[k]), lambda k: int(last[k]))

    def answer(self, rows: np.ndarray, lengths, start, end) -> tuple[str, float, list[dict], float]:
        """The answer for words of these rows and lengths; ``start`` and ``end`` give the place of the k-th."""
        names = self.model.languages
        if not len(rows):
            return UNKNOWN, 0.0, [], 0.0
        scores = rows[:, :-1]
        path = label(scores, self.switch)
        fit = rows[:, -1].sum(dtype=np.float64) + scores[np.arange(len(path)), path].sum(dtype=np.float64)
        letters = np.bincount(path, weights=lengths, minlength=len(names))
        top = int(np.argmax(letters))
        cut = (np.flatnonzero(np.diff(path)) + 1).tolist()
        spans = [{"start": start(a), "end": end(z - 1), "lang": names[path[a]]} for a, z in zip([0, *cut], [*cut, len(path)])]
        return names[top], float(letters[top] / letters.sum()), spans, float(fit)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans of every whole text.

    ``score`` is the share of letters in words labelled ``lang_pred``. ``spans`` is
    an array of (start, end, lang) in code points, from the first word of a stretch
    to its last. A null text, or one without a letter, is ``und`` with score 0 and
    no span; so is every text if the model has no language. Of languages with
    equally many letters the first by name is taken. One row per input row,
    repeated rows and null ids included; other columns are left out, so their
    names cannot clash.
    """
    lean(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, switch)
        for part in text_slices(batches):
            rows = labeller(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)], ["doc_id", "lang_pred", "score", "spans"])

    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


#: How much likelier no language must make a text than the languages of its spans, as a logarithm, before it is rejected.
NO_LANGUAGE = 20.0


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", against: float = NO_LANGUAGE) -> DataFrame:
    """``docs`` without the rows whose text is in no language of the model; all columns stay, and a null ``lang_col`` gets the language found.

    The words' labels (Viterbi over their scores) say which language each span is in. Where even so the text is less likely, by ``against``
    at least, than if all n-grams were alike, no language fits, and the row goes; so does a null text, or one without a letter. A text of several
    languages stays, span by span; so does one of a few unknown words, which say little. Repeated rows, null ids and
    columns of any name are no matter; an empty table stays empty. If the model has no language, nothing can be judged and every row stays.
    """
    if not model.languages:
        return docs
    lean(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(shared.value, SWITCH)
        for text in batches:
            yield pd.Series([None if lang == UNKNOWN or fit < -against else lang for lang, _, _, fit in labeller.judged(text.tolist())], dtype=object)
        del labeller
        tidy()

    found = "_lang_found"
    while found in docs.columns:
        found += "_"
    # Not to be asked twice, by the filter and by the column.
    language = F.pandas_udf(judged, "string").asNondeterministic()
    out = docs.withColumn(found, language(column(docs, text_col).cast("string"))).where(F.col(found).isNotNull())
    if lang_col is not None and lang_col in docs.columns:
        out = out.withColumn(lang_col, F.coalesce(column(docs, lang_col).cast("string"), F.col(found)))
    return out.drop(found)
