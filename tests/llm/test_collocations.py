"""Mined phrases against plain counting."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import collocations

ROWS = "lang string, text string, phrase string, n int, chunk int, counts string"


def plain(rows, least=10, longest=3, share=50, top=2000):
    found, size = {}, collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = found.setdefault(lang, collections.Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in found.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[s : s + m] for p, a in some.items() for m in range(2, len(p)) for s in range(len(p) - m + 1) if 100 * a >= share * some[p[s : s + m]]}
        best = []
        for p, a in some.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, size[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def texts():
    draw = random.Random(4)
    rows = []
    for i in range(60):
        w = [draw.choice("ab CD e É éa 😀 the \x1cx     x-y 'tis".split(" ")) for _ in range(200)]
        rows.append((draw.choice(["en", "en", "de", None, "", "und"]), "".join(x + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for x in w)))
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " . ,\n"), ("en", "of the same of the same " * 3000), ("solo", "a a a a a a a a a a a"), rows[0], rows[0]]
    rows += [("en", "very frequent words " * 40)] * 30
    return rows


def run(spark, rows, **given):
    table = spark.createDataFrame([(a, b, "p", 1, 2, "c") for a, b in rows], ROWS).repartition(4)
    return sorted(tuple(r) for r in collocations.collocations(table, **given).collect())


def test_phrases(spark):
    assert run(spark, texts()) == plain(texts())


def test_bitmaps_that_let_all_through(spark, monkeypatch):
    """Results do not depend on the buckets: with few of them every bit is set."""
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 1 << 3)
    monkeypatch.setattr(collocations, "MOST_BUCKETS", 1 << 3)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    assert run(spark, texts(), least=4, longest=4, share=70, top=25) == plain(texts(), 4, 4, 70, 25)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [("en", "a b"), (None, None)]) == []
    with pytest.raises(ValueError):
        run(spark, [], least=0)


def test_buckets_keep_counts_up_to_the_least():
    b = collocations.Buckets(1 << 17, 10)
    draw = np.random.default_rng(2)
    all_of = [draw.integers(0, 1 << 62, 30_000).astype(np.uint64) % 90_000 for _ in range(3)] + [np.full(500, 70_000, dtype=np.uint64)]
    for x in all_of:
        b.add(x)
    n = np.bincount(np.concatenate(all_of).astype(np.int64) % (1 << 17), minlength=1 << 17)
    assert b.count.tolist() == np.minimum(n, 10).tolist()
    assert {len(r["counts"]) for c in b.chunks() for r in c.to_pylist()} != set()


def test_bitmap_adds_chunks_of_tasks(spark):
    """Counts of several tasks add up; long rows of zeros are sent as places."""
    rows = []
    for at in ([5] * 6 + [70_000] * 3, [5] * 4 + [70_000] * 6, [9] * 10):
        b = collocations.Buckets(1 << 17, 10)
        b.add(np.array(at, dtype=np.uint64))
        rows += [(r["chunk"], bytearray(r["counts"])) for c in b.chunks() for r in c.to_pylist()]
    bits = collocations.bitmap(spark.createDataFrame(rows, "chunk int, counts binary"), 1 << 17, 10)
    assert collocations.is_set(bits, np.array([5, 9, 70_000, 6], dtype=np.uint64), 1 << 17).tolist() == [True, True, False, False]


def test_pruning_spares_counting():
    """Of the phrases of a pass only those are counted that both bitmaps let through."""
    block = collocations.Block(pa.array(["a b c. a b"]), pa.array(["en"]))
    assert block.n == 5 and block.in_piece(2).tolist() == [True, True, False, True, False] and block.in_piece(3).tolist() == [True, False, False, False, False]
    assert block.hash(2)[0] == block.hash(2)[3] != block.hash(2)[1]


def test_scores_pass_64_bits(spark):
    """The score's products, as the query has them, at counts whose squares do not fit a long."""
    a, l, r = 9_000_000_000_001, 9_000_000_000_007, 9_100_000_000_003
    wide = lambda v: F.lit(v).cast("decimal(38,0)")
    row = spark.range(1).select((wide(1_000_000) * wide(a) * wide(a)).alias("_over"), (wide(l) * wide(r)).alias("_under")).select(F.expr("_over div _under").cast("long").alias("s"))
    assert row.first()["s"] == 1_000_000 * a * a // (l * r)
