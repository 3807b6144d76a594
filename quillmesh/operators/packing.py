"""Greedy packing of chapters whose blocks do not fit a row: the same groups as ``chunks.pack_starts`` gives, in linear time.

Blocks lie in ranges of a chapter. What a range does to the group that is open when it begins depends on one number: how
much of the budget is used. Where the first new group begins is a step function of that number, and everything
behind it follows. So each range tells, for each place that its first group may begin at, how much is used at its end and how
many groups it began: a table no longer than its blocks, and as a rule than one group. One pass over these
tables, a row for each range, chains them; then every range knows its groups by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_length

#: Blocks of a range.
RANGE = 50_000


def next_starts(cost: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block, where the group after one that begins there begins (the number of blocks if there is none); and the sums of costs before each block."""
    sums = np.concatenate(([0], np.cumsum(cost)))
    return np.maximum(np.searchsorted(sums, sums[:-1] + limit, side="right") - 1, np.arange(1, len(cost) + 1)), sums


def first_start(sums: np.ndarray, used: int, limit: int) -> int:
    """Where a group must begin if ``used`` is used already; the number of blocks if nowhere."""
    return int(np.searchsorted(sums[1:], limit - used, side="right"))


def groups_from(start: int, following: np.ndarray) -> list[int]:
    """All starts of a range from one on."""
    out, n = [], len(following)
    while start < n:
        out.append(start)
        start = int(following[start])
    return out


def _summary(cost: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """starts, used, begun: for each place that a first group can begin at, what is used at the end and how many groups began. The last place is the end: none begins."""
    following, sums = next_starts(cost, limit)
    n = len(cost)
    # From the end backwards: what follows from a start is known when the start is reached.
    used, begun = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    most = min(n, int(np.searchsorted(sums, limit, side="right")))  # beyond, a group has begun before
    for start in range(n - 1, -1, -1):
        j = following[start]
        used[start], begun[start] = (used[j], begun[j] + 1) if j < n else (sums[n] - sums[start], 1)
    places = [*range(most), n] if most < n else [*range(n), n]
    return places, [int(sums[n]) if p == n else int(used[p]) for p in places], [int(begun[p]) for p in places]


def pack_rows(blocks: DataFrame, budget: int, joint: bool = False, span: int = RANGE) -> DataFrame:
    """chapter_no, pos, piece_no (from 1) of blocks (chapter_no, pos from 0 without gaps, n: a block's length): the groups of ``chunks.pack_starts``.

    A chapter may have any number of blocks; blocks of no chapter (null) have no group. A null length is 0; an
    empty table gives no rows. No task holds more than ``span`` blocks, or a row for each range of one chapter at a time.
    """
    limit = budget * 4 + 3 if joint else budget
    cost = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    cost = cost if joint else F.floor(cost / 4)
    part = F.floor(F.col("pos") / span).cast("long").alias("part")
    listed = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), cost.alias("cost"))))
    ranges = blocks.groupBy("chapter_no", part).agg(listed.alias("b")).select("chapter_no", "part", F.col("b.pos").alias("pos"), F.col("b.cost").alias("cost"))

    @F.pandas_udf("struct<starts: array<int>, used: array<long>, begun: array<long>, sums: array<long>>")
    def summed(costs: pd.Series) -> pd.DataFrame:
        rows = []
        for c in costs:
            c = np.asarray(c, dtype=np.int64)
            places, used, begun = _summary(c, limit)
            rows.append((places, used, begun, np.cumsum(c)[: len(places)].tolist()))
        return pd.DataFrame(rows, columns=["starts", "used", "begun", "sums"])

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chapter = None
        used = begun = 0
        for b in batches:
            out = []
            for i in range(b.num_rows):
                at = {c: b.column(c)[i] for c in ("chapter_no", "part", "s")}
                s = at["s"].as_py()
                fresh = at["chapter_no"].as_py() != chapter
                if fresh:
                    chapter, used, begun = at["chapter_no"].as_py(), 0, 0
                out.append((chapter, at["part"].as_py(), -1 if fresh else used, begun))
                if fresh:
                    k = 0
                else:  # the first place whose sum is too much; the table's last place is the end
                    k = int(np.searchsorted(np.array(s["sums"][: len(s["starts"]) - 1]), limit - used, side="right"))
                used = used + s["used"][k] if not s["begun"][k] else s["used"][k]
                begun += s["begun"][k]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["chapter_no", "part", "used", "before"])

    @F.pandas_udf("array<int>")
    def starts_of(costs: pd.Series, used: pd.Series) -> pd.Series:
        out = []
        for c, u in zip(costs, used):
            following, sums = next_starts(np.asarray(c, dtype=np.int64), limit)
            out.append(groups_from(0 if u < 0 else first_start(sums, int(u), limit), following))
        return pd.Series(out)

    told = ranges.select(F.col("chapter_no").cast("long").alias("chapter_no"), "part", summed("cost").alias("s"))
    chained = told.repartition("chapter_no").sortWithinPartitions("chapter_no", "part").mapInArrow(chain, "chapter_no long, part long, used long, before long")
    found = ranges.join(chained, ["chapter_no", "part"]).select("chapter_no", "pos", "before", F.size("cost").alias("size"), starts_of("cost", "used").alias("starts"))
    # Blocks before a range's first start belong to the group that was open.
    ends = F.concat(F.col("starts"), F.array("size"))
    counts = F.concat(F.array(F.element_at(ends, 1)), F.zip_with(F.col("starts"), F.slice(ends, F.lit(2), F.lit(1 << 30)), lambda a, b: b - a))
    pieces = F.flatten(F.transform(counts, lambda n, k: F.array_repeat(k, n)))
    rows = found.select("chapter_no", "before", F.explode(F.arrays_zip("pos", pieces.alias("group"))).alias("x"))
    return rows.select("chapter_no", F.col("x.pos").alias("pos"), (F.col("before") + F.col("x.group")).cast("int").alias("piece_no"))


def plan_long_chunks(blocks: DataFrame, budget: int, joint: bool = False, separator: str = "") -> DataFrame:
    """chapter_no, piece_no, source_html of blocks (chapter_no, pos, html), of chapters of any length: a piece is a row, a chapter never."""
    placed = pack_rows(blocks.select("chapter_no", "pos", utf16_length(F.col("html")).alias("n")), budget, joint)
    listed = F.array_sort(F.collect_list(F.struct("pos", "html")))
    text = F.array_join(F.transform(listed, lambda x: F.coalesce(x["html"], F.lit(""))), separator)
    return blocks.select("chapter_no", "pos", "html").join(placed, ["chapter_no", "pos"]).groupBy("chapter_no", "piece_no").agg(text.alias("source_html"))
