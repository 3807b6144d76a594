"""A stated query set against all rows, in blocks of bounded size on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_blocks(index: DataFrame, queries: DataFrame, key: str, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, index_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """``fn(index block, query block)`` for every pair of blocks; rows are dealt to blocks by a hash of ``key``.

    A stated set of queries against all rows: the index is sent once for each query block, so work and
    shuffle grow with rows times queries. Equal rows and null keys are rows like any other; without
    queries, or without rows, there is no pair and no result. Both tables are read twice: pass stored ones. No task holds more than about
    ``index_rows`` + ``query_rows`` rows, whatever the number of equal vectors.
    """
    blocks = max(1, math.ceil(index.count() / index_rows))
    groups = max(1, math.ceil(queries.count() / query_rows))
    mine = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks).cast("long")).alias("_block")
    ours = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(groups).cast("long")).alias("_group")
    left = index.select("*", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_group"))
    right = queries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"), ours)
    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(fn, schema)
