"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few, stored


def _stars(edges: DataFrame, keep) -> DataFrame:
    """Each node's chosen neighbours linked to the least node beside it. Degrees are summed map-side; a hot node's rows can be split by the join."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of ``edges`` (a, b: long) reaches.

    Nodes without an edge to another node have no row. Edges may repeat and go
    either way; those with a null end are ignored. Rounds grow with the logarithm
    of the longest chain; each is written to the shared folder, and deleted when the next one is there.
    """
    spark = edges.sparkSession
    now, at = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct())
    state, rows = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, between = stored(in_few(_stars(both, F.col("v") > F.col("u")).distinct(), rows))
        # Downward neighbours and the node itself go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now, last = stored(in_few(small.where("u != v").distinct(), rows))
        discard(spark, at, between)
        at = last
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, rows = tuple(seen), seen[0]
