"""Term candidates: capitalised phrases that are neither stop words nor in the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import strip_tags
from ..functions.text import capitalised_phrases, is_stop_phrase


def phrases(chunks: DataFrame, order_col: str, html_col: str = "source_html") -> DataFrame:
    """order_col, pos, phrase: every capitalised phrase of every chunk."""
    return chunks.select(order_col, F.posexplode(capitalised_phrases(strip_tags(F.col(html_col)))).alias("pos", "phrase"))


def candidate_terms(chunks: DataFrame, terms: DataFrame, order_col: str, html_col: str = "source_html") -> DataFrame:
    """term, n, first_chunk: phrases that are candidates, in their first spelling by (order_col, pos).

    Spellings that differ in case are one phrase: counted map-side, then shuffled once. The
    anti-join with ``terms`` (term) comes after, when each phrase is one row.
    """
    found = phrases(chunks, order_col, html_col).where(~is_stop_phrase(F.col("phrase")))
    place = F.struct(order_col, "pos", "phrase")
    each = found.groupBy(F.lower("phrase").alias("_key")).agg(F.min(place).alias("_first"), F.count("*").alias("n"))
    known = terms.select(F.lower("term").alias("_key")).distinct()
    return each.join(known, "_key", "left_anti").select(F.col("_first.phrase").alias("term"), "n", F.col(f"_first.{order_col}").alias("first_chunk"))
