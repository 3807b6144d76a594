"""Pair maps: text lines ``path = path`` or ``A .. B = C .. D`` with # comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from .glossary_md import lines_of


def parse(docs: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, line_no, original_from, original_to, translation_from, translation_to, error.

    A point is a range of one. ``error`` says what is wrong with a line, or is null;
    with ``strict`` the first wrong line raises an error when it is computed.
    """
    rows = lines_of(docs).select("doc_id", (F.col("pos") + 1).alias("line_no"), trim_space(F.regexp_replace("line", "(?s)#.*$", "")).alias("t")).where("t != ''")
    sides = rows.withColumn("sides", F.transform(F.split("t", "="), trim_space))
    cut = sides.withColumn("o", F.transform(F.split(F.col("sides")[0], r"\.\."), trim_space)).withColumn("r", F.transform(F.split(F.try_element_at("sides", F.lit(2)), r"\.\."), trim_space))
    problem = (
        F.when(F.size("sides") < 2, "no '='")
        .when(F.size("sides") > 2, "more than one '='")
        .when(F.exists("sides", lambda s: s == ""), "a side is empty")
        .when((F.size("o") > 2) | (F.size("r") > 2), "a range has more than one '..'")
        .when(F.exists("o", lambda s: s == "") | F.exists("r", lambda s: s == ""), "a range bound is empty")
        .when(F.size("o") != F.size("r"), "one side is a range, the other is not")
    )
    error = F.when(problem.isNotNull(), F.concat(F.lit("invalid pair line '"), "t", F.lit("': "), problem))
    if strict:
        error = F.when(problem.isNotNull(), F.raise_error(error).cast("string"))
    out = cut.withColumn("error", error)
    end = lambda c: F.coalesce(F.try_element_at(c, F.lit(2)), F.try_element_at(c, F.lit(1)))
    return out.select("doc_id", "line_no", F.try_element_at("o", F.lit(1)).alias("original_from"), end("o").alias("original_to"), F.try_element_at("r", F.lit(1)).alias("translation_from"), end("r").alias("translation_to"), "error")
