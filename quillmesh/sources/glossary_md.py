"""Glossaries in Markdown: a title, a preamble, and entries with ``- key: value`` fields.

Parsing works on a table of lines, so many documents are parsed at once; a window
within a document finds the entry that each line belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered_text import write_ordered
from ..functions.text import KINDS, blank_to_null, parse_kind, split_list, trim_preamble, trim_space

#: The fields of an entry.
FIELDS = ("ru", "type", "notes", "do-not-use", "aliases")
ENTRY = "ord int, english string, ru string, kind string, notes string, do_not_use array<string>, aliases array<string>"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name), text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line; CRLF and CR end lines as LF does."""
    text = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def is_title(line: Column) -> Column:
    return line.rlike(r"^#(?!#)")


def is_entry(line: Column) -> Column:
    return line.rlike(r"^##(?!#)")


def parse_lines(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, preamble) and entries (doc_id, ord, ...) of a line table.

    With ``strict``, a document without a title or an entry without ``ru`` raises an
    error when it is computed; otherwise the title is null and such entries have a null ``ru``.
    Unknown fields are ignored; of a field given twice the last counts.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("ord", F.sum(is_entry(F.col("line")).cast("int")).over(order))
    before = marked.where("ord = 0")
    titled = before.withColumn("titles", F.sum(is_title(F.col("line")).cast("int")).over(order))
    docs = titled.groupBy("doc_id").agg(
        F.min_by(F.when(is_title(F.col("line")), trim_space(F.expr("substring(line, 2)"))), F.when(is_title(F.col("line")), F.col("pos"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("titles") > 0) & ~is_title(F.col("line")), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("preamble"),
    )
    docs = lines.select("doc_id").distinct().join(docs, "doc_id", "left").select("doc_id", "title", trim_preamble(F.coalesce("preamble", F.lit(""))).alias("preamble"))
    if strict:
        docs = docs.withColumn("title", F.coalesce("title", F.raise_error(F.concat(F.lit("no title in "), F.col("doc_id"))).cast("string")))

    trimmed = trim_space(F.col("line"))
    colon = F.instr(trimmed, ":")
    field = marked.where("ord > 0").withColumn("t", trimmed).withColumn("key", F.when(trimmed.startswith("- ") & (colon > 3), F.lower(trim_space(F.expr("substring(t, 3, instr(t, ':') - 3)")))))
    field = field.withColumn("value", F.expr("substring(t, instr(t, ':') + 1)"))
    last = lambda key: F.max_by(F.when(F.col("key") == key, trim_space(F.col("value"))), F.when(F.col("key") == key, F.col("pos")))
    heads = F.max(F.when(is_entry(F.col("line")), trim_space(F.expr("substring(line, 3)"))))
    entries = field.groupBy("doc_id", F.col("ord").cast("int").alias("ord")).agg(heads.alias("english"), *(last(k).alias(k) for k in FIELDS))
    ru = blank_to_null(F.col("ru"))
    if strict:
        ru = F.coalesce(ru, F.raise_error(F.concat(F.lit("no ru for entry "), F.col("english"))).cast("string"))
    entries = entries.select("doc_id", "ord", "english", ru.alias("ru"), parse_kind(F.coalesce("type", F.lit(""))).alias("kind"), blank_to_null(F.col("notes")).alias("notes"), split_list(F.col("do-not-use")).alias("do_not_use"), split_list(F.col("aliases")).alias("aliases"))
    return docs, entries


def parse(docs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``parse_lines`` of whole documents (doc_id, text)."""
    return parse_lines(lines_of(docs), strict)


def parse_model_output(outputs: DataFrame) -> DataFrame:
    """Entries of model answers (doc_id, text), from the first entry heading on.

    An answer with any malformed entry (no ``ru``) gives none at all, and so does one
    without a heading.
    """
    lines = lines_of(outputs)
    from_first = lines.withColumn("_first", F.min(F.when(is_entry(F.col("line")), F.col("pos"))).over(Window.partitionBy("doc_id"))).where("pos >= _first").drop("_first")
    _, entries = parse_lines(from_first, strict=False)
    bad = entries.where("ru is null or english = ''").select("doc_id").distinct()
    return entries.join(bad, "doc_id", "left_anti")


def format_entry(english: Column, ru: Column, kind: Column, notes: Column, do_not_use: Column, aliases: Column) -> Column:
    """An entry's Markdown, with a blank line before it; optional fields are left out where empty."""
    line = lambda key, value: F.concat(F.lit(f"- {key}: "), value, F.lit("\n"))
    kind = F.when(kind.isin(*KINDS), kind).otherwise(F.lit("other"))
    optional = lambda test, value: F.when(test, value).otherwise(F.lit(""))
    return F.concat(
        F.lit("\n## "), english, F.lit("\n"), line("ru", ru), line("type", kind),
        optional(blank_to_null(notes).isNotNull(), line("notes", notes)),
        optional(F.size(do_not_use) > 0, line("do-not-use", F.array_join(do_not_use, ", "))),
        optional(F.size(aliases) > 0, line("aliases", F.array_join(aliases, ", "))),
    )


def write(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, text: each glossary as Markdown, entries by ``ord``."""
    made = entries.select("doc_id", "ord", format_entry(*(F.col(c) for c in ("english", "ru", "kind", "notes", "do_not_use", "aliases"))).alias("md"))
    body = made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda e: e["md"]), "").alias("body"))
    pre = F.when(F.col("preamble") == "", F.lit("")).otherwise(F.concat(F.lit("\n"), F.col("preamble"), F.when(F.col("preamble").endswith("\n"), F.lit("")).otherwise(F.lit("\n"))))
    return docs.join(body, "doc_id", "left").select("doc_id", F.concat(F.lit("# "), "title", F.lit("\n"), pre, F.coalesce("body", F.lit(""))).alias("text"))


def candidates_markdown(terms: DataFrame) -> DataFrame:
    """One row, text: a list of candidate terms (term, ord) as Markdown."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda t: F.concat(F.lit("- "), t["term"], F.lit("\n"))), "")
    return terms.agg(F.concat(F.lit("# Term candidates\n\n"), listed).alias("text"))


def write_candidates(terms: DataFrame, path: str) -> int:
    """The same list (term, ord) as one file at ``path``, of any length, written by many tasks; its size in bytes."""
    return write_ordered(terms, ["ord"], F.concat(F.lit("- "), "term", F.lit("\n")), path, "# Term candidates\n\n")


def write_entries(title: str, preamble: str, entries: DataFrame, path: str) -> int:
    """A glossary (ENTRY) as one Markdown file at ``path``, as ``write`` has it, of any length, written by many tasks; its size in bytes."""
    head = f"# {title}\n" + (f"\n{preamble}" + ("" if preamble.endswith("\n") else "\n") if preamble else "")
    return write_ordered(entries, ["ord"], format_entry(*(F.col(c) for c in ("english", "ru", "kind", "notes", "do_not_use", "aliases"))), path, head)


def read_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ord, term: ``- term`` lines; of spellings that differ in case the first."""
    rows = lines_of(docs).where(F.col("line").startswith("- ")).select("doc_id", F.col("pos").alias("ord"), trim_space(F.expr("substring(line, 3)")).alias("term")).where("term != ''")
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("term")).orderBy("ord"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")
