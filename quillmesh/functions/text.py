"""Text expressions. All are built-in Spark functions over Columns: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelt out because Java's \\s and Spark's trim() know ASCII only.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: Words of which a phrase of nothing else is not a term.
STOP_WORDS = "the a an and of in on for to with that this these those was were is are from by at".split()

#: The kinds of a glossary entry; anything else is "other".
KINDS = ("name", "title", "organization", "artifact", "geography", "formula")


def trim_space(x: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(x: Column) -> Column:
    return x.isNull() | (trim_space(x) == "")


def blank_to_null(x: Column) -> Column:
    return F.when(~is_blank(x), trim_space(x))


def collapse_space(x: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("long")


def token_estimate(x: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded down."""
    return F.floor(utf16_length(x) / 4)


def tokens_of(x: str) -> int:
    """``token_estimate`` of one value."""
    return len(x.encode("utf-16-le")) // 8


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def session_id(prefix: Column) -> Column:
    """SHA-256 of a prefix in upper-case hex."""
    return F.upper(F.sha2(prefix, 256))


def preview(x: Column, width: int = 80) -> Column:
    """The first ``width`` UTF-16 units of a text with its white space collapsed; a pair of units is not cut."""
    line = F.left(collapse_space(x), F.lit(width))
    fits = F.filter(F.sequence(F.lit(0), F.length(line)), lambda n: utf16_length(F.left(line, n)) <= width)
    return F.when(utf16_length(line) <= width, line).otherwise(F.left(line, F.array_max(fits)))


def split_list(x: Column) -> Column:
    """A comma list: parts trimmed, empty ones dropped; null as an empty list."""
    parts = F.transform(F.split(x, ","), trim_space)
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def parse_kind(x: Column) -> Column:
    kind = F.lower(trim_space(x))
    return F.when(kind.isin(*KINDS), kind).otherwise(F.lit("other"))


def trim_preamble(x: Column) -> Column:
    """Without blank lines at either end; those inside stay."""
    blank = r"[^\S\n]*"
    return F.regexp_replace(F.regexp_replace(x, rf"^(?:{blank}\n)+", ""), rf"(?:\n{blank})+$", "")


def entry_path(x: Column) -> Column:
    """A path inside an archive: forward slashes, none at the ends."""
    return F.regexp_replace(F.translate(x, "\\", "/"), "^/+|/+$", "")


def pair_path(x: Column) -> Column:
    """As ``entry_path``, white space trimmed first."""
    return entry_path(trim_space(x))


def pair_path_key(x: Column) -> Column:
    """What two pair paths are compared by: case does not count."""
    return F.lower(pair_path(x))


def chunk_id(chapter: Column, piece: Column) -> Column:
    return F.format_string("%04d-%04d", chapter, piece)


def step_label(index: Column, path: Column, piece: Column, pieces: Column) -> Column:
    base = F.concat_ws(":", index.cast("string"), path)
    return F.when(pieces > 1, F.concat_ws("#", base, piece.cast("string"))).otherwise(base)


def safe_file_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9-]", "_")


def length_ratio(left: Column, right: Column) -> Column:
    """right / left, or null if either is missing or left is not positive."""
    return F.when(left > 0, right.cast("double") / left)


def is_epub(path: Column) -> Column:
    return F.lower(path).endswith(".epub")


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def compact_error(x: Column, width: int = 500) -> Column:
    return F.left(F.trim(F.regexp_replace(x, r"[\s\p{Cntrl}\u0085\u00A0]+", " ")), F.lit(width))


def backoff_ms(attempt: Column) -> Column:
    """100 ms doubled for each attempt after the first, six times at most."""
    return F.lit(100) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(6))).cast("int")


def source_budget(context: Column, reserved: Column, prefix: Column, max_input: Column, multiplier: Column, reserve: Column) -> Column:
    """Tokens left for source: the least of what the context, the input limit and the expected output leave."""
    by_context = context.cast("long") - prefix - reserved
    by_input = max_input.cast("long") - prefix
    by_output = F.when(multiplier > 0, F.floor((reserved.cast("long") - reserve) / multiplier))
    return F.least(by_context, by_input, by_output)


def quoted(term: Column) -> Column:
    """A term as a regular expression that matches it literally."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def appears_in(text: Column, term: Column, lowered: Column | None = None) -> Column:
    """Whether a term occurs in a text, ignoring case, with no ASCII letter on either side.

    ``lowered`` may hold the lower-cased text, so that the cheap substring test which
    comes first does not lower it again for each term.
    """
    inside = F.contains(F.lower(text) if lowered is None else lowered, F.lower(term))
    pattern = F.concat(F.lit("(?iu)(?<![A-Za-z])"), quoted(term), F.lit("(?![A-Za-z])"))
    return F.when((term == "") | term.isNull() | text.isNull(), F.lit(False)).when(~inside, F.lit(False)).otherwise(F.regexp_like(text, pattern))


def split_equally(text: Column, parts: Column) -> Column:
    """A text as slices of ceil(length / parts) characters."""
    size = F.greatest(F.ceil(F.length(text) / parts), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), size)
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, size)))


def stable_prefix(rules: Column, glossary: Column) -> Column:
    """Rules, a blank line and the glossary; the glossary alone where there are no rules."""
    return F.when(is_blank(rules), glossary).otherwise(F.concat(F.regexp_replace(rules, SPACE + "+$", ""), F.lit("\n\n"), glossary))


def pair_prompt(o_index: Column, o_count: Column, o_path: Column, o_text: Column, t_index: Column, t_count: Column, t_path: Column, t_text: Column) -> Column:
    return F.format_string("Original [%d/%d] %s:\n%s\n\nTranslation [%d/%d] %s:\n%s", o_index, o_count, o_path, o_text, t_index, t_count, t_path, t_text)


def is_stop_phrase(phrase: Column) -> Column:
    return F.forall(F.split(phrase, " "), lambda w: F.lower(w).isin(*STOP_WORDS))


def capitalised_phrases(text: Column) -> Column:
    """Runs of capitalised ASCII words, spaces collapsed, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]+)*)(?![A-Za-z])"), 1)
    return F.transform(found, lambda p: F.regexp_replace(p, r"[ \t]+", " "))
