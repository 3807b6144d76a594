"""Checks of a translated fragment against its source, in the order in which they fail."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import count_blocks, count_blocks_of, tag_names, tag_names_of, visible_text_of
from .text import is_blank, trim_space

#: English words that show untranslated prose.
FUNCTION_WORDS = "the and was with that a an of to in for on at by is are were be been this these those from or but not".split()
#: What may stand between two words of one phrase, beside white space.
PHRASE_GAP = ",'\"\u2019\u2018\u00ab\u00bb-"
#: Reasons.
EMPTY, TRUNCATED, NO_TAGS, DROPPED = "empty", "truncated", "no source tags", "dropped blocks"
ENGLISH = "English function word: "

_WORDS = frozenset(FUNCTION_WORDS)
_TOKEN = re.compile(r"[^\W]+")
_GAP = re.compile(rf"[\s{re.escape(PHRASE_GAP)}]*")


def is_truncated(finish_reason: Column) -> Column:
    return F.coalesce(F.lower(finish_reason).isin("length", "max_tokens"), F.lit(False))


def has_no_source_tags(source: Column, content: Column) -> Column:
    return (F.size(tag_names(source)) > 0) & ~F.arrays_overlap(tag_names(source), tag_names(content))


def has_dropped_blocks(source: Column, content: Column) -> Column:
    return (count_blocks(source) >= 2) & (count_blocks(content) * 2 < count_blocks(source))


def is_protocol_like(line: Column) -> Column:
    """Blank lines, binary runs and lines of mostly numbers, which the English check skips."""
    t = trim_space(line)
    digits, letters = F.regexp_count(t, F.lit("[0-9]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    return (t == "") | F.regexp_like(t, F.lit("[01]{8,}")) | ((digits >= 6) & (digits * 2 >= letters)) | ((digits >= 4) & F.regexp_like(t, F.lit("[=%/>]")))


def structural_reason(source: Column, content: Column, finish_reason: Column) -> Column:
    """The first structural check that fails, or null. Built-in expressions only."""
    return (
        F.when(is_blank(content), EMPTY)
        .when(is_truncated(finish_reason), TRUNCATED)
        .when(has_no_source_tags(source, content), NO_TAGS)
        .when(has_dropped_blocks(source, content), DROPPED)
    )


def _protocol_like(line: str) -> bool:
    t = line.strip()
    digits, letters = sum("0" <= c <= "9" for c in t), sum(c.isascii() and c.isalpha() for c in t)
    return not t or re.search("[01]{8,}", t) is not None or (digits >= 6 and 2 * digits >= letters) or (digits >= 4 and any(c in t for c in "=%/>"))


def english_check(content: str) -> tuple[str | None, list[str]]:
    """(reason, warnings): English prose in the visible text.

    Neighbouring ASCII words joined by white space or phrase marks are a run. A run
    with a function word fails if it has three words, or two function words; else it
    warns, three times at most. The first failing run gives the reason.
    """
    warnings: list[str] = []
    for line in visible_text_of(content).split("\n"):
        if _protocol_like(line):
            continue
        runs: list[list[re.Match]] = []
        last = None
        for m in _TOKEN.finditer(line):
            plain = m[0].isascii() and m[0].isalpha()
            if plain and last is not None and _GAP.fullmatch(line, last.end(), m.start()):
                runs[-1].append(m)
            elif plain:
                runs.append([m])
            last = m if plain else None
        for run in runs:
            known = [m[0] for m in run if m[0].lower() in _WORDS]
            if not known:
                continue
            at = max(0, run[0].start() - 30)
            context = re.sub(r"\s+", " ", line[at : at + 120]).replace('"', "'")
            reason = f'{ENGLISH}{known[0]}; context: "{context}"'
            if len(run) >= 3 or len(known) >= 2:
                return reason, []
            if len(warnings) < 3:
                warnings.append(reason)
    return None, warnings


def check_answer(source: str, content: str | None, finish_reason: str | None) -> tuple[str | None, list[str]]:
    """(reason, warnings) of one answer, by all checks in order: what the translation loop applies."""
    if not (content or "").strip():
        return EMPTY, []
    if (finish_reason or "").lower() in ("length", "max_tokens"):
        return TRUNCATED, []
    wanted = tag_names_of(source)
    if wanted and not wanted & tag_names_of(content):
        return NO_TAGS, []
    blocks = count_blocks_of(source)
    if blocks >= 2 and 2 * count_blocks_of(content) < blocks:
        return DROPPED, []
    return english_check(content)


CHECKED = T.StructType([T.StructField("reason", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))])


@F.pandas_udf(CHECKED)
def checked(source: pd.Series, content: pd.Series, finish_reason: pd.Series) -> pd.DataFrame:
    """``check_answer`` of each row."""
    found = [check_answer(s or "", c, f) for s, c, f in zip(source, content, finish_reason)]
    return pd.DataFrame({"reason": [f[0] for f in found], "warnings": [f[1] for f in found]})


@F.pandas_udf(T.StructType([T.StructField("reason", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))]))
def english(content: pd.Series) -> pd.DataFrame:
    found = [(None, []) if c is None else english_check(c) for c in content]
    return pd.DataFrame({"reason": [f[0] for f in found], "warnings": [f[1] for f in found]})


def validate(source: Column, content: Column, finish_reason: Column) -> Column:
    """STRUCT<is_valid, reason, warnings> by all checks in order."""
    first = structural_reason(source, content, finish_reason)
    prose = english(content)
    reason = F.coalesce(first, prose["reason"])
    none = F.array().cast("array<string>")
    return F.struct(reason.isNull().alias("is_valid"), reason.alias("reason"), F.when(reason.isNull(), prose["warnings"]).otherwise(none).alias("warnings"))
