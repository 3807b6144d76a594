"""Chunks: packing a chapter's blocks by a token budget, resuming, and putting chapters together again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import groups_from, next_starts
from ..functions.text import chunk_id, pair_prompt, split_equally, token_estimate, utf16_length


#: Blocks up to which a chapter is packed by a fold, which copies what it has at every block; longer ones by their sums.
SHORT = 2_000


def pack_starts(lengths: Column, budget: int, joint: bool = False) -> Column:
    """Where groups begin (0 first): a block that would exceed the budget starts the next group. None for no block.

    ``lengths`` is an array of block lengths in reading order. A group costs the sum
    of its blocks' lengths over four, each rounded down; with ``joint`` the quarter of their sum. Time is linear in the blocks: a
    short chapter is folded where it lies, of a long one the lengths go through Arrow.
    """
    cost = (lambda n: n) if joint else (lambda n: F.floor(n / 4))
    limit = budget * 4 + 3 if joint else budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        size = cost(n).cast("long")
        first = (acc["used"] + size > limit) | (acc["at"] == 0)
        return F.struct(F.when(first, size).otherwise(acc["used"] + size).alias("used"), (acc["at"] + 1).alias("at"), F.when(first, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    @F.pandas_udf("array<int>")
    def by_sums(costs: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else groups_from(0, next_starts(np.asarray(c, dtype=np.int64), limit)[0]) for c in costs], dtype=object)

    long = F.when(F.size(lengths) > SHORT, F.transform(lengths, lambda n: cost(n).cast("long")))
    return F.when(F.size(lengths) > SHORT, by_sums(long)).otherwise(F.aggregate(lengths, start, step)["starts"])


def pack_blocks(lengths: Column, budget: int, joint: bool = False) -> Column:
    """The group of each block, 0, 1, ..., as ``pack_starts`` has them."""
    starts = pack_starts(lengths, budget, joint)
    sizes = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.lit(1 << 30)), F.array(F.size(lengths))), lambda a, b: b - a)
    return F.flatten(F.transform(sizes, lambda n, k: F.array_repeat(k, n)))


def plan_chunks(chapters: DataFrame, budget: int, joint: bool = False, strict: bool = True, separator: str = "", fits_whole: bool = True) -> DataFrame:
    """chunk_id, chapter_no, piece_no, file_path, source_html of chapters (chapter_no, file_path, body_inner_html, block_fragments).

    A chapter that fits the budget is one chunk of its whole body (unless
    ``fits_whole`` is off), and so is one without blocks. With ``strict`` a block
    beyond the budget raises an error. Packing happens inside a row: nothing is shuffled.
    """
    blocks = F.coalesce("block_fragments", F.array().cast("array<string>"))
    whole = (F.size(blocks) == 0) | ((token_estimate(F.coalesce("body_inner_html", F.lit(""))) <= budget) & F.lit(fits_whole))
    parts = F.when(whole, F.array(F.coalesce("body_inner_html", F.lit("")))).otherwise(blocks)
    rows = chapters.select("chapter_no", "file_path", parts.alias("parts"))
    starts = pack_starts(F.transform("parts", utf16_length), budget, joint)
    if strict:
        over = F.exists("parts", lambda p: token_estimate(p) > budget)
        starts = F.when(over, F.raise_error(F.concat(F.lit("a block exceeds the token budget: "), "file_path")).cast("array<int>")).otherwise(starts)
    rows = rows.select("*", starts.alias("starts")).withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.lit(1 << 30)), F.array(F.size("parts"))))
    pieces = F.transform(F.arrays_zip("starts", "ends"), lambda g: F.array_join(F.slice("parts", g["starts"] + 1, g["ends"] - g["starts"]), separator))
    out = rows.select("chapter_no", "file_path", F.posexplode(pieces).alias("_p", "source_html"))
    return out.select(chunk_id(F.col("chapter_no"), F.col("_p") + 1).alias("chunk_id"), "chapter_no", (F.col("_p") + 1).alias("piece_no"), "file_path", "source_html")


def chapter_range(chapters: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chapters first..last, both counted; applied before anything is packed."""
    if first is None:
        return chapters
    return chapters.where(F.col("chapter_no").between(first, first if last is None else last))


def parse_chapter_range(spec: str | None, count: int) -> tuple[int, int]:
    """(first, last) of ``n`` or ``a-b``, or of all chapters; an error names the number of chapters."""
    if spec is None or not spec.strip():
        return 1, count
    ends = [p.strip() for p in spec.split("-")]
    if len(ends) > 2 or not all(p.isdecimal() for p in ends):
        raise ValueError(f"chapter range '{spec}' is not 'n' or 'a-b' (the book has {count} chapters)")
    first, last = int(ends[0]), int(ends[-1])
    if not 1 <= first <= last <= count:
        raise ValueError(f"chapter range '{spec}' is outside 1-{count} (the book has {count} chapters)")
    return first, last


def resume(planned: DataFrame, previous: DataFrame) -> DataFrame:
    """``planned`` chunks with their status and html from ``previous`` (chunk_id, status, html).

    New chunks are pending; so are done ones whose html is missing or empty. Chunks no longer planned vanish.
    """
    old = previous.select("chunk_id", F.col("status").alias("_status"), F.col("html").alias("_html"))
    lost = (F.col("_status") == "done") & (F.coalesce("_html", F.lit("")) == "")
    status = F.when(lost, "pending").otherwise(F.coalesce("_status", F.lit("pending")))
    return planned.join(old, "chunk_id", "left").withColumn("status", status).withColumn("html", F.when(F.col("status") == "done", F.col("_html"))).drop("_status", "_html")


def remaining(planned: DataFrame, previous: DataFrame) -> DataFrame:
    """Planned chunks that are not done."""
    done = previous.where("status = 'done' and coalesce(html, '') != ''").select("chunk_id")
    return planned.join(done, "chunk_id", "left_anti")


def assemble(chunks: DataFrame) -> DataFrame:
    """chapter_no, file_path, body: chapters from chunks (chapter_no, piece_no, file_path, source_html, html), untranslated ones by their source."""
    text = F.coalesce("html", "source_html")
    pieces = F.array_sort(F.collect_list(F.struct("piece_no", text.alias("t"))))
    return chunks.groupBy("chapter_no", "file_path").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("body"))


def join_plain_text(chapters: DataFrame, book_col: str = "book_id") -> DataFrame:
    """book_id, text: chapters' plain text in order, joined by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("chapter_no", "plain_text")))
    return chapters.groupBy(book_col).agg(F.array_join(F.transform(parts, lambda p: p["plain_text"]), "\n").alias("text"))


def status_counts(chunks: DataFrame) -> DataFrame:
    """n, n_done, n_failed, has_failures."""
    return chunks.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("has_failures"))


def pair_places() -> tuple[Column, ...]:
    """The columns by which a pair is named in its prompt, before and after its texts."""
    return tuple(F.col(c) for c in ("o_idx", "n_o", "o_path", "t_idx", "n_t", "t_path"))


def wrapped_pair(o_text: Column, t_text: Column) -> Column:
    """The prompt of a pair from its places and two texts."""
    o_idx, n_o, o_path, t_idx, n_t, t_path = pair_places()
    return pair_prompt(o_idx, n_o, o_path, o_text, t_idx, n_t, t_path, t_text)


def split_pairs(pairs: DataFrame, budget: int, most: int = 1000) -> DataFrame:
    """``pairs`` (o_idx, n_o, o_path, o_text, t_idx, n_t, t_path, t_text, ...) with parts, piece and prompt: each cut into the fewest equal parts whose prompts fit the budget.

    Both texts are cut into the same number of parts, 2 to ``most`` if the whole
    does not fit; a side that runs out is empty. What is costed is the whole prompt, with
    the lines around the texts, in UTF-16 units. Slices are of characters; where a text has
    characters of two units, all its are costed so. A pair that never fits raises an error.
    """
    around = utf16_length(wrapped_pair(F.lit(""), F.lit("")))
    room = F.lit(4 * budget + 3) - around
    unit = lambda c: F.when(utf16_length(F.col(c)) > F.length(c), 2).otherwise(1)
    rows = pairs.withColumns({"_room": room, "_units": utf16_length(F.col("o_text")) + utf16_length(F.col("t_text")), "_uo": unit("o_text"), "_ut": unit("t_text")})
    size = lambda p: F.ceil(F.length("o_text") / p) * F.col("_uo") + F.ceil(F.length("t_text") / p) * F.col("_ut")
    # The first parts are the largest. Between the quotient by the room and that by the room less what rounding adds lies the least number that fits.
    low = F.greatest(F.lit(2), F.ceil(F.col("_units") / F.greatest("_room", F.lit(1))))
    high = F.least(F.lit(most), F.greatest(low, F.ceil(2 * F.col("_units") / F.greatest(F.col("_room") - 4, F.lit(1))) + 1))
    tried = F.when(low <= most, F.sequence(F.least(low, F.lit(most)).cast("int"), F.greatest(high, F.least(low, F.lit(most))).cast("int"))).otherwise(F.array().cast("array<int>"))
    need = F.when(F.col("_units") <= F.col("_room"), 1).otherwise(F.array_min(F.filter(tried, lambda p: size(p) <= F.col("_room"))))
    rows = rows.withColumn("parts", F.coalesce(need, F.raise_error(F.concat(F.lit("a pair does not fit the budget: "), "o_path")).cast("int"))).drop("_room", "_units", "_uo", "_ut")
    cut = rows.withColumns({"_o": split_equally(F.col("o_text"), F.col("parts")), "_t": split_equally(F.col("t_text"), F.col("parts"))})
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_o"), F.size("_t")))))
    at = lambda c: F.coalesce(F.try_element_at(c, F.col("piece")), F.lit(""))
    cut = cut.withColumns({"o_text": at("_o"), "t_text": at("_t"), "parts": F.greatest(F.size("_o"), F.size("_t"))}).drop("_o", "_t")
    return cut.withColumn("prompt", wrapped_pair(F.col("o_text"), F.col("t_text")))
