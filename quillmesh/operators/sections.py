"""Sections of two editions: previews, pairs by position, by role and by map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import classify_role
from ..functions.text import is_blank, length_ratio, pair_path_key, preview
from .numbering import before, number_within

#: Lines of a pair map up to which it is a small table.
SMALL = 10_000


def number_sections(chapters: DataFrame, book_col: str = "book_id", order_col: str = "spine") -> DataFrame:
    """``chapters`` with idx, 1, 2, ... within a book, blank sections left out first."""
    return number_within(chapters.where(~is_blank(F.col("plain_text"))), book_col, order_col, "idx")


def preview_sections(sections: DataFrame) -> DataFrame:
    """idx, file_path, preview, role, n_chars of numbered sections (idx, file_path, heading, plain_text)."""
    return sections.select("idx", "file_path", preview(F.col("plain_text")).alias("preview"), classify_role(F.col("heading"), F.col("plain_text")).alias("role"), F.length("plain_text").alias("n_chars"))


def spine_pairs(original: DataFrame, translation: DataFrame) -> DataFrame:
    """Full outer join of previews by position: idx, both sides' columns, ratio, is_tail."""
    columns = ("file_path", "preview", "role", "n_chars")
    o = original.select("idx", *(F.col(c).alias(f"o_{c}") for c in columns))
    t = translation.select("idx", *(F.col(c).alias(f"t_{c}") for c in columns))
    both = o.join(t, "idx", "full")
    return both.withColumn("ratio", length_ratio(F.col("o_n_chars"), F.col("t_n_chars"))).withColumn("is_tail", F.col("o_file_path").isNull() | F.col("t_file_path").isNull())


def index_pairs(original: DataFrame, translation: DataFrame) -> DataFrame:
    """Inner join by position: idx, o_file_path, t_file_path."""
    return original.select("idx", F.col("file_path").alias("o_file_path")).join(translation.select("idx", F.col("file_path").alias("t_file_path")), "idx")


def index_tail(original: DataFrame, translation: DataFrame) -> DataFrame:
    """side, idx, file_path of sections without a counterpart at their position."""
    left = original.join(translation, "idx", "left_anti").select(F.lit("original").alias("side"), "idx", "file_path")
    return left.unionByName(translation.join(original, "idx", "left_anti").select(F.lit("translation").alias("side"), "idx", "file_path"))


def role_counts(original: DataFrame, translation: DataFrame) -> DataFrame:
    """One row per role: how many sections of each side have it."""
    both = original.select("role", F.lit(1).alias("o"), F.lit(0).alias("t")).unionByName(translation.select("role", F.lit(0).alias("o"), F.lit(1).alias("t")))
    return both.groupBy("role").agg(F.sum("o").alias("n_o"), F.sum("t").alias("n_t"))


def role_pairs(original: DataFrame, translation: DataFrame) -> DataFrame:
    """role, o_file_path, t_file_path of roles that exactly one section has on either side; ``other`` is none."""
    only = role_counts(original, translation).where("n_o = 1 and n_t = 1 and role != 'other'").select("role")
    o = original.join(only, "role", "left_semi").select("role", F.col("file_path").alias("o_file_path"))
    return o.join(translation.select("role", F.col("file_path").alias("t_file_path")), "role")


def role_unpaired(original: DataFrame, translation: DataFrame) -> DataFrame:
    """side, role, idx, file_path, reason of the sections that ``role_pairs`` leaves out."""
    quoted = F.concat(F.lit("'"), F.col("role"), F.lit("'"))
    reason = (
        F.when(F.col("role") == "other", "role 'other' is not paired")
        .when(F.col("n_o") > 1, F.concat(F.lit("duplicate role key "), quoted, F.lit(" on original")))
        .when(F.col("n_t") > 1, F.concat(F.lit("duplicate role key "), quoted, F.lit(" on translation")))
        .when((F.col("n_o") == 0) | (F.col("n_t") == 0), F.concat(F.lit("no counterpart for "), quoted))
    )
    why = role_counts(original, translation).select("role", reason.alias("reason")).where("reason is not null")
    sides = original.select(F.lit("original").alias("side"), "role", "idx", "file_path").unionByName(translation.select(F.lit("translation").alias("side"), "role", "idx", "file_path"))
    return sides.join(why, "role").select("side", "role", "idx", "file_path", "reason")


def expand_pair_map(pair_map: DataFrame, original: DataFrame, translation: DataFrame, max_pairs: int | None = None, strict: bool = True) -> DataFrame:
    """ord, o_idx, t_idx, o_file_path, t_file_path, error: the sections that a map pairs, in the map's order.

    Paths are compared without case; a path given to several sections means the
    first. A line whose paths are unknown, whose ranges run backwards or differ in
    length, or which names a section that another line names too, is an error:
    raised with ``strict``, else one row with ``error`` set. ``max_pairs`` keeps the
    first pairs only.
    """

    def first_of(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(pair_path_key(F.col("file_path")).alias(f"_{name}")).agg(F.min("idx").alias(name))

    rows = pair_map
    for name, side, column in (("o_from", original, "original_from"), ("o_to", original, "original_to"), ("t_from", translation, "translation_from"), ("t_to", translation, "translation_to")):
        found = first_of(side, name)
        rows = rows.join(found, pair_path_key(F.col(column)) == found[f"_{name}"], "left").drop(f"_{name}")
    missing = F.col("o_from").isNull() | F.col("o_to").isNull() | F.col("t_from").isNull() | F.col("t_to").isNull()
    error = (
        F.when(missing, "a path is not in the book")
        .when((F.col("o_from") > F.col("o_to")) | (F.col("t_from") > F.col("t_to")), "a range runs backwards")
        .when(F.col("o_to") - F.col("o_from") != F.col("t_to") - F.col("t_from"), "the ranges differ in length")
    )
    rows = rows.withColumn("error", error)
    # Places come from the lines' lengths; whether ranges overlap, from their ends. Only lines that overlap another are looked at section by section.
    size = F.when(F.col("error").isNull(), F.col("o_to") - F.col("o_from") + 1).otherwise(1).cast("long")
    if max_pairs is not None and max_pairs <= 0:
        raise ValueError("max_pairs must be positive")
    rows = rows.withColumn("_size", size)
    if pair_map.limit(SMALL + 1).count() <= SMALL:
        rows = _placed_at_once(rows)
    else:
        rows = before(rows, ["line_no"], {"_start": ("sum", "_size")})
        clash = [overlapping(rows.where("error is null"), f"{s}_from", f"{s}_to") for s in "ot"]
        rows = rows.join(clash[0].unionByName(clash[1]).distinct().withColumn("_clash", F.lit(True)), "line_no", "left")
    if max_pairs is not None:
        rows = rows.where(F.col("_clash") | (F.coalesce("_start", F.lit(0)) < max_pairs))
    wide = rows.select("line_no", "o_from", "t_from", "error", "_clash", F.coalesce("_start", F.lit(0)).alias("_start"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)).alias("k"))
    pairs = wide.select("line_no", (F.col("_start") + F.col("k") + 1).cast("int").alias("ord"), (F.col("o_from") + F.col("k")).cast("int").alias("o_idx"), (F.col("t_from") + F.col("k")).cast("int").alias("t_idx"), "error", "_clash")
    twice = (F.count("*").over(Window.partitionBy("o_idx")) > 1) | (F.count("*").over(Window.partitionBy("t_idx")) > 1)
    odd = pairs.where("_clash").withColumn("error", F.coalesce("error", F.when(twice, "a section is named twice")))
    pairs = pairs.where("_clash is null").unionByName(odd).drop("_clash")
    if strict:
        pairs = pairs.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("pair map line "), F.col("line_no").cast("string"), F.lit(": "), "error")).cast("string")))
    if max_pairs is not None:
        pairs = pairs.where(F.col("ord") <= max_pairs)
    o = original.select(F.col("idx").alias("o_idx"), F.col("file_path").alias("o_file_path"))
    t = translation.select(F.col("idx").alias("t_idx"), F.col("file_path").alias("t_file_path"))
    return pairs.join(o, "o_idx", "left").join(t, "t_idx", "left").select("ord", "o_idx", "t_idx", "o_file_path", "t_file_path", "error")


def _placed_at_once(rows: DataFrame) -> DataFrame:
    """``_start`` and ``_clash`` of at most SMALL lines: the same sums and sweep in one task, without joins."""
    ok, clash = F.col("error").isNull(), F.lit(False)
    for s in "ot":
        order = Window.orderBy(f"{s}_from", f"{s}_to", "line_no")
        far = F.max(F.when(ok, F.col(f"{s}_to"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.min(F.when(ok, F.col(f"{s}_from"))).over(order.rowsBetween(1, Window.unboundedFollowing))
        clash = clash | F.coalesce(far >= F.col(f"{s}_from"), F.lit(False)) | F.coalesce(ahead <= F.col(f"{s}_to"), F.lit(False))
    start = F.sum("_size").over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"_start": start, "_clash": F.when(ok & clash, True)})


def overlapping(ranges: DataFrame, first: str, last: str, id_col: str = "line_no") -> DataFrame:
    """id_col (a number) of the ranges (first to last, both counted) that share a place with another one: a sweep over their ends.

    In the order of their beginnings, a range meets one before it if the furthest end before it lies at or behind its beginning, and
    one behind it if the next beginning lies at or before its end. Ranges are not expanded.
    """
    rows = ranges.select(F.col(id_col), F.col(first).cast("long").alias("_a"), F.col(last).cast("long").alias("_z"))
    ahead = before(rows, ["_a", "_z", id_col], {"_far": ("max", "_z")}).where("_far >= _a").select(id_col)
    turned = rows.select(id_col, (-F.col(id_col)).alias("_i"), (-F.col("_a")).alias("_a"), (-F.col("_z")).alias("_z"))
    behind = before(turned, ["_a", "_z", "_i"], {"_next": ("max", "_a")}).where("_next >= _z").select(id_col)
    return ahead.unionByName(behind).distinct()


def preview_report(spine: DataFrame, roles: DataFrame, unpaired: DataFrame) -> DataFrame:
    """One row, text: the four tables as lines, columns two blanks apart."""
    gap = "  "
    side = lambda p: F.when(F.col(f"{p}_file_path").isNull(), "TAIL").otherwise(F.concat_ws(gap, f"{p}_file_path", f"{p}_preview", F.col(f"{p}_n_chars").cast("string"), f"{p}_role"))
    ratio = F.when(F.col("ratio").isNull(), "—").otherwise(F.format_string("%.2f", "ratio"))
    parts = [
        spine.select(F.lit(0).alias("part"), F.col("idx").alias("n"), F.lit("").alias("k"), F.concat_ws(gap, F.col("idx").cast("string"), side("o"), side("t"), ratio).alias("line")),
        roles.select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.col("role").alias("k"), F.concat_ws(gap, "role", "o_file_path", "t_file_path").alias("line")),
        unpaired.select(F.when(F.col("side") == "original", 2).otherwise(3).alias("part"), F.col("idx").alias("n"), F.col("role").alias("k"), F.concat_ws(gap, "role", "file_path", "reason").alias("line")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    lines = lambda n: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("part", "k", "n", "line")), lambda x: x["part"] == n)), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    heads = ("Spine pairs\n", "\nSuggested role pairs\n", "\nUNPAIRED original\n", "\nUNPAIRED translation\n")
    return rows.agg(F.concat(*(x for n, h in enumerate(heads) for x in (F.lit(h), lines(n)))).alias("text"))
