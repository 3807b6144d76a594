"""Glossary operators: which entries occur in a text, and the merge of two glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import appears_in, is_blank, trim_space

#: Keys of terms up to this number are looked up where a text lies; more are joined by a shuffle.
BROADCAST_TERMS = 5_000
#: Runs of letters in a key at most; characters in the key of a term without an ASCII letter at most.
RUNS, GRAM = 3, 3
#: Characters of a run by which notes are told apart.
PIECE = 8


def terms_of(entries: DataFrame) -> DataFrame:
    """ord, term: each entry's English name and aliases."""
    return entries.select("ord", F.explode(F.array_prepend(F.coalesce("aliases", F.array().cast("array<string>")), F.col("english"))).alias("term")).where(~is_blank(F.col("term")))


def _windows(items: Column, n: int, join: str) -> Column:
    """Each n consecutive items as one text; none if there are fewer. ``items`` should be a column: it is read n times."""
    out = items
    for k in range(1, n):  # beyond the end there is null, which makes the whole null
        out = F.filter(F.zip_with(out, F.slice(items, F.lit(k + 1), F.lit(1 << 30)), lambda x, y: F.concat(x, F.lit(join), y)), lambda w: w.isNotNull())
    return out


def _runs(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("([a-z]+)"), 1)


def _characters(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("(?s)(.)"), 1)


def _named(kind: str, windows: Column) -> Column:
    """Keys that say of themselves how many runs (w) or characters (c) they have."""
    return F.transform(windows, lambda w: F.concat(F.lit(f"{kind} "), w))


def term_keys(terms: DataFrame) -> DataFrame:
    """ord, term, _key: one key for each term, which every text that the term appears in has too.

    No ASCII letter may stand beside a term, so its runs of ASCII letters are whole runs of such a text, and follow each other
    there: up to RUNS consecutive ones make a key. A term without an ASCII letter has up to GRAM consecutive characters instead. Of a
    term's possible keys that is taken which the fewest terms could have, so that a word that half of them begin with keys none of them.
    """
    rows = terms.where("term != ''").select("ord", "term", _runs(F.lower("term")).alias("_runs"), _characters(F.lower("term")).alias("_chars"))
    many = lambda c, n, most: (F.size(c) == n) if n < most else (F.size(c) >= n)
    kinds = [F.when(many("_runs", n, RUNS), _named(f"w{n}", _windows(F.col("_runs"), n, " "))) for n in range(1, RUNS + 1)]
    kinds += [F.when(many("_chars", n, GRAM), _named(f"c{n}", _windows(F.col("_chars"), n, ""))) for n in range(1, GRAM + 1)]
    possible = rows.select("ord", "term", F.explode(F.array_distinct(F.coalesce(*kinds))).alias("_key"))
    counts = possible.groupBy("_key").agg(F.count("*").alias("_n"))
    best = F.min(F.struct("_n", (-F.length("_key")).alias("_l"), "_key"))
    return possible.join(counts, "_key").groupBy("ord", "term").agg(best.alias("_b")).select("ord", "term", F.col("_b._key").alias("_key"))


def with_keys(texts: DataFrame, text_col: str, kinds: list[str]) -> DataFrame:
    """``texts`` with ``_keys``: each text's distinct keys of the given kinds (``w1`` .. or ``c1`` ..)."""
    text = F.col(text_col)
    low = F.lower(text)
    # The Kelvin sign is no ASCII letter, but its lower case is one: it may end a run, or be of it.
    other = F.when(F.contains(text, F.lit("\u212a")), _runs(F.lower(F.replace(text, F.lit("\u212a"), F.lit(" "))))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    words, chars = any(k[0] == "w" for k in kinds), any(k[0] == "c" for k in kinds)
    rows = texts.withColumns({"_runs": _runs(low) if words else none, "_other": other if words else none, "_chars": _characters(low) if chars else none})
    made = []
    for kind in kinds:
        n = int(kind[1:])
        made += [_named(kind, _windows(F.col(c), n, join)) for c, join in ((("_runs", " "), ("_other", " ")) if kind[0] == "w" else (("_chars", ""),))]
    return rows.withColumn("_keys", F.array_distinct(F.flatten(F.array(*made)))).drop("_runs", "_other", "_chars")


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """id_col, ord, term: which terms (ord, term) appear in which texts, each term once for a row of ``texts``.

    Terms are found by a key (``term_keys``) that a text must have, then tested in the text: work grows with the texts and
    with what is found, not with texts times terms. Up to ``broadcast_terms`` keys, by count, are looked up where the text lies, and
    nothing is shuffled. More are joined with (id, key) rows without texts; what that finds is tested beside its text, and
    rows of one id are one text's worth of candidates.
    """
    keyed = term_keys(terms.select("ord", "term"))
    some = keyed.select("_key").distinct().limit(broadcast_terms + 1).collect()
    if not some:
        return texts.select(id_col).crossJoin(terms.select("ord", "term").limit(0))
    text = F.col(text_col)
    if len(some) <= broadcast_terms:
        keys = [r["_key"] for r in some]
        kinds = sorted({k.split(" ", 1)[0] for k in keys})
        rows = with_keys(texts.select(id_col, text.alias("_text")), "_text", kinds)
        rows = rows.select(id_col, "_text", F.explode(F.filter("_keys", lambda k: k.isin(*keys))).alias("_key"))
        return rows.join(F.broadcast(keyed), "_key").where(appears_in(F.col("_text"), F.col("term"))).select(id_col, "ord", "term")  # the keys counted above
    kinds = sorted(r["k"] for r in keyed.select(F.substring_index("_key", " ", 1).alias("k")).distinct().collect())  # six at most
    seen = with_keys(texts.select(F.col(id_col).alias("_id"), text.alias("_text")), "_text", kinds).select("_id", F.explode("_keys").alias("_key"))
    candidates = seen.join(keyed, "_key").select("_id", "ord", "term").distinct()
    both = texts.select(id_col, text.alias("_text")).join(candidates, F.col(id_col) == F.col("_id"))
    return both.where(appears_in(F.col("_text"), F.col("term"))).select(id_col, "ord", "term")


def compile_glossary(entries: DataFrame, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The entries whose English name or an alias appears in some text, in their order."""
    found = term_hits(texts, terms_of(entries), id_col, text_col).select("ord").distinct()
    return entries.join(found, "ord", "left_semi")


def joined_notes(notes: DataFrame) -> DataFrame:
    """_key, _notes: each key's notes (_key, _low, item, place) joined by blanks in order of place, but for those that what is gathered by then contains, ignoring case.

    Notes are trimmed, not blank, and no two of a key have one lower case (``_low``). A note that is contained has its runs of PIECE characters without a blank, and
    its short words between two blanks, in earlier notes: no such piece reaches over the blank between two notes. So a note that is
    the first with one of its pieces is not contained. Only the others are looked for in what is gathered; those between them are joined at once.
    """
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("place")).cast("long")
    placed = notes.select("_key", "_low", "item", nth.alias("_nth"))
    found = lambda pattern: F.regexp_extract_all("_low", F.lit(pattern), F.lit(1))
    runs, between, words = found(f"(?=([^ ]{{{PIECE}}}))"), found(f"(?<= )([^ ]{{1,{PIECE - 1}}})(?= )"), found(f"(?<![^ ])([^ ]{{1,{PIECE - 1}}})(?![^ ])")
    # Other short words are pieces for later notes alone. A hash that two pieces share makes a note looked for, no more.
    own = F.transform(F.concat(runs, between), lambda x: F.struct(F.xxhash64("_key", x).alias("piece"), (2 * F.col("_nth")).alias("at")))
    lent = F.transform(words, lambda x: F.struct(F.xxhash64("_key", x).alias("piece"), (2 * F.col("_nth") + 1).alias("at")))
    pieces = placed.select("_key", F.explode(F.concat(own, lent)).alias("x")).groupBy("_key", "x.piece").agg(F.min("x.at").alias("_at"))
    first = pieces.where("_at % 2 = 0").select("_key", F.expr("_at div 2").alias("_nth"), F.lit(True).alias("_sure")).distinct()
    marked = placed.join(first, ["_key", "_nth"], "left").withColumn("_sought", F.col("_sure").isNull())
    marked = marked.withColumn("_part", F.count_if("_sought").over(Window.partitionBy("_key").orderBy("_nth")))
    sought = F.max(F.when(F.col("_sought"), F.struct(F.col("item").alias("text"), F.col("_low").alias("low"))))
    rest = F.array_sort(F.collect_list(F.when(~F.col("_sought"), F.struct("_nth", "item", "_low"))))
    text = lambda field: F.when(F.size("_rest") > 0, F.array_join(F.transform("_rest", lambda x: x[field]), " ")).alias("text" if field == "item" else "low")
    parts = marked.groupBy("_key", "_part").agg(sought.alias("sought"), rest.alias("_rest")).select("_key", "_part", "sought", F.struct(text("item"), text("_low")).alias("rest"))
    listed = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_part", "sought", "rest"))).alias("_parts"))

    def grow(acc: Column, x: Column) -> Column:
        new = x["sought"]["low"].isNotNull() & ~F.coalesce(F.contains(acc["low"], x["sought"]["low"]), F.lit(False))
        return F.struct(*(F.concat_ws(" ", acc[c], F.when(new, x["sought"][c]), x["rest"][c]).alias(c) for c in ("text", "low")))

    none = F.lit(None).cast("struct<text: string, low: string>")
    return listed.select("_key", F.aggregate("_parts", none, grow, lambda acc: acc["text"]).alias("_notes"))


def merge_glossaries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` entries folded into ``existing`` ones of the same English name, ignoring case; new ones follow.

    The first entry of a name gives ru and kind; later ones add notes and list
    items, in order. Entries that nothing is merged into stay as they are. Existing
    entries of one name all stay, and the last of them takes what comes in. A name may have
    any number of entries: what differs among them is all that comes together.
    """
    fields = ("english", "ru", "kind", "notes", "do_not_use", "aliases")
    old, new = (rows.select(F.lit(src).alias("_src"), F.lower("english").alias("_key"), "ord", *fields) for src, rows in enumerate((existing, incoming)))
    last = old.groupBy("_key").agg(F.max("ord").alias("_last"))
    target = old.join(last, "_key")
    alone = target.where("ord != _last").drop("_last")
    both = target.where("ord = _last").drop("_last").unionByName(new)
    heads = both.groupBy("_key").agg(F.min(F.struct("_src", "ord", *fields)).alias("_head"), F.count("*").alias("_rows"))

    # What a name's entries add up to is a set of first occurrences: notes and list items, each once, at its least place. They are
    # found by aggregates that combine before the shuffle, so no row holds all entries of a name; only what is left of them is listed.
    note = F.when(~is_blank(F.col("notes")), F.array(F.struct(F.lit("notes").alias("tag"), F.lit(0).alias("pos"), trim_space(F.col("notes")).alias("item"))))
    parts = [F.coalesce(note, F.array().cast("array<struct<tag: string, pos: int, item: string>>"))]
    for f in ("do_not_use", "aliases"):
        parts.append(F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(f).alias("tag"), i.alias("pos"), trim_space(x).alias("item"))))  # noqa: B023  called at once
    items = both.select("_key", "_src", "ord", F.explode(F.concat(*parts)).alias("x")).where("x.item != ''")
    firsts = items.groupBy("_key", "x.tag", F.lower("x.item").alias("_low")).agg(F.min(F.struct("_src", "ord", "x.pos", "x.item")).alias("_first"))
    notes = joined_notes(firsts.where("tag = 'notes'").select("_key", "_low", "_first.item", F.col("_first").alias("place")))
    ordered = lambda tag: F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == tag, F.col("_first")))), lambda x: x["item"]).alias(f"_{tag}")
    listed = firsts.where("tag != 'notes'").groupBy("_key").agg(ordered("do_not_use"), ordered("aliases"))
    of = lambda tag: F.coalesce(f"_{tag}", F.array().cast("array<string>")).alias(f"_{tag}")
    many = F.col("_rows") > 1
    merged = heads.join(listed, "_key", "left").join(notes, "_key", "left").select("_head.*", many.alias("_many"), "_notes", of("do_not_use"), of("aliases"))
    merged = merged.select("_src", "ord", "english", "ru", "kind", *(F.when(F.col("_many"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in ("notes", "do_not_use", "aliases")))
    rows = merged.unionByName(alone.select("_src", "ord", *fields))
    shift = existing.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_n"))
    # New entries keep their own order after all existing ones.
    return rows.crossJoin(F.broadcast(shift)).select(F.when(F.col("_src") == 0, F.col("ord")).otherwise(F.col("ord") + F.col("_n")).cast("int").alias("ord"), *fields)
