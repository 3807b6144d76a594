"""Registered queries of the document and glossary operators, and their SQL oracles.

Parquet tables stand in for books: ``documents`` in order of doc_id are chapters
and each language is an edition, lines of a text are blocks, ``pages.html`` is
markup, turns of ``conversations`` are originals and translations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html as h
from .functions import roles, text, validate
from .operators import candidates, chunks, glossary, sections
from .operators.numbering import number_within
from .plans import completer
from .sources import glossary_md, pairmap
from .streaming import ordered

#: ord, english, ru, kind, notes, do_not_use, aliases.
GLOSSARY = [
    (1, "Reor", "Реор", "name", "first note", [], ["Anthe", "Thand"]),
    (2, "the", "тот", "other", None, [], []),
    (3, "zzyzx", "зызкс", "geography", None, [], ["qqq qq"]),
    (4, "of the", "из того", "formula", None, ["изо"], []),
    (5, "schen", "шен", "title", None, [], ["Einsch"]),
]
INCOMING = [
    (1, "reor", "Реорр", "other", "second note", ["реорр"], ["thand", "Reors"]),
    (2, "Blent", "Блент", "artifact", None, [], ["blents"]),
    (3, "SCHEN", "шенн", "name", "a note", [], ["einsch", " Schens "]),
    (4, "blent", "блэнт", "name", "late", [], ["Blentish"]),
]
BUDGET, LINE_BREAK = 200, "\n"
SECTIONS = [
    ("o", 1, "a1.xhtml", "Chapter One", "Text"), ("o", 2, "a2.xhtml", "Dramatis Personae", "List"), ("o", 3, "a3.xhtml", "", "Chapter Twenty-One begins"),
    ("o", 4, "a4.xhtml", "Random title", "Nothing"), ("o", 5, "a5.xhtml", "Epilogue", "End"), ("o", 6, "a6.xhtml", "Epilogue", "End again"),
    ("o", 7, "a7.xhtml", "CHAPTER 400", "x"), ("o", 8, "a8.xhtml", "chapter 41", "y"),
    ("t", 1, "b1.xhtml", "Глава первая", "Текст"), ("t", 2, "b2.xhtml", "Действующие лица", "Список"), ("t", 3, "b3.xhtml", "ЭПИЛОГ", "Конец"),
    ("t", 4, "b4.xhtml", "Глава двадцать первая", "z"), ("t", 5, "b5.xhtml", "Об авторе", "w"),
]
PAIR_MAP = "# pairs\nen/1 = fr/2 # a point\nen/3 .. en/5 = fr/4 .. fr/6\n\n EN/7=\\fr\\7/ \n"
MARKDOWN = "# Universe\n\nIntro line\n\n## Librarian\n- ru: Библиарий\n- type: Title\n- notes:  keeps books \n- do-not-use: библиотекарь\n- aliases: Librarians, , Librarian's\n- unknown: x\n\n##Bolter\r\n- ru: болтер\r\n- TYPE: weapon\n- ru: болтер2\n"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _glossary(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(GLOSSARY if rows is None else rows, glossary_md.ENTRY)


def _edition(docs: DataFrame, lang: str, **columns) -> DataFrame:
    """A language's documents as numbered sections with paths ``lang/n``; ``columns`` are made of the text before that is left behind."""
    rows = docs.where(F.col("lang") == lang).select("lang", "doc_id", *(c.alias(n) for n, c in columns.items()))
    rows = number_within(rows, "lang", "doc_id", "idx")
    return rows.select("idx", F.concat_ws("/", "lang", F.col("idx").cast("string")).alias("file_path"), *columns)


def glossary_compile(spark, sf_dir):
    return glossary.compile_glossary(_glossary(spark), _table(spark, sf_dir, "documents"), "doc_id").select("ord", "english", "ru")


def glossary_compile_benchmark(spark, sf_dir):
    """Documents that quote a benchmark item whole."""
    terms = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("term"))
    hits = glossary.term_hits(_table(spark, sf_dir, "documents"), terms, "doc_id")
    return hits.groupBy("ord").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def term_hits_per_source(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    hits = glossary.term_hits(docs, glossary.terms_of(_glossary(spark)), "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    return hits.groupBy("source", "term").agg(F.count("*").alias("n_docs"))


def candidate_phrases(spark, sf_dir):
    found = candidates.phrases(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("phrase").agg(F.count("*").alias("n"))


def candidate_terms(spark, sf_dir):
    return candidates.candidate_terms(_table(spark, sf_dir, "documents"), glossary.terms_of(_glossary(spark)), "doc_id", "text").withColumnRenamed("first_chunk", "first_doc")


def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(text.token_estimate(F.col("text"))).alias("tokens"), F.max(text.token_estimate(F.col("text"))).alias("most"))


def source_budget(spark, sf_dir):
    rows = [(1_000_000, 128_000, 5_000, 90_000, 0.0, 0), (1_000_000, 128_000, 5_000, 90_000, 2.0, 0), (1_000_000, 128_000, 5_000, 90_000, 2.0, 8192), (100_000, 30_000, 5_000, 90_000, 0.0, 0), (100_000, 30_000, 5_000, None, 0.0, 0)]
    p = spark.createDataFrame(rows, "context int, reserved int, prefix int, max_input int, multiplier double, reserve int")
    return p.select("context", "reserved", "multiplier", "reserve", text.source_budget(*(F.col(c) for c in p.columns)).alias("budget"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("int").alias("chapter_no"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("body_inner_html"), F.split("text", LINE_BREAK).alias("block_fragments"))


def _plan(spark, sf_dir, joint):
    """Chunks of lines; a line beyond the budget is a chunk by itself here."""
    return chunks.plan_chunks(_lines(_table(spark, sf_dir, "documents")), BUDGET, joint, strict=False, separator=LINE_BREAK, fits_whole=False)


def chunk_plan(spark, sf_dir):
    return _plan(spark, sf_dir, False).select("chunk_id", "chapter_no", "piece_no", F.length("source_html").alias("n_chars").cast("long"), F.sha2("source_html", 256).alias("sha"))


def chunk_plan_joint(spark, sf_dir):
    return _plan(spark, sf_dir, True).select("chunk_id", "chapter_no", "piece_no", F.length("source_html").alias("n_chars").cast("long"), F.sha2("source_html", 256).alias("sha"))


def chunk_reassembly(spark, sf_dir):
    """Turns of a conversation put together, those without an answer by a stand-in."""
    turns = _table(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("chapter_no"), F.col("turn").alias("piece_no"), F.col("conv_id").cast("string").alias("file_path"), F.lit("[none]").alias("source_html"), F.when(F.col("role") != "system", F.col("text")).alias("html"))
    return chunks.assemble(rows).select("chapter_no", F.sha2("body", 256).alias("sha"))


def spine_pairs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    side = lambda lang: _edition(docs, lang, preview=text.preview(F.col("text")), role=F.lit("other"), n_chars=F.length("text"))
    return sections.spine_pairs(side("en"), side("fr")).select("idx", "o_file_path", "o_preview", "t_file_path", "t_preview", "ratio", "is_tail")


def index_pairs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return sections.index_pairs(_edition(docs, "en"), _edition(docs, "de"))


def unpaired_tail(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return sections.index_tail(_edition(docs, "en"), _edition(docs, "de"))


def pair_map_expand(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    mapped = pairmap.parse(spark.createDataFrame([("m", PAIR_MAP)], "doc_id string, text string"))
    return sections.expand_pair_map(mapped, _edition(docs, "en"), _edition(docs, "fr"), max_pairs=4).select("ord", "o_idx", "t_idx", "o_file_path", "t_file_path")


def _sections(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SECTIONS, "side string, idx int, file_path string, heading string, plain_text string")
    return rows.withColumn("role", roles.classify_role(F.col("heading"), F.col("plain_text")))


def role_classify(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lit("d").alias("side"), F.col("doc_id").cast("int").alias("idx"), roles.classify_role(F.lit(None).cast("string"), F.col("text")).alias("role"))
    return _sections(spark).select("side", "idx", "role").unionByName(docs)


def role_pairs(spark, sf_dir):
    s = _sections(spark)
    return sections.role_pairs(s.where("side = 'o'"), s.where("side = 't'"))


def role_unpaired(spark, sf_dir):
    s = _sections(spark)
    return sections.role_unpaired(s.where("side = 'o'"), s.where("side = 't'")).select("side", "role", "file_path", "reason")


def glossary_merge(spark, sf_dir):
    m = glossary.merge_glossaries(_glossary(spark), _glossary(spark, INCOMING))
    return m.select("ord", "english", "ru", "kind", "notes", F.array_join("do_not_use", "|").alias("do_not_use"), F.array_join("aliases", "|").alias("aliases"))


def glossary_parse(spark, sf_dir):
    _, entries = glossary_md.parse(spark.createDataFrame([("m", MARKDOWN)], "doc_id string, text string"))
    return entries.select("ord", "english", "ru", "kind", "notes", F.array_join("do_not_use", "|").alias("do_not_use"), F.array_join("aliases", "|").alias("aliases"))


def glossary_write(spark, sf_dir):
    docs = spark.createDataFrame([("g", "Universe", "Intro")], "doc_id string, title string, preamble string")
    made = glossary_md.write(docs, _glossary(spark).withColumn("doc_id", F.lit("g")))
    return made.select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


def _chunk_states(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("source_html"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("toxic") == 1, "failed").otherwise("done").alias("status"), F.when(F.col("quality") == 1, "x").otherwise("").alias("html"))
    return docs, labels


def resume_remaining(spark, sf_dir):
    return chunks.remaining(*_chunk_states(spark, sf_dir)).select("chunk_id")


def resume_status(spark, sf_dir):
    return chunks.resume(*_chunk_states(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.count("html").alias("n_html"))


def html_tag_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(h.strip_tags(F.col("html")), 256).alias("sha"))


def block_count(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", h.count_blocks(F.col("html")).cast("long").alias("n_blocks"))


def distinct_tags(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(h.tag_names(F.col("html"))), ",").alias("tags"))


def html_plain_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(h.plain_text(F.col("html")), 256).alias("sha"))


def page_heading(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", h.first_heading(F.col("html")).alias("heading"))


def collapse_ws_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.sha256_hex(text.collapse_space(F.col("text"))).alias("sha"))


def checked_turns(spark, sf_dir):
    """conv_id, turn, source, content, finish: each assistant turn as an answer to the turn before it; every fifth conversation broke off."""
    turns = _table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    wrap = lambda c: F.concat(F.lit("<p>"), F.replace(c, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    rows = turns.select("conv_id", "turn", "role", wrap(before).alias("source"), F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(wrap(F.col("text"))).alias("content"), F.when(F.col("conv_id") % 5 == 0, "LENGTH").otherwise("stop").alias("finish"))
    return rows.where("role = 'assistant' and source is not null")


def validate_translation(spark, sf_dir):
    """All checks, as the translation loop makes them, of each assistant turn against the turn before it."""
    rows = checked_turns(spark, sf_dir)
    reason = validate.checked("source", "content", "finish")["reason"]
    return rows.select("conv_id", "turn", F.regexp_replace(reason, "(?s); context: .*", "").alias("reason"))


def _doc_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "line"))


def protocol_lines(spark, sf_dir):
    rows = _doc_lines(_table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count_if(validate.is_protocol_like(F.col("line"))).alias("n_protocol"), F.count("*").alias("n_lines"))


def english_runs(spark, sf_dir):
    """What the check for untranslated prose says of documents outside English: the first failing word, or the number of warnings (three at most)."""
    found = _table(spark, sf_dir, "documents").where("lang != 'en'").select("doc_id", validate.english("text").alias("e"))
    return found.select("doc_id", F.regexp_extract("e.reason", "^[^:]*: ([A-Za-z]+)", 1).alias("word"), F.size("e.warnings").cast("long").alias("n_warn"))


def usage_totals(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("source_html"))
    done = completer.complete_chunks(turns, completer.echo, "prefix", check=None, concurrency=None)
    return completer.usage_totals(done)


def response_parse(spark, sf_dir):
    """Responses made of conversation turns, taken apart again."""
    turns = _table(spark, sf_dir, "conversations")
    usage = F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), usage.alias("usage")))
    r = completer.parse_response(body)
    return turns.select("conv_id", "turn", "role", F.sha2(r["content"], 256).alias("sha"), r["finish_reason"].alias("finish_reason"), r["prompt_tokens"].alias("prompt_tokens"), r["cached_tokens"].alias("cached_tokens"))


def sse_fold(spark, sf_dir):
    """Each conversation as an event stream of its turns, folded."""
    turns = _table(spark, sf_dir, "conversations")
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    ends = F.concat(F.lit('data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}],"usage":{"prompt_tokens":'), F.count("*").cast("string"), F.lit(',"completion_tokens":1}}\n\ndata: [DONE]\n\n'))
    streams = turns.groupBy(F.col("conv_id").alias("stream_id")).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", event.alias("e")))), lambda x: x["e"]), ""), ends).alias("text"))
    folded = streams.select("stream_id", ordered.fold_sse("text").alias("f"))
    return folded.select("stream_id", F.sha2("f.content", 256).alias("sha"), F.col("f.finish_reason").alias("finish_reason"), F.col("f.prompt_tokens").alias("prompt_tokens"), F.col("f.error").alias("error"))


def plain_text_join(spark, sf_dir):
    """Each hundred documents as a book's chapters, joined."""
    d = _table(spark, sf_dir, "documents").select(F.expr("doc_id div 100").alias("book_id"), F.col("doc_id").alias("chapter_no"), F.col("text").alias("plain_text"))
    return chunks.join_plain_text(d).select("book_id", F.sha2("text", 256).alias("sha"))


def safe_ids(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.safe_file_id(F.col("url")).alias("file_id"), text.entry_path(F.col("url")).alias("entry"), text.pair_path_key(F.col("url")).alias("pair_key"))


def block_fragments(spark, sf_dir):
    """Blocks of pages by the tree; no SQL parses markup."""
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(h.block_fragments(F.col("html"))).alias("pos", "fragment")).select("page_id", "pos", F.sha2("fragment", 256).alias("sha"))


def split_pairs(spark, sf_dir):
    """Each document beside the one of half its id, as a pair to be cut so that its prompts fit a budget."""
    docs = _table(spark, sf_dir, "documents").where("doc_id >= 0 and text is not null")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    o = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("int").alias("o_idx"), F.lit(9).alias("n_o"), name("o", F.col("doc_id")).alias("o_path"), F.col("text").alias("o_text"), F.expr("doc_id div 2").alias("half"))
    t = docs.select(F.col("doc_id").alias("half"), F.col("doc_id").cast("int").alias("t_idx"), F.lit(7).alias("n_t"), name("t", F.col("doc_id")).alias("t_path"), F.col("text").alias("t_text"))
    cut = chunks.split_pairs(o.join(t, "half").drop("half"), 600)
    return cut.groupBy("ord").agg(F.max("parts").cast("long").alias("parts"), F.max(F.length("prompt")).cast("long").alias("longest"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "prompt"))), lambda x: x["prompt"]), "\n"), 256).alias("sha"))


_ALL = [
    glossary_compile, glossary_compile_benchmark, term_hits_per_source, candidate_phrases, candidate_terms, token_estimate, source_budget,
    chunk_plan, chunk_plan_joint, chunk_reassembly, spine_pairs, index_pairs, unpaired_tail, pair_map_expand, role_classify, role_pairs,
    role_unpaired, glossary_merge, glossary_parse, glossary_write, resume_remaining, resume_status, html_tag_strip, block_count,
    distinct_tags, html_plain_text, page_heading, collapse_ws_hash, validate_translation, protocol_lines, english_runs, usage_totals,
    response_parse, sse_fold, plain_text_join, safe_ids, block_fragments, split_pairs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
