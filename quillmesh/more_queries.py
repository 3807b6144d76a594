"""More registered queries: pieces of the pipelines over whole tables, each with its SQL (DuckDB) beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html as h
from .functions import text
from .operators import chunks, glossary, packing, sections
from . import oracles
from .functions import roles, validate
from .oracles import _ENGLISH, _PROTOCOL, SPACE, _units, _wrap
from .plans import answers, completer, pipelines, progress
from .queries import BUDGET, LINE_BREAK, _table, checked_turns
from .sources import glossary_md, ordered_text, state

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _registered(sql: str):
    def add(fn):
        _QUERIES[fn.__name__], _SQL[fn.__name__] = fn, sql
        return fn

    return add


def _number(name: str):
    return F.col(name).cast("string")


# -- glossaries made of tables ----------------------------------------------------

_NATIONS = "SELECT n_regionkey, n_nationkey + 1 AS ord, n_name AS english, 'н' || n_nationkey AS ru, CASE n_nationkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'weapon' ELSE 'name' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'note ' || n_nationkey || '.' END AS notes FROM nation"


def _nations(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    kind = F.when(n % 3 == 0, "title").when(n % 3 == 1, "weapon").otherwise("name")
    rows = _table(spark, sf_dir, "nation")
    return rows.select(
        F.col("n_regionkey").cast("string").alias("doc_id"), (n + 1).cast("int").alias("ord"), F.col("n_name").alias("english"), F.concat(F.lit("н"), _number("n_nationkey")).alias("ru"), kind.alias("kind"),
        F.when(n % 2 == 0, F.concat(F.lit("note "), _number("n_nationkey"), F.lit("."))).alias("notes"), F.array().cast("array<string>").alias("do_not_use"), F.array(F.lower("n_name"), F.concat(F.col("n_name"), F.lit("'s"))).alias("aliases"),
    )


_WRITTEN = f"""n AS ({_NATIONS}), e AS (SELECT n_regionkey, ord, chr(10) || '## ' || english || chr(10) || '- ru: ' || ru || chr(10) || '- type: ' || CASE WHEN kind = 'weapon' THEN 'other' ELSE kind END || chr(10)
 || CASE WHEN notes IS NOT NULL THEN '- notes: ' || notes || chr(10) ELSE '' END || '- aliases: ' || lower(english) || ', ' || english || '''s' || chr(10) AS md FROM n),
w AS (SELECT r_regionkey, '# ' || r_name || chr(10) || chr(10) || 'About ' || r_name || chr(10) || coalesce(string_agg(md, '' ORDER BY ord), '') AS text FROM region LEFT JOIN e ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name)"""


def _glossaries(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("doc_id"), F.col("r_name").alias("title"), F.concat(F.lit("About "), F.col("r_name")).alias("preamble"))
    return glossary_md.write(docs, _nations(spark, sf_dir))


@_registered(f"WITH {_WRITTEN} SELECT r_regionkey::VARCHAR AS doc_id, sha256(text) AS sha FROM w")
def glossary_write_regions(spark, sf_dir):
    """A glossary of each region's nations as Markdown."""
    return _glossaries(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"))


@_registered(f"WITH n AS ({_NATIONS}) SELECT n_regionkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY ord)::INTEGER AS ord, english, ru, CASE WHEN kind = 'weapon' THEN 'other' ELSE kind END AS kind, notes, lower(english) || '|' || english || '''s' AS aliases FROM n")
def glossary_parse_regions(spark, sf_dir):
    """What is written, parsed again."""
    _, entries = glossary_md.parse(_glossaries(spark, sf_dir))
    return entries.select("doc_id", "ord", "english", "ru", "kind", "notes", F.array_join("aliases", "|").alias("aliases"))


@_registered(f"""WITH n AS ({_NATIONS}), i AS (SELECT s_suppkey + 1 AS ord, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE lower(n_name) END AS english, s_name AS ru, 'by ' || s_name || '.' AS notes, s_name AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT 0 AS src, ord, english, ru, notes, [lower(english), english || '''s'] AS aliases FROM n UNION ALL SELECT 1, ord, english, ru, notes, [alias, upper(english)] FROM i),
items AS (SELECT lower(english) AS key, src, ord, unnest(aliases) AS v, unnest(range(2)) AS p FROM u),
firsts AS (SELECT key, first(v ORDER BY src, ord, p) AS v, min((src, ord, p)) AS place FROM items GROUP BY key, lower(v)),
lists AS (SELECT key, string_agg(v, '|' ORDER BY place) AS aliases FROM firsts GROUP BY key),
many AS (SELECT lower(english) AS key, count(*) AS n, string_agg(notes, ' ' ORDER BY src, ord) AS notes, first(src ORDER BY src, ord) AS src, first(ord ORDER BY src, ord) AS ord, first(english ORDER BY src, ord) AS english, first(ru ORDER BY src, ord) AS ru, first(aliases ORDER BY src, ord) AS own FROM u GROUP BY ALL)
SELECT (CASE WHEN src = 0 THEN ord ELSE ord + (SELECT max(ord) FROM n) END)::INTEGER AS ord, english, ru, notes, CASE WHEN many.n > 1 THEN lists.aliases ELSE array_to_string(own, '|') END AS aliases FROM many JOIN lists USING (key)""")
def glossary_merge_suppliers(spark, sf_dir):
    """Suppliers as entries of their nation's name, or their own, merged into the nations."""
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    english = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(F.lower("n_name"))
    new = s.select((F.col("s_suppkey") + 1).cast("int").alias("ord"), english.alias("english"), F.col("s_name").alias("ru"), F.lit("name").alias("kind"), F.concat(F.lit("by "), F.col("s_name"), F.lit(".")).alias("notes"), F.array().cast("array<string>").alias("do_not_use"), F.array(F.col("s_name"), F.upper(english)).alias("aliases"))
    merged = glossary.merge_glossaries(_nations(spark, sf_dir).drop("doc_id"), new)
    return merged.select("ord", "english", "ru", "notes", F.array_join("aliases", "|").alias("aliases"))


@_registered("SELECT c_custkey::VARCHAR AS doc_id, c_name AS english, c_mktsegment AS ru, 'other' AS kind FROM customer WHERE c_custkey % 3 > 0")
def model_output_parse(spark, sf_dir):
    """Answers with chatter around an entry; every third has an entry without a field that it needs, and gives none."""
    c = _table(spark, sf_dir, "customer")
    ru = F.when(F.col("c_custkey") % 3 == 0, "- notes: none").otherwise(F.concat(F.lit("- ru: "), F.col("c_mktsegment")))
    answers = c.select(_number("c_custkey").alias("doc_id"), F.concat(F.lit("Here it is:\r\n\r\n## "), F.col("c_name"), F.lit("\r\n"), ru, F.lit("\n")).alias("text"))
    return glossary_md.parse_model_output(answers).select("doc_id", "english", "ru", "kind")


@_registered("SELECT DISTINCT ON (lower(p_name)) p_name AS term FROM part ORDER BY lower(p_name), p_partkey")
def candidate_list(spark, sf_dir):
    """Names of parts as a list of candidates in Markdown, read again."""
    listed = glossary_md.candidates_markdown(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("term")))
    return glossary_md.read_candidates(listed.select(F.lit("d").alias("doc_id"), "text")).select("term")


@_registered("SELECT 'parts.md' AS name, sha256('# Term candidates' || chr(10) || chr(10) || string_agg('- ' || p_name || chr(10), '' ORDER BY p_partkey)) AS sha, (20 - 1 + sum(strlen(p_name) + 3))::BIGINT AS size FROM part")
def candidate_file(spark, sf_dir):
    """Names of parts as one file of candidates, written by many tasks and stitched: its digest."""
    path = f"{state.RunStore(spark).root}/parts.md"
    glossary_md.write_candidates(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("term")), path)
    return ordered_text.read_digest(spark, path)


# -- sections and chunks ------------------------------------------------------------

@_registered(f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS idx FROM documents WHERE regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g') <> ''")
def section_numbers(spark, sf_dir):
    """Documents of a language as a book's sections, blank ones left out, numbered."""
    d = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.col("text").alias("plain_text"))
    return sections.number_sections(d, "lang", "doc_id").select("lang", "doc_id", "idx")


@_registered("""WITH RECURSIVE x AS (
  SELECT doc_id, unnest(y) AS line, unnest(range(len(y))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS y FROM documents)
), l AS (
  SELECT doc_id // 50 AS book, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, i) - 1 AS pos, length(line) // 4 AS cost FROM x
), r AS (
  SELECT book, pos, cost AS used, 1 AS piece FROM l WHERE pos = 0
  UNION ALL
  SELECT l.book, l.pos, CASE WHEN r.used + l.cost > 200 THEN l.cost ELSE r.used + l.cost END, CASE WHEN r.used + l.cost > 200 THEN r.piece + 1 ELSE r.piece END FROM r JOIN l ON l.book = r.book AND l.pos = r.pos + 1
)
SELECT book AS chapter_no, piece::INTEGER AS piece_no, min(pos) AS first, count(*) AS n_blocks FROM r GROUP BY ALL""")
def long_chapters(spark, sf_dir):
    """Fifty documents' lines as one chapter, packed across rows: where each piece begins, and its blocks."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("i", "line"))
    place = F.row_number().over(Window.partitionBy(F.expr("doc_id div 50")).orderBy("doc_id", "i")) - 1
    blocks = d.select(F.expr("doc_id div 50").alias("chapter_no"), place.cast("long").alias("pos"), text.utf16_length(F.col("line")).alias("n"))
    return packing.pack_rows(blocks, BUDGET, span=64).groupBy("chapter_no", "piece_no").agg(F.min("pos").alias("first"), F.count("*").alias("n_blocks"))


@_registered("SELECT doc_id FROM documents WHERE doc_id BETWEEN 20 AND 150")
def chapter_slice(spark, sf_dir):
    """The documents that a range of chapters names."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chapter_no"))
    return chunks.chapter_range(d, *chunks.parse_chapter_range(" 20 - 150 ", 1_000_000)).select("doc_id")


@_registered("SELECT count(*) AS n, count(*) FILTER (toxic = 0) AS n_done, count(*) FILTER (toxic = 1) AS n_failed, coalesce(bool_or(toxic = 1), false) AS has_failures FROM labels")
def status_counts(spark, sf_dir):
    return chunks.status_counts(_table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "failed").otherwise("done").alias("status")))


@_registered("""WITH g AS (SELECT min(doc_id) AS gap FROM labels WHERE toxic = 1)
SELECT doc_id AS seq, CASE WHEN gap IS NULL OR doc_id < gap THEN 'ready' ELSE 'waiting' END AS state, 'c' || quality AS content FROM labels, g WHERE toxic = 0""")
def ordered_flush(spark, sf_dir):
    """Answers up to the first step that failed, and those that wait behind it."""
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), _number("doc_id").alias("label"), _number("doc_id").alias("chunk_id"), F.when(F.col("toxic") == 1, "failed").otherwise("done").alias("status"), F.concat(F.lit("c"), _number("quality")).alias("html"))
    ready, waiting = pipelines.in_order(rows, rows)
    return ready.withColumn("state", F.lit("ready")).unionByName(waiting.withColumn("state", F.lit("waiting"))).select("seq", "state", "content")


@_registered("SELECT 'chunks/' || regexp_replace(conv_id || '/' || turn, '[^A-Za-z0-9-]', '_', 'g') || x AS path, sha256(CASE x WHEN '.source.html' THEN text WHEN '.translated.html' THEN 'T: ' || text ELSE 'why' END) AS sha FROM conversations, (VALUES ('.source.html'), ('.translated.html'), ('.error.txt')) t(x) WHERE x <> '.translated.html' OR role <> 'user'")
def side_files(spark, sf_dir):
    """The files beside a run: each turn's source, its translation where there is one, and why there is none."""
    t = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("source_html"), F.when(F.col("role") != "user", F.concat(F.lit("T: "), F.col("text"))).alias("html"), F.lit("why").alias("reason"))
    return state.side_files(t).select("path", F.sha2("value", 256).alias("sha"))


@_registered("SELECT page_id, ends_with(lower(url), '.epub') AS epub, ends_with(lower(url), '.pdf') AS pdf, left(regexp_replace(regexp_replace(url, '^[^#]*$', url || '.EPUB'), '#.*', '.Pdf'), 8) AS head FROM pages")
def path_guards(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    changed = F.when(F.contains("url", F.lit("#")), F.regexp_replace("url", "#.*", ".Pdf")).otherwise(F.concat(F.col("url"), F.lit(".EPUB")))
    return p.select("page_id", text.is_epub(F.col("url")).alias("epub"), text.is_pdf(F.col("url")).alias("pdf"), F.left(changed, F.lit(8)).alias("head"))


# -- text and markup ------------------------------------------------------------------

@_registered(f"""SELECT doc_id, upper(sha256(text)) AS session, sha256(regexp_replace(regexp_replace(text, '^([^\\S\\n]*\\n)+', ''), '(\\n[^\\S\\n]*)+$', '')) AS preamble,
 sha256(CASE WHEN regexp_replace(coalesce(lang, ''), '{SPACE}', '', 'g') = '' THEN text ELSE lang || chr(10) || chr(10) || text END) AS prefix,
 sha256(left(trim(regexp_replace(text, '[\\s\\x00-\\x1F\\x7F-\\x{{9F}}\\x{{A0}}]+', ' ', 'g')), 500)) AS error,
 sha256(substr(text, 1, greatest(1, ceil(length(text) / 3))::BIGINT) || '|' || substr(text, greatest(1, ceil(length(text) / 3))::BIGINT + 1, greatest(1, ceil(length(text) / 3))::BIGINT)) AS first_two, {_units('text')}::BIGINT AS units FROM documents WHERE length(text) >= 3""")
def text_tools(spark, sf_dir):
    """Small functions of the pipelines over every text: session key, trimmed preamble, prefix, error text, equal parts, UTF-16 length."""
    t = F.col("text")
    parts = text.split_equally(t, F.lit(3))
    return _table(spark, sf_dir, "documents").where(F.length("text") >= 3).select(
        "doc_id", text.session_id(t).alias("session"), F.sha2(text.trim_preamble(t), 256).alias("preamble"), F.sha2(text.stable_prefix(F.coalesce("lang", F.lit("")), t), 256).alias("prefix"),
        F.sha2(text.compact_error(t), 256).alias("error"), F.sha2(F.concat_ws("|", parts[0], parts[1]), 256).alias("first_two"), text.utf16_length(t).alias("units"),
    )


@_registered("SELECT page_id, sha256(regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>.*)?$', 1)) AS body, sha256('<?xml version=\"1.0\" encoding=\"utf-8\"?>' || chr(10) || regexp_replace(html, '(?is)(<body[^>]*>).*?(</body>.*)?$', '\\1<p>new</p>\\2')) AS replaced FROM pages")
def page_bodies(spark, sf_dir):
    """What is inside each page's body, and the page with another body."""
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(h.body_inner(html), 256).alias("body"), F.sha2(h.replace_body(html, F.lit("<p>new</p>")), 256).alias("replaced"))


# -- the model call ---------------------------------------------------------------------

@_registered("SELECT conv_id, turn, role, 'm' AS model, 'p' || conv_id AS system, sha256(text) AS sha, turn::BIGINT AS max_tokens, CASE WHEN turn % 2 = 0 THEN 'note' END AS note FROM conversations")
def request_bodies(spark, sf_dir):
    """Each turn as a chat request, taken apart again."""
    t = _table(spark, sf_dir, "conversations")
    body = completer.request_json(F.lit("m"), F.concat(F.lit("p"), _number("conv_id")), F.col("text"), F.col("turn"), F.when(F.col("turn") % 2 == 0, "note").otherwise(" "))
    at = lambda path: F.get_json_object("body", path)
    noted = F.col("turn") % 2 == 0
    sent = t.select("*", body.alias("body"))
    return sent.select("conv_id", "turn", "role", at("$.model").alias("model"), at("$.messages[0].content").alias("system"), F.sha2(F.when(noted, at("$.messages[2].content")).otherwise(at("$.messages[1].content")), 256).alias("sha"), at("$.max_tokens").cast("long").alias("max_tokens"), F.when(noted, at("$.messages[1].content")).alias("note"))


@_registered(f"""WITH x AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS k, conv_id, turn, role, text, {_wrap('text')} AS html FROM conversations),
l AS (SELECT k, unnest(y) AS line, unnest(range(len(y))) AS pos FROM (SELECT k, string_split(text, chr(10)) AS y FROM x)), {_PROTOCOL}, {_ENGLISH}
SELECT conv_id || '-' || turn || '-' || role AS chunk_id, CASE WHEN word IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN word IS NULL THEN sha256(html) END AS sha, word, CASE WHEN word IS NULL THEN 1 ELSE 2 END::INTEGER AS attempts FROM x LEFT JOIN en USING (k)""")
def complete_checked(spark, sf_dir):
    """Each turn given back by the offline completer, checked by all rules, and asked again once where it fails."""
    t = _table(spark, sf_dir, "conversations")
    html = F.concat(F.lit("<p>"), F.replace("text", F.lit(LINE_BREAK), F.lit("</p><p>")), F.lit("</p>"))
    rows = t.select(F.concat_ws("-", "conv_id", "turn", "role").alias("chunk_id"), html.alias("source_html"))
    asked = completer.complete_chunks(rows, completer.echo, "prefix", retries=2, concurrency=None, pause=_no_pause)
    return asked.select("chunk_id", "status", F.sha2("html", 256).alias("sha"), F.regexp_extract("reason", "^[^:]*: ([A-Za-z]+)", 1).alias("word"), "attempts")


@_registered(f"""WITH x AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS k, conv_id, turn, role, text, {_wrap('text')} AS html FROM conversations),
l AS (SELECT k, unnest(y) AS line, unnest(range(len(y))) AS pos FROM (SELECT k, string_split(text, chr(10)) AS y FROM x)), {_PROTOCOL}, {_ENGLISH}
SELECT conv_id || '-' || turn || '-' || role AS chunk_id, conv_id * 1000 + turn AS seq, CASE WHEN word IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN word IS NULL THEN sha256(html) END AS sha, CASE WHEN word IS NULL THEN 1 ELSE 2 END::INTEGER AS attempts FROM x LEFT JOIN en USING (k)""")
def logged_answers(spark, sf_dir):
    """Each turn asked by the pool of a run, its outcome logged by the task as soon as it is there; the log, packed and read."""
    t = _table(spark, sf_dir, "conversations")
    html = F.concat(F.lit("<p>"), F.replace("text", F.lit(LINE_BREAK), F.lit("</p><p>")), F.lit("</p>"))
    rows = t.select(F.concat_ws("-", "conv_id", "turn", "role").alias("chunk_id"), html.alias("source_html"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    run = state.RunStore(spark)
    log = answers.AnswerLog(run.root, "query")
    log.folder.make("answers")
    ask = lambda some: completer.complete_chunks(some, completer.echo, "prefix", retries=2, concurrency=8, pause=_no_pause, log=log, order="seq")
    completer.ask_all(rows, ask, log, "seq")
    answers.pack(spark, run.root)
    return answers.last_of_each(answers.logged(spark, run.root)).select("chunk_id", "seq", "status", F.sha2("html", 256).alias("sha"), "attempts")


def _no_pause(seconds: float) -> None:
    """The offline completer is never busy."""


_CHECKED = oracles.oracle_sql()["validate_translation"]
_CONTEXT = """, place AS (SELECT k, pos, i, sum(length(gap) + length(w)) OVER (PARTITION BY k, pos ORDER BY i) - length(w) AS "at" FROM ws),
first AS (SELECT k, arg_min(pos, (pos, run)) FILTER (n >= 3 OR f >= 2) AS pos, arg_min(run, (pos, run)) FILTER (n >= 3 OR f >= 2) AS run FROM r GROUP BY k),
begins AS (SELECT c.k, c.pos, min(c.i) AS i FROM c JOIN first USING (k, pos, run) WHERE plain GROUP BY c.k, c.pos),
said AS (SELECT b.k, replace(regexp_replace(substr(p.line, greatest(o."at" - 30, 0)::BIGINT + 1, 120), '\\s+', ' ', 'g'), '"', chr(39)) AS context FROM begins b JOIN place o USING (k, pos, i) JOIN pr p ON p.k = b.k AND p.pos = b.pos),
checked AS ("""


@_registered(_CHECKED.replace("\nSELECT conv_id, turn, CASE", _CONTEXT + "SELECT k, conv_id, turn, warned, CASE", 1) + """)
SELECT conv_id, turn, reason IS NULL AS is_valid, CASE WHEN reason LIKE 'English%' THEN reason || '; context: "' || context || '"' ELSE reason END AS reason, CASE WHEN reason IS NULL THEN least(3, coalesce(warned, 0)) ELSE 0 END::INTEGER AS n_warnings FROM checked LEFT JOIN said USING (k)""")
def validation_results(spark, sf_dir):
    """Each assistant turn against the turn before it, by all checks: whether it holds, the whole reason with its context, and the warnings."""
    rows = checked_turns(spark, sf_dir)
    v = validate.validate(F.col("source"), F.col("content"), F.col("finish"))
    return rows.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.is_valid", "v.reason", F.size("v.warnings").alias("n_warnings"))


@_registered("""WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'en' END AS side, 'chapter ' || (1 + doc_id * 7 % 400 // 10) AS role FROM documents),
n AS (SELECT role, count(*) FILTER (side = 'en') AS o, count(*) FILTER (side = 'fr') AS t FROM d GROUP BY role)
SELECT role, o AS n_o, t AS n_t, o = 1 AND t = 1 AS paired FROM n""")
def role_groups(spark, sf_dir):
    """Documents as sections of two editions whose roles come from headings made of their ids: how many of each side have a role, and which roles pair."""
    d = _table(spark, sf_dir, "documents")
    heading = F.concat(F.lit("Chapter "), (1 + F.expr("doc_id * 7 % 400 div 10")).cast("string"))
    rows = d.select((F.col("doc_id") % 3 == 0).alias("fr"), F.col("doc_id").alias("idx"), _number("doc_id").alias("file_path"), roles.classify_role(heading, F.lit("")).alias("role"))
    o, t = rows.where("not fr"), rows.where("fr")
    paired = sections.role_pairs(o, t).select("role", F.lit(True).alias("paired"))
    return sections.role_counts(o, t).join(paired, "role", "left").select("role", "n_o", "n_t", F.coalesce("paired", F.lit(False)).alias("paired"))


@_registered("""WITH p AS (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS z FROM lineitem WHERE l_orderkey % 40 = l_linenumber % 40 GROUP BY l_orderkey)
SELECT l_orderkey AS line_no FROM p x WHERE EXISTS (SELECT 1 FROM p y WHERE y.l_orderkey <> x.l_orderkey AND y.a <= x.z AND y.z >= x.a)""")
def range_overlaps(spark, sf_dir):
    """Orders' ranges of parts that share a part with another order's range, without expanding them."""
    rows = _table(spark, sf_dir, "lineitem").where("l_orderkey % 40 = l_linenumber % 40").groupBy(F.col("l_orderkey").alias("line_no")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("z"))
    return sections.overlapping(rows, "a", "z")


# -- progress ------------------------------------------------------------------------------

_SECONDS = "(o_orderkey * 37 % 9000)"


@_registered(f"""SELECT o_orderkey, repeat('█', (o_orderkey % 41) * 20 // 40) || repeat('░', 20 - (o_orderkey % 41) * 20 // 40) AS bar,
 CASE WHEN {_SECONDS} >= 3600 THEN printf('%d:%02d:%02d', {_SECONDS} // 3600, {_SECONDS} // 60 % 60, {_SECONDS} % 60) ELSE printf('%d:%02d', {_SECONDS} // 60, {_SECONDS} % 60) END AS duration,
 CASE WHEN o_custkey > 700 AND length(o_orderpriority) > 6 THEN left(o_orderpriority, 5) || '…' ELSE o_orderpriority END AS label,
 (100 * 2 ** least(o_orderkey % 9, 6))::INTEGER AS wait, o_orderkey || ':' || o_orderstatus || CASE WHEN o_orderkey % 3 > 0 THEN '#' || (o_orderkey % 3) ELSE '' END AS step,
 CASE WHEN o_orderkey % 2 = 0 THEN 'the gateway refused the credentials (401)' WHEN o_orderkey % 200 IN (1, 3) THEN 'the gateway refused the credentials (' || (400 + o_orderkey % 200) || ')' ELSE 'the gateway answered ' || (400 + o_orderkey % 200) || ': ' || o_orderpriority END AS error, o_orderkey % 200 + 400 IN (429) OR o_orderkey % 200 >= 100 AS again FROM orders""")
def progress_lines(spark, sf_dir):
    """Bars, durations, labels, waits, step names and error texts made of orders."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    label = F.when(F.col("o_custkey") > 700, progress.fit_label(F.col("o_orderpriority"), 73)).otherwise(progress.fit_label(F.col("o_orderpriority"), 60))
    step = text.step_label(k, F.col("o_orderstatus"), k % 3, F.when(k % 3 > 0, 2).otherwise(1))
    status = F.when(k % 2 == 0, 401).otherwise(400 + k % 200)
    return o.select(
        "o_orderkey", progress.bar_text(k % 41, F.lit(40)).alias("bar"), progress.duration_text(k * 37 % 9000).alias("duration"), label.alias("label"), text.backoff_ms(k % 9 + 1).cast("int").alias("wait"),
        step.alias("step"), completer.gateway_error(status, F.col("o_orderpriority")).alias("error"), completer.is_retryable(400 + k % 200).alias("again"),
    )


_STEPS = "s AS (SELECT 'o' || o_orderkey AS label, o_orderkey AS ord, epoch(o_orderdate)::BIGINT AS started, CASE WHEN o_orderkey % 500 > 0 THEN epoch(o_orderdate)::BIGINT + o_orderkey % 100 + 1 END AS ended, o_orderstatus = 'F' AS failed, o_custkey AS tokens FROM orders)"


def _steps(spark, sf_dir) -> DataFrame:
    o, start = _table(spark, sf_dir, "orders"), F.unix_timestamp("o_orderdate")
    ended = F.when(F.col("o_orderkey") % 500 > 0, start + F.col("o_orderkey") % 100 + 1)
    return o.select(F.concat(F.lit("o"), _number("o_orderkey")).alias("label"), F.col("o_orderkey").alias("ord"), start.alias("started"), ended.alias("ended"), (F.col("o_orderstatus") == "F").alias("failed"), F.col("o_custkey").alias("prompt_tokens"), F.lit(None).cast("long").alias("cached_tokens"), F.lit(1).cast("long").alias("completion_tokens"))


@_registered(f"WITH {_STEPS} SELECT count(ended) AS done, count(*) FILTER (failed) AS failures, (max(ended) - min(started))::DOUBLE AS wall_seconds, avg(ended - started) AS average_seconds, sum(tokens)::BIGINT AS prompt_tokens, NULL::BIGINT AS cached_tokens, count(*) AS completion_tokens, avg(ended - started) * ceil((30000 - count(ended)) / 8) AS eta_seconds FROM s")
def progress_totals(spark, sf_dir):
    """Orders as a run's steps: counts, wall and average time, tokens, time to go."""
    steps = _steps(spark, sf_dir)
    one = progress.totals(steps).drop("last_is_slower")
    return one.crossJoin(progress.eta(steps, 30_000, 8))  # one row each


@_registered(f"WITH {_STEPS} SELECT coalesce(string_agg(label, ', ' ORDER BY ord), '') AS labels FROM s WHERE ended IS NULL")
def in_flight(spark, sf_dir):
    return progress.in_flight(_steps(spark, sf_dir))


@_registered(f"WITH {_STEPS} SELECT label, ord = (SELECT min(ord) FROM s) AS first FROM s")
def warm_up(spark, sf_dir):
    """The step that is run alone, and the others."""
    first, rest = progress.warm_up(_steps(spark, sf_dir), "ord", "label")
    return first.select("label", F.lit(True).alias("first")).unionByName(rest.select("label", F.lit(False).alias("first")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
