"""The SQL (DuckDB) that each registered query must agree with."""

from __future__ import annotations

from .functions.roles import ROLE_SIGNS, number_words
from .functions.text import STOP_WORDS
from .functions.validate import FUNCTION_WORDS
from .queries import BUDGET, GLOSSARY, INCOMING, SECTIONS

SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLOCK = r"(?i)<(p|h1|h2|h3|h4|h5|h6|blockquote|li)\b"


def _quote(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(_quote, x)) + "]::VARCHAR[]"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows)


def _in(words) -> str:
    return ", ".join(_quote(w) for w in words)


_GLOSSARY = f"g(ord, english, ru, kind, notes, do_not_use, aliases) AS (VALUES {_values(GLOSSARY)})"
_TERMS = "terms AS (SELECT ord, unnest(list_prepend(english, aliases)) AS term FROM g)"
_APPEARS = "regexp_matches(d.text, '(?i)(^|[^A-Za-z])' || regexp_escape(t.term) || '($|[^A-Za-z])')"
_PHRASES = r"""p AS (
  SELECT doc_id, unnest(x) AS raw, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?:^|[^A-Za-z])([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]+)*)', 1) AS x FROM documents)
), ph AS (SELECT doc_id, pos, regexp_replace(raw, '[ \t]+', ' ', 'g') AS phrase FROM p)"""
_EDITIONS = "e AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS idx FROM documents), s AS (SELECT *, lang || '/' || idx AS path FROM e)"


def _chunks(joint: bool) -> str:
    cost = _units("line") if joint else f"{_units('line')} // 4"
    limit = BUDGET * 4 + 3 if joint else BUDGET
    return f"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
), r AS (
  SELECT doc_id, i, line, {cost} AS used, 1 AS piece FROM l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.line, CASE WHEN r.used + {cost.replace('line', 'l.line')} > {limit} THEN {cost.replace('line', 'l.line')} ELSE r.used + {cost.replace('line', 'l.line')} END,
         CASE WHEN r.used + {cost.replace('line', 'l.line')} > {limit} THEN r.piece + 1 ELSE r.piece END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1
), c AS (SELECT doc_id, piece, string_agg(line, chr(10) ORDER BY i) AS html FROM r GROUP BY ALL)
SELECT printf('%04d-%04d', doc_id, piece) AS chunk_id, doc_id::INTEGER AS chapter_no, piece AS piece_no, length(html)::BIGINT AS n_chars, sha256(html) AS sha FROM c"""


def _role(heading: str, text: str) -> str:
    hay = f"CASE WHEN coalesce({heading}, '') = '' THEN left(coalesce({text}, ''), 400) ELSE {heading} || chr(10) || left(coalesce({text}, ''), 400) END"
    words = number_words()
    longest = sorted(words, key=lambda w: (-len(w), w))
    known = "CASE lower(w) " + " ".join(f"WHEN {_quote(w)} THEN {n}" for w, n in words.items()) + " END"
    pattern = "(?i)^(" + "|".join(longest) + r")(?:$|[^\pL])"
    marker = r"(?i)(?:chapter|глава)[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+([^\n]{1,40})"
    pick = f"list_filter(list_transform(regexp_extract_all(h, '{marker}', 1), lambda x: [regexp_extract(replace(trim(x), '-', ' '), '^[0-9]{{1,2}}'), regexp_extract(replace(trim(x), '-', ' '), '{pattern}', 1)]), lambda y: (y[1] <> '' AND try_cast(y[1] AS INTEGER) BETWEEN 1 AND 40) OR y[2] <> '')[1]"
    signs = " ".join("WHEN " + " OR ".join(f"contains(lower(h), {_quote(s)})" for s in some) + f" THEN '{name}'" for name, some in ROLE_SIGNS)
    number = f"CASE WHEN m[1] <> '' AND try_cast(m[1] AS INTEGER) BETWEEN 1 AND 40 THEN try_cast(m[1] AS INTEGER) ELSE {known.replace('lower(w)', 'lower(m[2])')} END"
    return f"""h0 AS (SELECT *, {hay} AS h FROM src), h1 AS (SELECT *, {pick} AS m FROM h0),
roles AS (SELECT *, CASE {signs} WHEN m IS NOT NULL THEN 'chapter ' || ({number}) ELSE 'other' END AS role FROM h1)"""


_SECTIONS = f"src(side, idx, file_path, heading, text) AS (VALUES {_values(SECTIONS)})"
_STATES = """o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN quality = 1 THEN 'x' ELSE '' END AS html FROM labels)"""
_LINES = "l AS (SELECT doc_id, lang, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS x FROM documents))"
_PROTOCOL = f"""q AS (SELECT *, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM l),
z AS (SELECT *, len(regexp_extract_all(t, '[0-9]')) AS nd, len(regexp_extract_all(t, '[A-Za-z]')) AS nl FROM q),
pr AS (SELECT *, t = '' OR regexp_matches(t, '[01]{{8,}}') OR (nd >= 6 AND nd * 2 >= nl) OR (nd >= 4 AND regexp_matches(t, '[=%/>]')) AS protocol FROM z)"""


def _units(c: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


#: From protocol-free lines pr(k, pos, line, protocol): the first failing run's first known word of each k, and its warnings.
_ENGLISH = f"""ws AS (
  SELECT k, pos, unnest(regexp_extract_all(line, '[\\pL\\pN_]+')) AS w, unnest(regexp_extract_all(line, '([^\\pL\\pN_]*)[\\pL\\pN_]+', 1)) AS gap, unnest(range(len(regexp_extract_all(line, '[\\pL\\pN_]+')))) AS i FROM pr WHERE NOT protocol
), a AS (SELECT *, regexp_full_match(w, '[A-Za-z]+') AS plain FROM ws),
b AS (SELECT *, CASE WHEN coalesce(lag(plain) OVER o, false) AND regexp_full_match(gap, '[\\s,''"’‘«»-]*') THEN 0 ELSE 1 END AS fresh FROM a WINDOW o AS (PARTITION BY k, pos ORDER BY i)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY k, pos ORDER BY i) AS run FROM b),
r AS (SELECT k, pos, run, count(*) AS n, count(*) FILTER (lower(w) IN ({_in(FUNCTION_WORDS)})) AS f, arg_min(w, i) FILTER (lower(w) IN ({_in(FUNCTION_WORDS)})) AS word FROM c WHERE plain GROUP BY ALL HAVING f > 0),
en AS (SELECT k, arg_min(word, (pos, run)) FILTER (n >= 3 OR f >= 2) AS word, count(*) FILTER (n < 3 AND f < 2) AS warned FROM r GROUP BY k)"""


def _tags(c: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '</?([A-Za-z][A-Za-z0-9]*)\\b', 1), lambda x: lower(x))), lambda x: x NOT IN ('html', 'head', 'body'))"


def _wrap(c: str) -> str:
    return f"'<p>' || replace({c}, chr(10), '</p><p>') || '</p>'"


def _plain(c: str) -> str:
    x = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    for name in ("head", "script", "style"):
        x = f"regexp_replace({x}, '(?is)<{name}\\b[^>]*>.*?</{name}>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\b[^>]*>|</(p|div|h[1-6]|li|blockquote|section|article|tr|table|ul|ol)>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    return f"regexp_replace(regexp_replace({_unescaped(x)}, '^\\n+', ''), '\\n+', chr(10), 'g')"


def _unescaped(x: str) -> str:
    for name, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {sign})"
    return x


def oracle_sql() -> dict[str, str]:
    blocks = lambda c: f"len(regexp_extract_all({c}, '{BLOCK}'))"
    return {
        "glossary_compile": f"WITH {_GLOSSARY}, {_TERMS} SELECT ord, english, ru FROM g WHERE ord IN (SELECT t.ord FROM terms t JOIN documents d ON {_APPEARS})",
        "glossary_compile_benchmark": f"SELECT t.ord, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT item_id AS ord, text AS term FROM benchmark) t JOIN documents d ON contains(lower(d.text), lower(t.term)) AND {_APPEARS} GROUP BY t.ord",
        "term_hits_per_source": f"WITH {_GLOSSARY}, {_TERMS} SELECT d.source, t.term, count(*) AS n_docs FROM terms t JOIN documents d ON {_APPEARS} GROUP BY ALL",
        "candidate_phrases": f"WITH {_PHRASES} SELECT phrase, count(*) AS n FROM ph GROUP BY phrase",
        "candidate_terms": f"""WITH {_GLOSSARY}, {_TERMS}, {_PHRASES}, ok AS (
  SELECT * FROM ph WHERE len(list_filter(string_split(lower(phrase), ' '), lambda w: w NOT IN ({_in(STOP_WORDS)}))) > 0
), c AS (SELECT lower(phrase) AS k, first(phrase ORDER BY doc_id, pos, phrase) AS term, count(*) AS n, min(doc_id) AS first_doc FROM ok GROUP BY k)
SELECT term, n, first_doc FROM c WHERE k NOT IN (SELECT lower(term) FROM terms)""",
        "token_estimate": f"SELECT lang, sum({_units('text')} // 4)::BIGINT AS tokens, max({_units('text')} // 4)::BIGINT AS most FROM documents GROUP BY lang",
        "source_budget": """WITH p(context, reserved, prefix, max_input, multiplier, reserve) AS (VALUES (1000000, 128000, 5000, 90000, 0.0::DOUBLE, 0), (1000000, 128000, 5000, 90000, 2.0, 0), (1000000, 128000, 5000, 90000, 2.0, 8192), (100000, 30000, 5000, 90000, 0.0, 0), (100000, 30000, 5000, NULL, 0.0, 0))
SELECT context, reserved, multiplier, reserve, least(context - prefix - reserved, max_input - prefix, CASE WHEN multiplier > 0 THEN floor((reserved - reserve) / multiplier)::BIGINT END)::BIGINT AS budget FROM p""",
        "chunk_plan": _chunks(False),
        "chunk_plan_joint": _chunks(True),
        "chunk_reassembly": "SELECT conv_id AS chapter_no, sha256(string_agg(CASE WHEN role <> 'system' THEN text ELSE '[none]' END, '' ORDER BY turn, CASE WHEN role <> 'system' THEN text ELSE '[none]' END)) AS sha FROM conversations GROUP BY conv_id",
        "spine_pairs": f"""WITH {_EDITIONS}, en AS (SELECT * FROM s WHERE lang = 'en'), fr AS (SELECT * FROM s WHERE lang = 'fr')
SELECT coalesce(en.idx, fr.idx) AS idx, en.path AS o_file_path, left(trim(regexp_replace(en.text, '{SPACE}+', ' ', 'g')), 80) AS o_preview, fr.path AS t_file_path,
       left(trim(regexp_replace(fr.text, '{SPACE}+', ' ', 'g')), 80) AS t_preview, CASE WHEN length(en.text) > 0 THEN length(fr.text)::DOUBLE / length(en.text) END AS ratio, en.idx IS NULL OR fr.idx IS NULL AS is_tail
FROM en FULL JOIN fr ON en.idx = fr.idx""",
        "index_pairs": f"WITH {_EDITIONS} SELECT a.idx, a.path AS o_file_path, b.path AS t_file_path FROM s a JOIN s b ON a.idx = b.idx AND a.lang = 'en' AND b.lang = 'de'",
        "unpaired_tail": f"""WITH {_EDITIONS}, a AS (SELECT * FROM s WHERE lang = 'en'), b AS (SELECT * FROM s WHERE lang = 'de')
SELECT 'original' AS side, idx, path AS file_path FROM a ANTI JOIN b USING (idx) UNION ALL SELECT 'translation', idx, path FROM b ANTI JOIN a USING (idx)""",
        "pair_map_expand": f"""WITH {_EDITIONS}, m(line, o1, o2, t1, t2) AS (VALUES (1, 'en/1', 'en/1', 'fr/2', 'fr/2'), (2, 'en/3', 'en/5', 'fr/4', 'fr/6'), (3, 'en/7', 'en/7', 'fr/7', 'fr/7')),
x AS (SELECT line, a.idx AS a, b.idx AS b, unnest(range(c.idx - a.idx + 1)) AS k FROM m JOIN s a ON a.path = o1 JOIN s b ON b.path = t1 JOIN s c ON c.path = o2 JOIN s d ON d.path = t2),
y AS (SELECT row_number() OVER (ORDER BY line, k) AS ord, (a + k)::INTEGER AS o_idx, (b + k)::INTEGER AS t_idx FROM x)
SELECT ord::INTEGER AS ord, o_idx, t_idx, 'en/' || o_idx AS o_file_path, 'fr/' || t_idx AS t_file_path FROM y WHERE ord <= 4""",
        "role_classify": f"""WITH {_SECTIONS.replace('src(', 'fixed(')}, src AS (SELECT side, idx, heading, text FROM fixed UNION ALL SELECT 'd', doc_id::INTEGER, NULL, text FROM documents), {_role('heading', 'text')} SELECT side, idx, role FROM roles""",
        "role_pairs": f"""WITH {_SECTIONS}, {_role('heading', 'text')}, n AS (SELECT role FROM roles GROUP BY role HAVING count(*) FILTER (side = 'o') = 1 AND count(*) FILTER (side = 't') = 1 AND role <> 'other')
SELECT a.role, a.file_path AS o_file_path, b.file_path AS t_file_path FROM n JOIN roles a ON a.role = n.role AND a.side = 'o' JOIN roles b ON b.role = n.role AND b.side = 't'""",
        "role_unpaired": f"""WITH {_SECTIONS}, {_role('heading', 'text')}, n AS (SELECT role, count(*) FILTER (side = 'o') AS no, count(*) FILTER (side = 't') AS nt FROM roles GROUP BY role),
w AS (SELECT role, CASE WHEN role = 'other' THEN 'role ''other'' is not paired' WHEN no > 1 THEN 'duplicate role key ''' || role || ''' on original' WHEN nt > 1 THEN 'duplicate role key ''' || role || ''' on translation' WHEN no = 0 OR nt = 0 THEN 'no counterpart for ''' || role || '''' END AS reason FROM n)
SELECT CASE side WHEN 'o' THEN 'original' ELSE 'translation' END AS side, role, file_path, reason FROM roles JOIN w USING (role) WHERE reason IS NOT NULL""",
        "glossary_merge": f"""WITH {_GLOSSARY}, i(ord, english, ru, kind, notes, do_not_use, aliases) AS (VALUES {_values(INCOMING)}),
u AS (SELECT 0 AS src, * FROM g UNION ALL SELECT 1, * FROM i),
k AS (SELECT *, lower(english) AS key, row_number() OVER (PARTITION BY lower(english) ORDER BY src, ord) AS nth, count(*) OVER (PARTITION BY lower(english)) AS many FROM u),
items AS (SELECT key, src, ord, 'a' AS what, unnest(aliases) AS v, unnest(range(len(aliases))) AS p FROM k UNION ALL SELECT key, src, ord, 'd', unnest(do_not_use), unnest(range(len(do_not_use))) FROM k),
firsts AS (SELECT key, what, first(trim(v) ORDER BY src, ord, p) AS v, first(src ORDER BY src, ord, p) AS s, first(ord ORDER BY src, ord, p) AS o, first(p ORDER BY src, ord, p) AS p FROM items WHERE trim(v) <> '' GROUP BY key, what, lower(trim(v))),
lists AS (SELECT key, what, string_agg(v, '|' ORDER BY s, o, p) AS v FROM firsts GROUP BY key, what),
h AS (SELECT * FROM k WHERE nth = 1),
nn AS (SELECT key, string_agg(notes, ' ' ORDER BY src, ord) AS notes FROM k WHERE trim(coalesce(notes, '')) <> '' GROUP BY key)
SELECT CASE WHEN src = 0 THEN h.ord ELSE h.ord + 5 END AS ord, english, ru, kind, nn.notes,
       CASE WHEN many > 1 THEN coalesce((SELECT v FROM lists l WHERE l.key = h.key AND what = 'd'), '') ELSE array_to_string(do_not_use, '|') END AS do_not_use,
       CASE WHEN many > 1 THEN coalesce((SELECT v FROM lists l WHERE l.key = h.key AND what = 'a'), '') ELSE array_to_string(aliases, '|') END AS aliases
FROM h LEFT JOIN nn USING (key)""",
        "glossary_parse": "SELECT * FROM (VALUES (1, 'Librarian', 'Библиарий', 'title', 'keeps books', 'библиотекарь', 'Librarians|Librarian''s'), (2, 'Bolter', 'болтер2', 'other', NULL, '', '')) t(ord, english, ru, kind, notes, do_not_use, aliases)",
        "glossary_write": f"""WITH {_GLOSSARY}, e AS (SELECT ord, chr(10) || '## ' || english || chr(10) || '- ru: ' || ru || chr(10) || '- type: ' || kind || chr(10)
 || CASE WHEN notes IS NOT NULL THEN '- notes: ' || notes || chr(10) ELSE '' END
 || CASE WHEN len(do_not_use) > 0 THEN '- do-not-use: ' || array_to_string(do_not_use, ', ') || chr(10) ELSE '' END
 || CASE WHEN len(aliases) > 0 THEN '- aliases: ' || array_to_string(aliases, ', ') || chr(10) ELSE '' END AS md FROM g),
w AS (SELECT '# Universe' || chr(10) || chr(10) || 'Intro' || chr(10) || string_agg(md, '' ORDER BY ord) AS text FROM e)
SELECT 'g' AS doc_id, sha256(text) AS sha, length(text)::BIGINT AS n FROM w""",
        "resume_remaining": f"WITH {_STATES} SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE status = 'done' AND html <> '')",
        "resume_status": f"""WITH {_STATES}, r AS (SELECT CASE WHEN o.status = 'done' AND html = '' THEN 'pending' ELSE coalesce(o.status, 'pending') END AS status, html FROM documents LEFT JOIN o USING (doc_id))
SELECT status, count(*) AS n, count(CASE WHEN status = 'done' THEN html END) AS n_html FROM r GROUP BY status""",
        "html_tag_strip": "SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS sha FROM pages",
        "block_count": f"SELECT page_id, {blocks('html')}::BIGINT AS n_blocks FROM pages",
        "distinct_tags": f"SELECT page_id, array_to_string(list_sort({_tags('html')}), ',') AS tags FROM pages",
        "html_plain_text": f"SELECT page_id, sha256({_plain('html')}) AS sha FROM pages",
        "page_heading": f"SELECT page_id, nullif(trim(regexp_replace({_unescaped("regexp_replace(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]+>', '', 'g')")}, '{SPACE}+', ' ', 'g')), '') AS heading FROM pages",
        "collapse_ws_hash": f"SELECT doc_id, sha256(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) AS sha FROM documents",
        "validate_translation": f"""WITH w AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations),
x AS (SELECT row_number() OVER (ORDER BY conv_id, turn, text) AS k, conv_id, turn, text, {_wrap('b')} AS source, CASE WHEN turn % 3 = 2 THEN text ELSE {_wrap('text')} END AS content, CASE WHEN conv_id % 5 = 0 THEN 'LENGTH' ELSE 'stop' END AS finish FROM w WHERE role = 'assistant' AND b IS NOT NULL),
l AS (SELECT k, unnest(y) AS line, unnest(range(len(y))) AS pos FROM (SELECT k, string_split(text, chr(10)) AS y FROM x)), {_PROTOCOL}, {_ENGLISH}
SELECT conv_id, turn, CASE WHEN content IS NULL OR regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') = '' THEN 'empty' WHEN lower(finish) IN ('length', 'max_tokens') THEN 'truncated'
  WHEN len({_tags('source')}) > 0 AND NOT list_has_any({_tags('source')}, {_tags('content')}) THEN 'no source tags'
  WHEN {blocks('source')} >= 2 AND {blocks('content')} * 2 < {blocks('source')} THEN 'dropped blocks' ELSE 'English function word: ' || word END AS reason FROM x LEFT JOIN en USING (k)""",
        "protocol_lines": f"WITH {_LINES}, {_PROTOCOL} SELECT doc_id, count(*) FILTER (protocol) AS n_protocol, count(*) AS n_lines FROM pr GROUP BY doc_id",
        "english_runs": f"""WITH {_LINES.replace("SELECT doc_id, lang, unnest", "SELECT doc_id AS k, unnest").replace("FROM documents", "FROM documents WHERE lang <> 'en'")}, {_PROTOCOL}, {_ENGLISH}
SELECT doc_id, word, CASE WHEN word IS NOT NULL THEN 0 ELSE least(3, coalesce(warned, 0)) END::BIGINT AS n_warn FROM documents LEFT JOIN en ON k = doc_id WHERE lang <> 'en'""",
        "usage_totals": "SELECT sum((6 + length(text)) // 4)::BIGINT AS prompt_tokens, 0::BIGINT AS cached_tokens, sum(length(text) // 4)::BIGINT AS completion_tokens, count(*) AS steps, 0::BIGINT AS failures FROM conversations",
        "response_parse": "SELECT conv_id, turn, role, sha256(text) AS sha, 'stop' AS finish_reason, length(text)::BIGINT AS prompt_tokens, NULL::BIGINT AS cached_tokens FROM conversations",
        "sse_fold": "SELECT conv_id AS stream_id, sha256(string_agg(text, '' ORDER BY turn, role)) AS sha, 'stop' AS finish_reason, count(*) AS prompt_tokens, NULL::VARCHAR AS error FROM conversations GROUP BY conv_id",
        "plain_text_join": "SELECT doc_id // 100 AS book_id, sha256(string_agg(text, chr(10) ORDER BY doc_id, text)) AS sha FROM documents GROUP BY ALL",
        "split_pairs": """WITH j AS (SELECT a.doc_id AS ord, a.text AS o, b.text AS t, 'Original [' || a.doc_id || '/9] o' || a.doc_id || ':' || chr(10) AS h1, chr(10) || chr(10) || 'Translation [' || b.doc_id || '/7] t' || b.doc_id || ':' || chr(10) AS h2 FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2 WHERE a.doc_id >= 0 AND a.text IS NOT NULL AND b.text IS NOT NULL),
n AS (SELECT *, list_filter(range(1, 1001), lambda p: (length(h1) + length(h2) + ceil(length(o) / p) + ceil(length(t) / p))::BIGINT // 4 <= 600)[1] AS p FROM j),
z AS (SELECT *, greatest(1, ceil(length(o) / p))::BIGINT AS so, greatest(1, ceil(length(t) / p))::BIGINT AS st FROM n),
c AS (SELECT *, greatest(1, ceil(length(o) / so), ceil(length(t) / st))::BIGINT AS parts FROM z),
q AS (SELECT *, unnest(range(1, parts + 1)) AS i FROM c),
y AS (SELECT ord, parts, i, h1 || substr(o, (i - 1) * so + 1, so) || h2 || substr(t, (i - 1) * st + 1, st) AS prompt FROM q)
SELECT ord, parts, max(length(prompt))::BIGINT AS longest, sha256(string_agg(prompt, chr(10) ORDER BY i)) AS sha FROM y GROUP BY ord, parts""",
        "safe_ids": f"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9-]', '_', 'g') AS file_id, trim(replace(url, '\\', '/'), '/') AS entry, lower(trim(replace(regexp_replace(url, '^{SPACE}+|{SPACE}+$', '', 'g'), '\\', '/'), '/')) AS pair_key FROM pages",
    }
