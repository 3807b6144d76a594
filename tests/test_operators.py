import io
import random
import time
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from quillmesh.operators import chunks, glossary, packing, sections
from quillmesh.plans import answers, completer, pipelines
from quillmesh.sources import epub, glossary_md, pairmap
from quillmesh.operators.numbering import number_within
from quillmesh.sources.state import EXTRACT_STATE, TRANSLATE_STATE, Options, RunStore, check_path, read_side_files
from quillmesh.streaming import ordered

MD = "# Universe\n\nIntro\n\n## Adeptus Astartes\n- ru: Адептус\n- type: organization\n- aliases: Astartes\n\n## Ciaphas Cain\n- ru: Каин\n- type: name\n\n## Chapter\n- ru: Орден\n- type: organization\n"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), glossary_md.ENTRY)


def test_markdown_round_trip(spark):
    d, e = glossary_md.parse(docs(spark, MD))
    assert glossary_md.write(d, e).first()["text"] == MD
    d2, e2 = glossary_md.parse(docs(spark, "# T\n\nonly\n"))
    assert (d2.first()["title"], d2.first()["preamble"], e2.count()) == ("T", "only", 0)


def test_markdown_errors(spark):
    for bad in ("", "## X\n- ru: x\n"):
        with pytest.raises(Exception, match="no title"):
            glossary_md.parse(docs(spark, bad))[0].collect()
    with pytest.raises(Exception, match="no ru"):
        glossary_md.parse(docs(spark, "# T\n## X\n- type: name\n"))[1].collect()


def test_model_output(spark):
    out = glossary_md.parse_model_output(docs(spark, "Sure:\n## A\n- ru: а\n", "nothing", "## B\n- type: name\n## C\n- ru: ц\n"))
    assert [r["english"] for r in out.collect()] == ["A"]


@pytest.mark.parametrize("body, kept", [("The anti-Astartes relic", [1]), ("Chaptersomething arrived.", []), ("cain of the Chapter met CIAPHAS CAIN", [2, 3])])
@pytest.mark.parametrize("few", [True, False])
def test_compile(spark, body, kept, few):
    _, e = glossary_md.parse(docs(spark, MD))
    hits = glossary.term_hits(docs(spark, body), glossary.terms_of(e), "doc_id", broadcast_terms=100 if few else 0)
    assert sorted({r["ord"] for r in hits.collect()}) == kept


def test_merge(spark):
    old = entries(spark, (1, "Librarian", "Библиарий", "title", "Keep notes.", [], ["Librarians"]), (2, "bolter", "болтер", "other", None, [], [" x ", "X"]))
    new = entries(spark, (1, "librarian", "Библиотекарь", "other", "New note.", ["библиотекарь"], ["Librarian's", "librarians"]), (2, "Adeptus", "А", "name", None, [], []))
    rows = glossary.merge_glossaries(old, new).orderBy("ord").collect()
    assert [r["english"] for r in rows] == ["Librarian", "bolter", "Adeptus"]
    assert (rows[0]["ru"], rows[0]["kind"], rows[0]["notes"], rows[0]["aliases"], rows[0]["do_not_use"]) == ("Библиарий", "title", "Keep notes. New note.", ["Librarians", "Librarian's"], ["библиотекарь"])
    assert rows[1]["aliases"] == [" x ", "X"]
    again = glossary.merge_glossaries(glossary.merge_glossaries(old, new), new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, glossary.merge_glossaries(old, new).collect()))


def test_merge_equals_a_plain_fold(spark):
    """Random entries, with repeated names, spellings, blanks, nulls and notes inside notes, against a fold entry by entry."""
    draw = random.Random(12)
    some = lambda: draw.choice([None, [], ["a", " A ", "b"], ["B", "", " "], ["ç", "Ç", "d"], ["x y", "b"]])
    notes = [None, "", "  ", "One.", "one.", "Two", " One. Two ", "e. T", "three three"]
    row = lambda i: (i, draw.choice(["Abc", "abc", "ABC", "Def", "ghi", f"n{i}"]), f"r{i}", "name", draw.choice(notes), some(), some())
    old, new = [row(i) for i in range(1, 25)], [row(i) for i in range(1, 120)]

    def merged():
        out = [list(r[1:]) for r in old]
        at = {r[0].lower(): i for i, r in enumerate(out)}
        for r in new:
            i = at.get(r[1].lower())
            if i is None:
                at[r[1].lower()] = len(out)
                out.append(list(r[1:]))
                continue
            e = out[i]
            left, right = (e[3] or "").strip() or None, (r[4] or "").strip() or None
            e[3] = right if left is None else left if right is None or right.lower() in left.lower() else f"{left} {right}"
            for k, more in ((4, r[5]), (5, r[6])):
                seen: dict = {}
                for x in [*(e[k] or []), *(more or [])]:
                    if x.strip():
                        seen.setdefault(x.strip().lower(), x.strip())
                e[k] = list(seen.values())
        return out

    got = glossary.merge_glossaries(entries(spark, *old).repartition(3), entries(spark, *new).repartition(3)).orderBy("ord").collect()
    assert [list(r)[1:] for r in got] == merged()


def test_a_name_with_very_many_entries(spark):
    """No task lists a name's entries: what is gathered is what differs."""
    old = entries(spark, (1, "Hot", "r", "name", "first", [], ["a0"]))
    new = spark.range(1, 300_001).selectExpr("cast(id AS int) AS ord", "'hot' AS english", "'x' AS ru", "'name' AS kind", "concat('note ', id % 3) AS notes", "array(concat('A', id % 5)) AS do_not_use", "array(concat('a', id % 7), 'A0') AS aliases")
    made = glossary.merge_glossaries(old, new)
    assert [tuple(r) for r in made.collect()] == [(1, "Hot", "r", "name", "first note 1 note 2 note 0", ["A1", "A2", "A3", "A4", "A0"], ["a0", "a1", "a2", "a3", "a4", "a5", "a6"])]


def test_notes_equal_a_plain_fold(spark):
    """Notes inside one note, over the edges of several, and of words that all were there before; of 150 names."""
    draw = random.Random(5)
    words = ["a", "b", "ab", "B", "longwords", "ongwords", "LONGWORD", "longwordslongwords", "", "Σ", "ος"]
    rows, want = [], {}
    for k in range(1, 1500):
        key, note = f"n{draw.randrange(150)}", " ".join(draw.choices(words, k=draw.randint(1, 4)))
        rows.append((k, key, "r", "name", note, [], []))
        said, note = want.setdefault(key, None), note.strip()
        if note and (said is None or note.lower() not in said.lower()):
            want[key] = note if said is None else f"{said} {note}"
    # A second entry without a note, so that every name is merged.
    rows += [(k + 2000, key, "r", "name", None, [], []) for k, key in enumerate(want)]
    made = glossary.merge_glossaries(entries(spark, *rows).limit(0), entries(spark, *rows))
    assert {r["english"]: r["notes"] for r in made.collect()} == want


def test_very_many_notes_of_a_name(spark):
    """What a name gathers is not read again for each note."""
    new = spark.range(1, 20_001).selectExpr("cast(id AS int) AS ord", "'hot' AS english", "'x' AS ru", "'name' AS kind", "concat('by Somebody#', lpad(id, 9, '0'), '.') AS notes", "array('a') AS do_not_use", "array('b') AS aliases")
    began = time.monotonic()
    made = glossary.merge_glossaries(entries(spark, (1, "Hot", "r", "name", "first", [], [])), new).collect()
    assert made[0]["notes"] == " ".join(["first", *(f"by Somebody#{k:09d}." for k in range(1, 20_001))])
    assert time.monotonic() - began < 60


def test_pair_map(spark):
    rows = pairmap.parse(docs(spark, "a = b # c\n\nx .. y = z .. w\n")).orderBy("line_no").collect()
    assert [(r["original_from"], r["original_to"], r["translation_to"]) for r in rows] == [("a", "a", "b"), ("x", "y", "w")]
    for bad in ("a b", "a = b = c", "a =", "a .. b = c", "a .. b .. c = d .. e", "a .. = b .. c"):
        assert pairmap.parse(docs(spark, bad), strict=False).first()["error"]
        with pytest.raises(Exception, match="invalid pair line"):
            pairmap.parse(docs(spark, bad)).collect()


def side(spark, prefix, n):
    return spark.createDataFrame([(i, f"{prefix}/{i}.xhtml") for i in range(1, n + 1)], "idx int, file_path string")


def test_expand(spark):
    o, t = side(spark, "o", 5), side(spark, "t", 5)
    got = sections.expand_pair_map(pairmap.parse(docs(spark, "O\\1.xhtml = t/2.xhtml\no/3.xhtml .. o/4.xhtml = t/4.xhtml .. t/5.xhtml")), o, t).orderBy("ord").collect()
    assert [(r["o_idx"], r["t_idx"]) for r in got] == [(1, 2), (3, 4), (4, 5)]
    for bad, why in (("o/9 = t/1.xhtml", "not in the book"), ("o/3.xhtml .. o/1.xhtml = t/1.xhtml .. t/3.xhtml", "backwards"), ("o/1.xhtml .. o/2.xhtml = t/1.xhtml .. t/3.xhtml", "length"), ("o/1.xhtml = t/1.xhtml\no/1.xhtml = t/2.xhtml", "twice")):
        with pytest.raises(Exception, match=why):
            sections.expand_pair_map(pairmap.parse(docs(spark, bad)), o, t).collect()


@settings(max_examples=8, deadline=None)
@given(lengths=st.lists(st.integers(0, 90), min_size=1, max_size=30), joint=st.booleans())
def test_packing_keeps_everything(spark, lengths, joint):
    blocks = ["x" * n for n in lengths]
    chapters = spark.createDataFrame([(1, "c", "".join(blocks), blocks)], "chapter_no int, file_path string, body_inner_html string, block_fragments array<string>")
    rows = chunks.plan_chunks(chapters, 22, joint).orderBy("piece_no").collect()
    assert "".join(r["source_html"] for r in rows) == "".join(blocks)
    if joint:
        assert all(len(r["source_html"]) // 4 <= 22 for r in rows)


def greedy(lengths, budget, joint):
    """Groups, from 1, block by block."""
    limit, used, group, out = budget * 4 + 3 if joint else budget, 0, 0, []
    for n in lengths:
        size = n if joint else n // 4
        if not out or used + size > limit:
            used, group = 0, group + 1
        used += size
        out.append(group)
    return out


@pytest.mark.parametrize("joint", [False, True])
def test_packing_across_rows(spark, joint, monkeypatch):
    """Ranges of a chapter are packed as one row is, whatever lies at their ends: blocks of no cost, blocks beyond the budget, groups longer than a range."""
    draw = random.Random(8)
    chapters = {c: [draw.choice([0, 0, 1, 3, 4, 9, 17, 40, 90, 200][: draw.randint(1, 10)]) for _ in range(draw.randint(1, 90))] for c in range(120)}
    chapters |= {200: [0] * 50, 201: [500] * 30, 202: [4] * 100, 203: [1]}
    want = sorted((c, i, g) for c, ns in chapters.items() for i, g in enumerate(greedy(ns, 12, joint)))
    rows = spark.createDataFrame([(c, i, n) for c, ns in chapters.items() for i, n in enumerate(ns)], "chapter_no int, pos int, n int").repartition(5)
    for span in (1, 4, 7, 1000):
        assert sorted(map(tuple, packing.pack_rows(rows, 12, joint, span).collect())) == want
    whole = spark.createDataFrame([(c, ns) for c, ns in chapters.items()], "c int, ns array<int>")
    for short in (chunks.SHORT, 20):  # folded, and by sums
        monkeypatch.setattr(chunks, "SHORT", short)
        got = whole.select("c", F.posexplode(chunks.pack_blocks(F.col("ns"), 12, joint)).alias("pos", "g")).collect()
        assert sorted((r["c"], r["pos"], r["g"] + 1) for r in got) == want
    assert packing.pack_rows(rows.limit(0), 12).count() == 0


def test_a_chapter_of_a_million_blocks(spark):
    """In one row, and in rows: linear in the number of blocks."""
    import time

    n = 1_000_000
    blocks = spark.range(n).selectExpr("1 AS chapter_no", "id AS pos", "cast(20 + id % 37 AS int) AS n")
    began = time.time()
    got = packing.pack_rows(blocks, 500).agg(F.max("piece_no"), F.count("*"), F.sum("piece_no")).first()
    want = greedy([20 + i % 37 for i in range(n)], 500, False)
    assert tuple(got) == (want[-1], n, sum(want))
    row = spark.range(1).selectExpr("transform(sequence(0, 999999), i -> 20 + i % 37) AS ns")
    assert row.select(F.size(chunks.pack_starts(F.col("ns"), 500))).first()[0] == want[-1]
    assert time.time() - began < 60


def test_long_chapters_keep_their_text(spark):
    parts = [f"<p>{'x' * (i % 50)}</p>" for i in range(300)]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(parts)], "chapter_no int, pos int, html string")
    rows = packing.plan_long_chunks(blocks, 40).orderBy("piece_no").collect()
    assert "".join(r["source_html"] for r in rows) == "".join(parts) and [r["piece_no"] for r in rows] == list(range(1, greedy([len(t) for t in parts], 40, False)[-1] + 1))


def test_plan_errors_and_assembly(spark):
    chapters = spark.createDataFrame([(1, "c", "x" * 99, ["x" * 99])], "chapter_no int, file_path string, body_inner_html string, block_fragments array<string>")
    with pytest.raises(Exception, match="exceeds"):
        chunks.plan_chunks(chapters, 8).collect()
    rows = [(1, 2, "c", "s2", None), (1, 1, "c", "s1", "т1"), (2, 1, "d", "s", "т")]
    random.shuffle(rows)
    got = chunks.assemble(spark.createDataFrame(rows, "chapter_no int, piece_no int, file_path string, source_html string, html string"))
    assert {r["file_path"]: r["body"] for r in got.collect()} == {"c": "т1s2", "d": "т"}


def test_resume(spark):
    plan = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "chunk_id string, source_html string")
    old = spark.createDataFrame([("a", "done", "т"), ("b", "done", ""), ("z", "done", "т")], "chunk_id string, status string, html string")
    assert {r["chunk_id"]: r["status"] for r in chunks.resume(plan, old).collect()} == {"a": "done", "b": "pending", "c": "pending"}
    assert sorted(r["chunk_id"] for r in chunks.remaining(plan, old).collect()) == ["b", "c"]


def test_ranges_and_options(tmp_path):
    assert chunks.parse_chapter_range(None, 9) == (1, 9)
    assert chunks.parse_chapter_range("2 - 4", 9) == (2, 4)
    for bad in ("0", "4-2", "10", "x", "1-2-3"):
        with pytest.raises(ValueError, match="9 chapters"):
            chunks.parse_chapter_range(bad, 9)
    budgets = [Options(1_000_000, 128_000, 90_000, m, r).source_budget(5_000) for m, r in ((0, 0), (2, 0), (2, 8192))]
    assert budgets == [85_000, 64_000, 59_904]
    assert Options.load({"max_retries": 2}, {"QUILLMESH_MAX_RETRIES": "5"}).max_retries == 5
    for name, text in (("a.json", '{"ContextTokens": 5000, "max_retries": 4, "other": 1}'), ("b.json", '{"MaxRetries": 7}')):
        (tmp_path / name).write_text(text)
    loaded = Options.load(environ={}, files=tuple(str(tmp_path / n) for n in ("a.json", "none.json", "b.json")))
    assert (loaded.context_tokens, loaded.max_retries) == (5000, 7)
    for bad in ("x.pdf", "x.txt"):
        with pytest.raises(ValueError):
            check_path(bad)
    with pytest.raises(ValueError):
        Options(translate_concurrency=9)


PAIR = "ord int, o_idx int, n_o long, o_path string, o_text string, t_idx int, n_t long, t_path string, t_text string"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 400), st.integers(0, 400), st.integers(18, 130))
def test_split_pairs(spark, o, t, budget):
    """The prompt with its lines fits, by the least number of parts that does."""
    text = lambda n: "".join(chr(97 + i % 26) for i in range(n))
    wrap = lambda a, b: f"Original [1/2] a/b.xhtml:\n{a}\n\nTranslation [1/3] c.xhtml:\n{b}"
    cut = lambda x, p: [x[i : i + -(-len(x) // p)] for i in range(0, len(x), -(-len(x) // p))] if x else [""]
    want = None
    for p in range(1, 1001):
        a, b = cut(text(o), p), cut(text(t), p)
        prompts = [wrap(a[i] if i < len(a) else "", b[i] if i < len(b) else "") for i in range(max(len(a), len(b)))]
        if all(len(x) // 4 <= budget for x in prompts):
            want = prompts
            break
    rows = chunks.split_pairs(spark.createDataFrame([(1, 1, 2, "a/b.xhtml", text(o), 1, 3, "c.xhtml", text(t))], PAIR), budget)
    if want is None:
        with pytest.raises(Exception, match="does not fit"):
            rows.collect()
    else:
        assert [r["prompt"] for r in rows.orderBy("piece").collect()] == want


def test_split_pairs_counts_utf16(spark):
    rows = chunks.split_pairs(spark.createDataFrame([(1, 1, 2, "a", "\U0001f600" * 90, 1, 3, "c", "x")], PAIR), 30).collect()
    assert len(rows) > 2 and all(len(r["prompt"].encode("utf-16-le")) // 8 <= 30 for r in rows) and "".join(r["o_text"] for r in sorted(rows, key=lambda r: r["piece"])) == "\U0001f600" * 90


def test_large_pair_maps_are_expanded_alike(spark, monkeypatch):
    """Lines placed by ranges of lines, and in one task: the same pairs and errors."""
    o, t = (spark.createDataFrame([(i, f"{p}/{i}") for i in range(1, 40)], "idx int, file_path string") for p in "ot")
    text = "o/1 .. o/9 = t/1 .. t/9\no/4 = t/30\no/20 .. o/18 = t/20 .. t/18\no/10 = t/10\nx = t/11\no/12 .. o/14 = t/8 .. t/10\no/39 = t/39"
    mapped = pairmap.parse(docs(spark, text))
    got = []
    for small in (sections.SMALL, 2):
        monkeypatch.setattr(sections, "SMALL", small)
        got.append([tuple(r) for r in sections.expand_pair_map(mapped, o, t, 16, strict=False).orderBy("ord").collect()])
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(1, 16 + 1))
    assert [r[5] for r in got[0]] == [None] * 3 + ["a section is named twice"] + [None] * 3 + ["a section is named twice"] * 3 + ["a range runs backwards", "a section is named twice", "a path is not in the book", "a section is named twice", "a section is named twice", "a section is named twice"]


def test_overlaps_and_sums_before(spark):
    """The sweep against all pairs, and running sums and maxima against plain ones."""
    from quillmesh.operators.numbering import before

    draw = random.Random(3)
    for most in (3, 40, 400):
        ranges = [(i, a, a + draw.randint(0, most)) for i, a in enumerate(draw.randint(1, 2_000) for _ in range(200))] + [(900, 5_000, 5_000), (901, 5_001, 5_002), (902, 5_002, 5_003)]
        want = sorted(i for i, a, z in ranges if any(j != i and b <= z and y >= a for j, b, y in ranges))
        got = sections.overlapping(spark.createDataFrame(ranges, "line_no int, a int, z int").repartition(3), "a", "z")
        assert sorted(r[0] for r in got.collect()) == want
    rows = [(i, draw.randint(-9, 9)) for i in range(300)]
    got = before(spark.createDataFrame(rows, "o int, v int").repartition(5), ["o"], {"s": ("sum", "v"), "m": ("max", "v")}).orderBy("o").collect()
    assert [(r["s"], r["m"]) for r in got] == [(sum(v for _, v in rows[:i]) if i else None, max((v for _, v in rows[:i]), default=None)) for i in range(300)]
    assert before(spark.createDataFrame([], "o int, v int"), ["o"], {"s": ("sum", "v")}).count() == 0


def test_number_within(spark):
    rows = [("a" if i % 3 else "b", (i * 7919) % 1000 if i % 50 else None) for i in range(2000)] + [(None, 5)]
    got = number_within(spark.createDataFrame(rows, "g string, k int"), "g", "k", "n", ranges=7).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["k"] for r in mine] == sorted((k for x, k in rows if x == g), key=lambda k: (k is not None, k))
    assert number_within(spark.createDataFrame([], "g string, k int"), "g", "k", "n").collect() == []


def test_many_terms_of_any_alphabet(spark):
    texts = [(1, "Который кот? the Old cat"), (2, "КОТ и old"), (3, None), (4, "x9 ça va"), (4, "x9 ça va"), (5, "no")]
    terms = [(1, "кот"), (2, "old cat"), (3, "ça"), (4, "9"), (5, "и"), (6, "zz"), (7, "ЧТО"), (8, "Ça v")]
    df, t = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "ord int, term string")
    few = sorted(set(map(tuple, glossary.term_hits(df, t, "id").collect())))
    assert sorted(set(map(tuple, glossary.term_hits(df, t, "id", broadcast_terms=2).collect()))) == few
    assert glossary.term_hits(df, t, "id", broadcast_terms=2).count() == glossary.term_hits(df, t, "id").count()
    assert (1, 1, "кот") in few and (2, 1, "кот") in few and (1, 2, "old cat") in few and (4, 3, "ça") in few


def test_matcher_equals_a_plain_search(spark):
    """Both ways of the matcher against a search of every term in every text, over letters of several alphabets, signs and odd cases."""
    draw = random.Random(6)
    letters = ["a", "b", "A", "é", "К", "к", "ß", "😀", "\u212a", "İ", "ſ", " ", "-", "'", "9", "+", ".", "\n"]
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    terms = sorted({word(draw.randint(1, 5)) for _ in range(150)} | {"a b a b a", "b a b a", "k", "K9", "a", "+", " ", "ab", "\\E", "a.b", "кк"})
    texts = [word(draw.randint(0, 60)) for _ in range(60)] + [None, "", "a b a b a", "ab\u212ab a", "\\Q\\E"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = spark.createDataFrame([*enumerate(terms), (999, ""), (998, None)], "ord int, term string")
    plain = df.crossJoin(t).where(glossary.appears_in(F.col("text"), F.col("term"))).select("id", "ord", "term")
    want = sorted(map(tuple, plain.collect()))
    assert len(want) > 300
    assert sorted(map(tuple, glossary.term_hits(df, t, "id").collect())) == want
    assert sorted(map(tuple, glossary.term_hits(df, t, "id", broadcast_terms=3).collect())) == want
    assert glossary.term_hits(df, t.limit(0), "id").count() == 0


def test_terms_that_begin_alike(spark):
    """Half of 50,000 terms begin with one word that every text has: no key is shared by many terms, and nothing is tested against all."""
    terms = spark.range(50_000).selectExpr("cast(id AS int) AS ord", "CASE WHEN id % 2 = 0 THEN concat('The Order of ', translate(cast(id AS string), '0123456789', 'abcdefghij')) ELSE concat(translate(cast(id AS string), '0123456789', 'klmnopqrst'), ' of the House') END AS term")
    keys = glossary.term_keys(terms)
    assert keys.count() == 50_000 and keys.groupBy("_key").count().agg(F.max("count")).first()[0] == 1
    texts = spark.range(2_000).selectExpr("id", "concat('the order of the house, THE ORDER OF ', translate(cast(id * 2 AS string), '0123456789', 'abcdefghij'), '; of the house ', 'order of ', translate(cast(id AS string), '0123456789', 'klmnopqrst'), ' of the house. ') AS text")
    hits = glossary.term_hits(texts, terms, "id")
    got = hits.collect()
    assert sorted((r["id"], r["ord"]) for r in got) == sorted([(i, 2 * i) for i in range(2_000)] + [(i, i) for i in range(1, 2_000, 2)])
    for n in (2_000, 100_000):
        plan = glossary.term_hits(texts, terms.limit(1_000), "id", broadcast_terms=n)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def book(*bodies):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="chapter{n}.xhtml"/>' for n in range(1, len(bodies) + 1))
        refs = "".join(f'<itemref idref="i{n}"/>' for n in range(1, len(bodies) + 1))
        z.writestr("OEBPS/content.opf", f'<package xmlns="urn:o"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        z.writestr("OEBPS/style.css", "p{}")
        for n, b in enumerate(bodies, 1):
            z.writestr(f"OEBPS/chapter{n}.xhtml", f'<?xml version="1.0"?><html><head><title>t</title></head><body>{b}</body></html>')
    return out.getvalue()


def test_epub(spark, tmp_path):
    data = book("   ", "<p>The anti-Astartes <em>relic</em></p><p>Second</p>", "<div>bare</div>")
    (tmp_path / "a.epub").write_bytes(data)
    rows = epub.read_books(spark, str(tmp_path)).orderBy("chapter_no").collect()
    assert [(r["chapter_no"], r["file_path"], len(r["block_fragments"])) for r in rows] == [(1, "OEBPS/chapter2.xhtml", 2), (2, "OEBPS/chapter3.xhtml", 1)]
    spark.dataSource.register(epub.EpubSource)
    assert spark.read.format("epub").load(str(tmp_path / "a.epub")).count() == 2
    copy = epub.copy_with(data, {"OEBPS\\chapter2.xhtml": "<p>новое</p>"})
    with zipfile.ZipFile(io.BytesIO(copy)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert b"p{}" == z.read("OEBPS/style.css") and "<body><p>новое</p></body>" in z.read("OEBPS/chapter2.xhtml").decode()
    for bad in ({"mimetype": "x"}, {"nope": "x"}):
        with pytest.raises(ValueError):
            epub.copy_with(data, bad)
    with pytest.raises(ValueError, match="Failed to read EPUB:"):
        epub.spine_of(b"not-an-epub", "b")


def to_russian(prefix, content, feedback):
    if "boom" in content:
        raise completer.CompletionError("busy", True)
    if "bad" in content and feedback is None:
        return completer.Answer("the and of it")
    return completer.Answer(content.replace("text", "текст").replace("bad", "плохой"), "stop", 10, None, 5)


def test_translate(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book("<p>text</p>", "<p>bad</p>", "<p>boom</p>"))
    chapters = epub.read_books(spark, str(tmp_path))
    run = RunStore(spark, str(tmp_path / "run"))
    out = pipelines.translate(spark, chapters, MD, to_russian, options=Options(max_retries=2), run=run)
    assert {r["chunk_id"]: r["status"] for r in out["outcome"].collect()} == {"0001-0001": "done", "0002-0001": "done", "0003-0001": "failed"}
    assert [r["body"] for r in out["bodies"].orderBy("chapter_no").collect()] == ["<p>текст</p>", "<p>плохой</p>", "<p>boom</p>"]
    assert [c["status"] for c in run.state(TRANSLATE_STATE)["chunks"]] == ["done", "done", "failed"]
    again = pipelines.translate(spark, chapters, MD, only_third, options=Options(), run=run, resume=True)
    assert again["outcome"].where("status = 'done'").count() == 3
    with pytest.raises(ValueError, match="cannot resume: prefixHash"):
        pipelines.translate(spark, chapters, MD + "\n", to_russian, run=run, resume=True)
    with pytest.raises(ValueError, match="cannot resume: toChapter"):
        pipelines.translate(spark, chapters, MD, to_russian, run=run, resume=True, chapter_range="1-2")
    pipelines.write_run_files(out["outcome"], str(tmp_path / "run"))
    files = {r["path"]: r["value"] for r in read_side_files(spark, str(tmp_path / "run")).collect()}
    assert files["chunks/0001-0001.translated.html"] == "<p>текст</p>" and files["chunks/0003-0001.error.txt"] == "busy" and "chunks/0003-0001.translated.html" not in files
    target = tmp_path / "out.epub"
    pipelines.write_translation(spark, str(tmp_path / "a.epub"), out["bodies"], str(target))
    assert "текст" in epub.spine_of(target.read_bytes(), "x")[0][3]


def only_third(prefix, content, feedback):
    if "boom" not in content:
        raise AssertionError("this chunk is done")
    return completer.Answer("<p>бум</p>")


def test_translate_refuses_answers_without_the_source_s_markup(spark):
    rows = [("0001-0001", "<p>one</p><p>two</p><p>three</p><p>four</p>"), ("0002-0001", "<p>plain</p>"), ("0003-0001", "<p>cut</p>")]
    said = {"one": "<p>один</p>", "plain": "без разметки", "cut": "<p>обрез</p>"}
    call = lambda prefix, content, feedback: completer.Answer(next(v for k, v in said.items() if k in content), "LENGTH" if "cut" in content else "stop")
    df = spark.createDataFrame(rows, "chunk_id string, source_html string")
    got = {r["chunk_id"]: (r["status"], r["reason"], r["attempts"]) for r in completer.complete_chunks(df, call, "p", 2, pause=lambda s: None).collect()}
    assert got == {"0001-0001": ("failed", "dropped blocks", 2), "0002-0001": ("failed", "no source tags", 2), "0003-0001": ("failed", "truncated", 2)}


def refused(prefix, content, feedback):
    if "bad" in content:
        raise completer.CompletionError("no such model", False)
    return to_russian(prefix, content, feedback)


def test_translate_stops_on_an_error_and_keeps_what_it_paid_for(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book("<p>text</p>", "<p>bad</p>", "<p>text 3</p>"))
    chapters = epub.read_books(spark, str(tmp_path))
    run = RunStore(spark, str(tmp_path / "run"))
    with pytest.raises(completer.RunStopped, match="no such model"):
        pipelines.translate(spark, chapters, MD, refused, options=Options(translate_concurrency=1), run=run)
    assert {r["chunk_id"]: r["status"] for r in answers.last_of_each(answers.logged(spark, run.root)).collect()}["0001-0001"] == "done"
    assert run.state(TRANSLATE_STATE)["chunks"][0]["status"] == "done"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.epub").write_bytes(book("<p>bad</p>", "<p>text</p>"))
    run = RunStore(spark, str(tmp_path / "run2"))
    with pytest.raises(completer.RunStopped):
        pipelines.translate(spark, epub.read_books(spark, str(tmp_path / "b")), MD, refused, run=run)
    assert answers.last_of_each(answers.logged(spark, run.root)).count() == 1  # the first call fails alone; the others are not made


def test_feedback_that_does_not_fit_is_left_out(spark):
    notes = []
    room = completer.Room(10, 100, 10)
    assert not room.holds("x" * 100, "y" * 200) and room.holds("x" * 100, "y" * 100)
    assert not completer.Room(10, 1000, 10, 40).holds("x" * 40, "y" * 40)

    def call(prefix, content, feedback):
        notes.append(feedback)
        return completer.Answer("" if feedback is None and not notes[1:] else "<p>да</p>")

    df = spark.createDataFrame([("1", "<p>a</p>")], "chunk_id string, source_html string")
    for limits, want in ((room, "no"), (None, "note")):
        seen = completer.complete_chunks(df, lambda p, c, f: completer.Answer("<p>да</p>" if f else "", completion_tokens=1), "p", 2, room=completer.Room(60, 100, 10) if limits else None, pause=lambda s: None).first()
        assert seen["status"] == ("failed" if want == "no" else "done")


def extracted(prefix, content, feedback):
    name = "First" if "chapter1" in content else "Second"
    return completer.Answer(f"Here:\n## {name}\n- ru: {name[0]}\n\n## Shared\n- ru: {name}\n- notes: from {name}\n")


GLOSSARY_MD = "# G\n\n## First\n- ru: F\n- type: other\n\n## Shared\n- ru: First\n- type: other\n- notes: from First from Second\n\n## Second\n- ru: S\n- type: other\n"


@pytest.fixture
def editions(spark, tmp_path):
    for name in ("o", "t"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "b.epub").write_bytes(book("<h1>Chapter One</h1><p>x</p>", "<h1>Epilogue</h1><p>y</p>"))
    return tuple(epub.read_books(spark, str(tmp_path / n)) for n in ("o", "t"))


def test_extract_and_list_pairs(spark, editions):
    o, t = editions
    md = pipelines.extract(spark, o, t, "# G\n", extracted).first()["text"]
    assert md == GLOSSARY_MD
    report = pipelines.list_pairs(o, t).first()["text"]
    assert "Suggested role pairs\nchapter 1  OEBPS/chapter1.xhtml  OEBPS/chapter1.xhtml\n" in report and "1.00" in report


def test_extract_stops_keeps_and_resumes(spark, editions, tmp_path):
    o, t = editions

    def second_fails(prefix, content, feedback):
        if "chapter2" in content:
            raise completer.CompletionError("out of money", False)
        return extracted(prefix, content, feedback)

    def first_fails(prefix, content, feedback):
        if "chapter1" in content:
            raise completer.CompletionError("busy", True)
        return extracted(prefix, content, feedback)

    def second_only(prefix, content, feedback):
        assert "chapter2" in content
        return extracted(prefix, content, feedback)

    run = RunStore(spark, str(tmp_path / "run"))
    with pytest.raises(completer.RunStopped, match="out of money") as stopped:
        pipelines.extract(spark, o, t, "# G\n", second_fails, run=run)
    assert "## First" in stopped.value.partial.first()["text"] and "## Second" not in stopped.value.partial.first()["text"]
    assert run.state(EXTRACT_STATE)["completedSteps"] == ["1:OEBPS/chapter1.xhtml"]
    with pytest.raises(ValueError, match="cannot resume: contextWindowTokens"):
        pipelines.extract(spark, o, t, "# G\n", second_only, options=Options(context_tokens=50_000), run=run, resume=True)
    assert pipelines.extract(spark, o, t, "# G\n", second_only, run=run, resume=True).first()["text"] == GLOSSARY_MD
    # An answer after a gap waits: it is kept, but not merged.
    run = RunStore(spark, str(tmp_path / "run2"))
    with pytest.raises(completer.RunStopped, match="busy"):
        pipelines.extract(spark, o, t, "# G\n", first_fails, options=Options(max_retries=1), run=run)
    steps = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq long, label string")
    answers = spark.createDataFrame([("a", "done", "A"), ("c", "done", "C"), ("b", "failed", None)], "chunk_id string, status string, html string")
    ready, waiting = pipelines.in_order(steps, answers)
    assert [r["label"] for r in ready.collect()] == ["a"] and [r["label"] for r in waiting.collect()] == ["c"]


def test_extract_prefix_falls_back_to_names(spark):
    md = "# G\n" + "".join(f"\n## Name{i}\n- ru: имя\n- notes: {'long ' * 20}\n" for i in range(20))
    _, entries = glossary_md.parse(pipelines.one_document(spark, md))
    full = pipelines.extract_prefix("Rules \n", md, entries, Options())
    assert full == "Rules\n\n" + md.rstrip()
    names = pipelines.extract_prefix("Rules", md, entries, Options(context_tokens=400, reserved_output_tokens=200))
    assert names.startswith("Rules\n\nThese English names have entries") and names.endswith("\nName18\nName19")
    with pytest.raises(ValueError, match="no room"):
        pipelines.extract_prefix("Rules", md, entries, Options(context_tokens=270, reserved_output_tokens=200))


def test_http_completer(monkeypatch):
    import http.server
    import json
    import threading

    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], asked))
            code = int(asked["model"]) if asked["model"].isdigit() else 200
            events = ['{"choices":[{"delta":{"content":"<p>При"}}]}', '{"choices":[{"delta":{"content":"вет</p>"},"finish_reason":"stop"}]}', '{"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":2}}'] + ["[DONE]"] * (asked["model"] != "broken")
            body = "".join(f"data: {e}\n\n" for e in events) if asked["stream"] else json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": "да"}]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7, "prompt_tokens_details": {"cached_tokens": 5}}})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/"
    make = lambda model="m", **more: completer.HttpCompleter(url, model, 9, **more)
    with pytest.raises(completer.CompletionError, match="no key"):
        make()("p", "c", None)
    monkeypatch.setenv("QUILLMESH_API_KEY", "k")
    assert make()("p", "c", None) == completer.Answer("да", "stop", 7, 5, None)
    assert seen[-1] == ("/v1/chat/completions", "Bearer k", {"model": "m", "messages": [{"role": "system", "content": "p"}, {"role": "user", "content": "c"}], "max_tokens": 9, "stream": False})
    assert make(stream=True, temperature=0.5, reasoning="none", caching=True)("p", "c", "note") == completer.Answer("<p>Привет</p>", "stop", 3, None, 2)
    assert [m["content"] for m in seen[-1][2]["messages"][1:]] == ["note", "c"] and seen[-1][2]["reasoning"] == {"enabled": False}
    for model, again in (("429", True), ("502", True), ("400", False), ("401", False)):
        with pytest.raises(completer.CompletionError) as e:
            make(model)("p", "c", None)
        assert e.value.retryable is again
    with pytest.raises(completer.CompletionError, match="ended early") as e:
        make("broken", stream=True)("p", "c", None)
    assert e.value.retryable
    server.shutdown()
    server.server_close()
    with pytest.raises(completer.CompletionError, match="out of reach"):
        make(timeout=2)("p", "c", None)
    for bad in ({"timeout": 0}, {"reasoning": "huge"}, {"cache_ttl": "2h"}):
        with pytest.raises(ValueError):
            make(**bad)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=8))
def test_stream_folds_alike_in_any_pieces(cut):
    good = ': keep\r\n\r\ndata: {"choices":[{"index":0,"delta":{"content":"<p>При"}}]}\r\n\r\ndata: {"choices":[{"index":0,\ndata: "delta":{"content":"вет</p>"},"finish_reason":"stop"}]}\n\ndata: [DONE]\n\n'
    fold = ordered.EventFold()
    ends = sorted({0, len(good), *(c % len(good) for c in cut)})
    for a, z in zip(ends, ends[1:]):
        fold.feed(good[a:z])
    assert fold.result() == ordered.fold_events(good) and fold.result()["content"] == "<p>Привет</p>"


def test_sse(spark):
    good = ': keep\n\ndata: {"choices":[{"index":0,"delta":{"content":"<p>При"}}]}\n\ndata: {"choices":[{"index":0,\ndata: "delta":{"content":"вет</p>"},"finish_reason":"stop"}]}\n\ndata: {"choices":[],"usage":{"prompt_tokens":100,"completion_tokens":50,"prompt_tokens_details":{"cached_tokens":90}}}\n\ndata: [DONE]\n\n'
    f = ordered.fold_events(good)
    assert (f["content"], f["prompt_tokens"], f["cached_tokens"], f["error"]) == ("<p>Привет</p>", 100, 90, None)
    for bad in ("", "data: {\n\n", 'data: {"error":"x"}\n\n', good.replace("data: [DONE]\n\n", ""), good.replace('"finish_reason":"stop"', '"x":1')):
        assert ordered.fold_events(bad)["error"] and ordered.fold_events(bad)["content"] is None
    assert spark.createDataFrame([(good,)], "t string").select(ordered.fold_sse("t")["content"]).first()[0] == "<p>Привет</p>"


def test_request_json(spark):
    import json

    row = spark.createDataFrame([("m", "pre", "body", "note")], "m string, p string, c string, f string")
    plain = json.loads(row.select(completer.request_json(F.col("m"), F.col("p"), F.col("c"), F.lit(9), F.col("f"), F.lit(0.5))).first()[0])
    assert [m["content"] for m in plain["messages"]] == ["pre", "note", "body"] and plain["max_tokens"] == 9 and plain["temperature"] == 0.5 and plain["model"] == "m"
    cached = json.loads(row.select(completer.request_json(F.col("m"), F.col("p"), F.col("c"), F.lit(9), caching=True, stream=True, reasoning="none")).first()[0])
    assert cached["messages"][0]["content"][0]["cache_control"] == {"type": "ephemeral"} and cached["max_completion_tokens"] == 9 and len(cached["session_id"]) == 64 and cached["reasoning"] == {"enabled": False}


@settings(max_examples=30, deadline=None)
@given(st.permutations(list(range(1, 9))), st.integers(1, 8))
def test_release_in_order(order, size):
    next_seq, waiting, out = 1, {}, []
    for a in range(0, len(order), size):
        next_seq, waiting, ready = ordered.release(next_seq, waiting, ((s, str(s)) for s in order[a : a + size]))
        out += ready
    assert [s for s, _ in out] == list(range(1, 9)) and not waiting


def test_ordered_stream(spark, tmp_path):
    schema = "run_id string, seq long, content string"
    for n, rows in enumerate(([("r", 3, "c"), ("q", 1, "z")], [("r", 1, "a")], [("r", 2, "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ordered.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ordered.ordered_outputs(stream).writeStream.format("memory").queryName("ordered_test").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    rows = stream.sparkSession.sql("select run_id, seq, content from ordered_test").collect()
    assert [r["content"] for r in rows if r["run_id"] == "r"] == ["a", "b", "c"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
