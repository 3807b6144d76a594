import pytest
from pyspark.sql import functions as F

from quillmesh.functions import html as h
from quillmesh.functions import roles, text, validate


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))


def value(spark, column, **columns):
    return one(spark, **columns).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "body, term, expected",
    [
        ("The anti-Astartes relic", "Astartes", True), ("The Astartes’ relic", "astartes", True), ("Chaptersomething arrived.", "Chapter", False),
        ("subChapter, then Chapter.", "Chapter", True), ("1.*2", ".*", True), ("say \\E now", "\\E", True), ("ПЕРВАЯ глава", "первая", True), ("x", "", False),
    ],
)
def test_appears_in(spark, body, term, expected):
    assert value(spark, text.appears_in(F.col("b"), F.col("t")), b=body, t=term) is expected


def test_scalars(spark):
    x = F.col("x")
    assert value(spark, text.collapse_space(x), x=" a  \n b\t") == "a b"
    assert value(spark, text.split_list(x), x=" a, ,b ,") == ["a", "b"]
    assert value(spark, text.parse_kind(x), x=" Title ") == "title"
    assert value(spark, text.parse_kind(x), x="weapon") == "other"
    assert value(spark, text.trim_preamble(x), x="\n  \na\n\nb\n \n") == "a\n\nb"
    assert value(spark, text.pair_path_key(x), x=" \\OEBPS\\Ch1.xhtml/ ") == "oebps/ch1.xhtml"
    assert value(spark, text.utf16_length(x), x="😀ab") == 4
    assert value(spark, text.safe_file_id(x), x="0001-0002/é") == "0001-0002__"
    assert value(spark, text.compact_error(x), x="a\n\x00\tb") == "a b"
    assert value(spark, text.split_equally(x, F.lit(3)), x="abcdefgh") == ["abc", "def", "gh"]
    assert value(spark, text.capitalised_phrases(x), x="The Golden  Throne of eArth, Terra") == ["The Golden Throne", "Terra"]
    assert value(spark, text.is_stop_phrase(x), x="The Of") is True
    assert value(spark, text.backoff_ms(F.lit(9)), x="") == 6400
    assert value(spark, text.chunk_id(F.lit(3), F.lit(12)), x="") == "0003-0012"


PAGE = "<html><head><title>no</title></head><body><h1>A &amp; B</h1><div><p>one <em>two</em><br/>three</p></div><!-- c --><ul><li>x</li></ul><script>var p='</p>';</script></body></html>"


def test_tree():
    assert h.plain_text_of(PAGE) == "A & B\none two\nthree\nx\n"
    assert h.block_fragments_of(PAGE) == ["<h1>A &amp; B</h1>", "<p>one <em>two</em><br/>three</p>", "<li>x</li>"]
    assert h.first_heading_of(PAGE) == "A & B"
    assert h.body_inner_of("<p>x</p>") == ""
    assert h.block_fragments_of("<body><div>Wrapped in a <em>div</em></div></body>") == ["<div>Wrapped in a <em>div</em></div>"]
    assert h.block_fragments_of("<body>  </body>") == []
    assert h.block_fragments_of("<body><p>a<p>b</body>") == ["<p>a", "<p>b"]
    assert h.replace_body_of("<html><body class='x'>old</body></html>", "<p>new</p>").endswith("<html><body class='x'><p>new</p></body></html>")
    with pytest.raises(ValueError):
        h.replace_body_of("<p>x</p>", "y")


def test_references_in_plain_text():
    """A reference without its semicolon, or of no known name, is text as it stands, at the end of a page too."""
    assert h.plain_text_of("<p>a &amp b &am</p><p>&ampx; &lt;&#60;&#x3C; &amp;lt; &#60 &; & &copy;x&copyx</p>") == "a &amp b &am\n&ampx; <<< &lt; &#60 &; & \u00a9x&copyx\n"
    assert [h.plain_text_of(x) for x in ("<p>a&amp", "<p>a&", "<p>a&#6", "<p>a\x1a&amp;\n&lt;b")] == ["a&amp\n", "a&\n", "a&#6\n", "a\x1a&\n<b\n"]
    assert h.visible_text_of("<p>a&amp b&amp;</p>") == "\na&amp b&\n"


def test_references_in_headings(spark):
    heading = lambda x: one(spark, x=x).select(h.first_heading(F.col("x")).alias("a")).first()["a"]
    assert heading("<body><h1>te&&am</h1></body>") == "te&&am" and heading("<body><h2>a &amp</h2><p>b</p>") == "a &amp"
    assert heading("<h1> </h1><h2>a&nbsp;&amp;&#160;b</h2>") == "a & b"


def test_deep_pages():
    """Elements that are left open nest without a limit."""
    page = "<body>" + "<p><b>x<br>" * 3000 + "<h1>a</h1><h2> b</h2></body>"
    assert h.first_heading_of(page) == "a" and h.plain_text_of(page) == "x\n" * 3000 + "a\n b\n"
    assert h.visible_text_of("<b>" * 3000 + "<p>a</p>") == "\na\n" and h.block_fragments_of("<b>" * 3000 + "<p>a</p>") == ["<p>a</p>"]


def test_tree_columns(spark):
    row = one(spark, x=PAGE).select(h.plain_text(F.col("x")).alias("a"), F.lit(h.plain_text_of(PAGE)).alias("b"), h.tag_names(F.col("x")).alias("t"), h.count_blocks(F.col("x")).alias("n")).first()
    assert row["a"] == row["b"]
    assert set(row["t"]) == {"title", "h1", "div", "p", "em", "br", "ul", "li", "script"}
    assert row["n"] == 3


@pytest.mark.parametrize(
    "heading, role",
    [
        ("Chapter One", "chapter 1"), ("CHAPTER TWENTY-ONE", "chapter 21"), ("Глава сороковая", "chapter 40"), ("Глава двадцать первая", "chapter 21"),
        ("Chapter 400", "chapter 40"), ("Chapter 41", "other"), ("Chapter 7", "chapter 7"), ("Chapter oneself", "other"), ("Dramatis Personae", "dramatis"),
        ("Действующие лица", "dramatis"), ("Prominent vessels", "vessels"), ("It is the 41st Millennium", "legend"), ("Epilogue", "epilogue"), ("ПРИЛОЖЕНИЕ", "appendix"),
        ("About the author", "author"), ("Random title", "other"), (None, "other"),
    ],
)
def test_roles(spark, heading, role):
    assert value(spark, roles.classify_role(F.col("h"), F.col("t")), h=heading, t="Some text") == role


@pytest.mark.parametrize(
    "source, content, finish, reason",
    [
        ("<p>a</p>", "  ", "stop", "empty"), ("<p>a</p>", "<p>б</p>", "LENGTH", "truncated"), ("<p>a</p>", "б", "stop", "no source tags"),
        ("<p>a</p><p>b</p><p>c</p><p>d</p>", "<p>абвг</p>", "stop", "dropped blocks"), ("<p>a</p>", "<p>б</p>", "stop", None),
    ],
)
def test_structure(spark, source, content, finish, reason):
    got = value(spark, validate.validate(F.col("s"), F.col("c"), F.col("f")), s=source, c=content, f=finish)
    assert (got["reason"], got["is_valid"]) == (reason, reason is None)


def test_english():
    assert validate.english_check("<p>Он был the вчера</p>") == (None, ['English function word: the; context: "Он был the вчера"'])
    assert validate.english_check("<p>Слово the quick fox</p>")[0].startswith("English function word: the; context:")
    assert validate.english_check("<p>a_start Name Surname</p>") == (None, [])
    assert validate.english_check("<p>the</p><p>of</p><p>and</p><p>was</p>")[1][2:] == ['English function word: and; context: "and"']
    assert validate.english_check("<p>010101010 the and of</p>") == (None, [])
    assert validate.english_check("<p>of</p><p>he and the rest</p>")[0] is not None
