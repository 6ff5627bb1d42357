import random

import pytest
from pyspark.sql import functions as F

from tarnfield.functions import extract, html, rules, text
from tarnfield.functions.vocabulary import Alias, vendor_terms
from tarnfield.operators import chunks, pages, toc


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


@pytest.mark.parametrize(
    ("title", "kind"),
    [("Example of a Chart", "example"), ("Launch the Wizard", "launch"), ("Introduction", "overview"), ("String Functions", "reference"), ("Plot Options", "options"), ("Create a Table", "howto"), ("Kriging", "concept"), ("", "concept"), (None, "concept")],
)
def test_page_type(spark, title, kind):
    assert one(spark, title, rules.page_type("x")) == kind


@pytest.mark.parametrize(
    ("question", "kind"),
    [("How do I join two tables?", "how_to"), ("Where is the log?", "where_is_it"), ("What is a quartile?", "what_is"), ("Why is my plot blank?", "troubleshoot"), ("can I automate this", "scripting"), ("", "how_to"), (None, "how_to")],
)
def test_intent(spark, question, kind):
    assert one(spark, question, rules.intent("x")) == kind


def test_routing_and_follow_ups(spark):
    assert one(spark, "Hello!", rules.route("x")) == "chitchat"
    assert one(spark, "hello world", rules.route("x")) == "docs"
    assert one(spark, "and how do I change it later on?", rules.needs_expansion(F.col("x"), F.lit(2))) is True
    assert one(spark, "and how do I change it later on?", rules.needs_expansion(F.col("x"), F.lit(1))) is False
    assert one(spark, "three short words", rules.needs_expansion(F.col("x"), F.lit(1))) is True
    assert one(spark, "Let me think about it", rules.looks_like_query(F.col("x"))) is False
    assert one(spark, "bar chart colours", rules.looks_like_query(F.col("x"))) is True


def test_tokens_fold(spark):
    assert one(spark, "Straße ﬁne x_1 Ü", text.tokens("x")) == ["strasse", "fine", "x_1"]
    assert one(spark, None, text.tokens("x")) == []


def test_image_source(spark):
    for src, want in (("../../a/b%20c+d.png", "a/b c+d.png"), ("\\a\\b.png", "a/b.png"), ("100%", "100%")):
        assert one(spark, src, text.image_src("x")) == want
        assert html.image_source(src) == want


@pytest.mark.parametrize(
    ("prose", "paths"),
    [("Select Graph > Bar by Colour. Then go.", ["Graph > Bar by Colour"]), ("File > Open > and close", ["File > Open"]), ("Edit > lower", []), ("File > New\nFile > New", ["File > New"]), ("Nothing", [])],
)
def test_menu_paths(spark, prose, paths):
    assert one(spark, prose, extract.menu_paths(F.col("x"))) == paths


@pytest.mark.parametrize(("prose", "names"), [("Open the Big Cities.csv and a_b.csv", ["Big Cities.csv", "a_b.csv"]), ("see lower.csv", []), ("1. 3. In Tall Trees.csv", ["Tall Trees.csv"])])
def test_sample_files(spark, prose, names):
    assert one(spark, prose, extract.sample_files(F.col("x"), ".csv")) == names


def test_vocabulary_is_word_bounded_and_ordered(spark):
    aliases = [Alias("a", ("Forest Builder",), ("random forest", "random forests")), Alias("b", ("Table Maker", "Forest Builder"), ("pivot",))]
    rows = spark.createDataFrame([(1, "PIVOT then random forests"), (2, "repivot"), (3, None)], "id int, q string")
    found = {r["id"]: r["vendor_terms"] for r in vendor_terms(rows, "id", F.col("q"), aliases).collect()}
    assert found == {1: ["Table Maker", "Forest Builder"], 2: [], 3: []}


def test_terms_of_a_row_are_distinct_by_fold_in_order_of_appearance(spark):
    aliases = [Alias("a", ("One", "TWO"), ("x", "y z")), Alias("b", ("two", "Three's"), ("x", "z")), Alias("c", (), ("y z q",))]
    rows = spark.createDataFrame([(1, "z X z"), (1, "Y Z, x"), (2, "y z q"), (None, "x")], "id int, q string")
    found = [(r["id"], r["vendor_terms"]) for r in vendor_terms(rows, "id", F.col("q"), aliases).collect()]
    assert found == [(1, ["two", "Three's", "One"]), (1, ["One", "TWO", "Three's"]), (2, []), (None, ["One", "TWO", "Three's"])]
    assert [r["vendor_terms"] for r in vendor_terms(rows, "id", F.col("q"), aliases, 2).collect()][0] == ["two", "Three's"]


PAGE = """<html><head><link rel="Prev" href="a.shtml#x"></head><body>
<div class="ww_skin_breadcrumbs"><a>Guide</a> &gt; <a>Charts</a></div><div class="ww_creation_date">Publication date: 01/02/2020</div>
<div id="page_content"><div class="miniTOC_x">skip</div><h1>Bar <b>Chart</b></h1><p>First <i>line</i><br>more</p>
<p class="Figure_Title"><span class="zmpFigTab">Figure 1</span> A bar</p><p><img src="../img/bar.png" alt="alt"></p>
<p class="code">x = 1;</p><p class="code">y = 2;</p><p class="N2bullet">deep</p><p class="bullet">flat</p><p class="Note">Note: careful</p>
<table><caption>Cap</caption><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>bare<footer>gone</footer></div></body></html>"""


def test_page_record():
    r = html.page_record(PAGE, "book")
    assert (r["title"], r["breadcrumb"], r["published"], r["prev"], r["next"]) == ("Bar **Chart**", ["Guide", "Charts"], "01/02/2020", "book/a.shtml", "")
    assert r["figures"] == [{"figure_id": "Figure 1", "caption": "A bar", "src": "img/bar.png", "alt": "alt"}]
    assert r["markdown"] == (
        "# Bar **Chart**\n\nFirst *line*more\n\n[FIGURE: Figure 1 - A bar]\n\n```code\nx = 1;\ny = 2;\n```\n\n  - deep\n- flat\n\n> **Note:** careful\n\n"
        "**Cap**\n\n| a | b\\|c |\n|---|---|\n| 1 |  |"
    )
    assert r["n_chars"] == len(r["markdown"])


def test_documents_and_menus(spark):
    raw = spark.createDataFrame([("p", PAGE), ("q", None)], "path string, html string")
    found = {r["path"]: r for r in pages.documents(raw).collect()}
    assert found["p"]["book"] == "Guide" and found["q"]["markdown"] == ""
    menu = "<table><caption>Graph Menu</caption><tr><th>Item</th><th>Description</th></tr><tr><td>Bar</td><td>Draws  bars</td></tr><tr><td>x</td></tr></table>"
    got = pages.menus(spark.createDataFrame([(menu, "windows")], "html string, platform string")).collect()
    assert [tuple(r) for r in got] == [("Graph", "Bar", "Graph > Bar", "Draws bars", "windows")]


def test_toc(spark):
    a = lambda href, name: f'<a class="WebWorks_TOC_Link" href="{href}">{name}</a>'
    page = f'<div id="toc:1"><ul><li>{a("b/x.shtml#1", "X")}<ul><li>{a("b/y.shtml", "Y")}</li><li>{a("c/z.shtml", "Z")}</li></ul></li></ul></div>'
    rows = toc.toc_table(spark.createDataFrame([(page,)], "html string"), "b").orderBy("order").collect()
    assert [(r["path"], r["anchor"], r["title"], r["depth"], r["order"], r["is_folder"]) for r in rows] == [("b/x.shtml", "1", "X", 1, 0, True), ("b/y.shtml", "", "Y", 2, 1, False)]


def test_sections_and_packing():
    assert chunks.sections("# A\nx\n### C\ny\n## B\nz") == [("A", "x"), ("A > C", "y"), ("A > B", "z")]
    assert chunks.sections("plain") == [("", "plain")]
    assert chunks.sections("# only") == [("", "# only")]
    text = "\n\n".join(c * 40 for c in "abcdef")
    got = chunks.packed(text, 100, 50)
    assert got == ["\n\n".join(p * 40 for p in pair) for pair in ("ab", "bc", "cd", "de", "ef")]
    fence = "```\n" + "x\n\n" * 60 + "```"
    assert chunks.packed("intro\n\n" + fence, 100, 20) == ["intro", "intro\n\n" + fence]


def test_chunks_inherit(spark):
    raw = spark.createDataFrame([("p", PAGE)], "path string, html string")
    got = chunks.chunks(pages.documents(raw), [Alias("a", ("Bar",), ("column graph",))]).collect()
    assert [r["chunk_id"] for r in got] == ["p#0"]
    assert got[0]["alias_terms"] == ["column graph"] and [f["src"] for f in got[0]["figures"]] == ["img/bar.png"]


def test_plain_pages_parse_as_the_standard_parser_does():
    from tarnfield import catalog

    def standard(page):
        tree = html._Tree()
        tree.feed(page)
        tree.close()
        return tree.root

    written = "".join({"K": "7", "N": "a &lt; b", "T": "T&amp;T &copy &notit; &#65"}.get(x, x) for x in catalog._PAGE_HTML)
    assert html._plain_tree(written).root == standard(written)
    odd = ["", "a", "a & b &amp", "&am", "x &lt", "<P CLASS=\"A&quot;b\" class=\"c\">t</P>", "<p a=\"1\"\n b-c=\"&copy=1\">", "</p>", "<p><p></div><li><li></ul>", "<td>1<td>2<tr>3", "\r\n<b>\x00</b>", "<br><img src=\"a b\">x",
           "<br/>", "<p a=1>", "<p a>", "<!-- c --><b>", "<!DOCTYPE html><p>", "<script>a<b</script>c", "<title>a<b></title>", "a < b", "<p", "<a b=\"c", "<p a=\"1\"b=\"2\">", "<x:y>", "</p >", "<a-b>", "<p \x0ca=\"1\">", "<?x>", "<p a=\"<\">", "é<İ>", "<plaintext>a<b>"]
    rng = random.Random(5)
    for page in [*odd, PAGE, *["".join(rng.choices(odd, k=6)) for _ in range(400)]]:
        assert html.parse(page) == standard(page), page
    assert html.parse(None) == standard("")
