import base64
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from modlytics.llm import html, warc
from modlytics.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, key int, value int"
PAGES = [
    (1, "http://a/1", "<p>é one</p>\r\n\r\nWARC/1.1\r\n"),
    (2, "http://a/2", "<p>é one</p>\r\n\r\nWARC/1.1\r\n"),
    (3, "http://a/\r\n3", None),
    (4, None, ""),
    (4, None, ""),
    (None, "http://a/n", "only"),
    (5, "http://a/5", "x" * 300_000),
    (6, "http://a/6", "only"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in PAGES], SCHEMA).repartition(3)


def name_of(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archived(spark, pages, **options):
    path = scratch_path(spark, "test-archive")
    warc.write_archive(pages, path, **options)
    return path


def test_records_come_back(spark, pages):
    rows = warc.read_archive(spark, archived(spark, pages)).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in rows if r["page_id"]) == sorted(
        [
            (1, "revisit", 26, name_of(PAGES[0][2]), 2),
            (2, "response", 26, name_of(PAGES[0][2]), None),
            (3, "revisit", 0, name_of(""), 4),
            (4, "response", 0, name_of(""), None),
            (4, "revisit", 0, name_of(""), 4),
            (5, "response", 300_000, name_of("x" * 300_000), None),
            (6, "response", 4, name_of("only"), None),
        ],
        key=str,
    ) or len(rows) == 8
    payloads = {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert payloads == {2: PAGES[0][2], 4: "", 5: "x" * 300_000, 6: "only"}
    (nameless,) = [r for r in rows if r["page_id"] is None]
    assert (nameless["record_type"], nameless["refers_to"], nameless["url"]) == ("revisit", 6, "http://a/n")
    assert {r["url"] for r in rows if r["page_id"] == 3} == {"http://a/ 3"}
    assert len({r["record_id"] for r in rows}) == 8


def test_small_payloads_are_all_responses(spark, pages):
    rows = warc.read_archive(spark, archived(spark, pages, min_bytes=10)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in rows if r["record_type"] == "revisit") == [(1, "revisit")]


def test_filters_are_pushed_and_payloads_skipped(spark, pages):
    found = warc.read_archive(spark, archived(spark, pages), "record_type STRING, page_id BIGINT").filter("record_type = 'revisit'")
    assert found.filter("page_id in (1, 3)").count() == 2
    schema = warc.read_archive(spark, "unused").schema
    reader = warc.WarcReader({"path": "unused"}, schema)
    asked = [warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), "x"), warc.In(("page_id",), (1, 2))]
    assert list(reader.pushFilters(asked)) == asked[1:2]
    assert reader.wanted == [("record_type", ("revisit",)), ("page_id", (1, 2))]


def test_a_damaged_payload_is_seen(spark, pages):
    path = scratch_path(spark, "test-damaged")
    damaged = warc.records(pages).select(F.replace("value", F.lit("xxx"), F.lit("xyx")).alias("value"))
    damaged.write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="has the digest"):
        warc.read_archive(spark, path).collect()


def test_empty_archive(spark, pages):
    assert warc.read_archive(spark, archived(spark, pages.limit(0))).count() == 0


# --- HTML ---


@pytest.fixture(scope="module")
def model():
    hidden = frozenset(["article", "main"])
    return html.train([(html._frames(html.parse(s)), html.SKELETON_COUNT, h) for s in html.SKELETONS for h in (frozenset(), hidden)])


FURNITURE = (
    "<body><header><a>x</a><h2>Site</h2></header><div class='cookie-banner'><p>We use cookies to improve your experience here.</p></div>"
    "<nav><ul><li><a href=1>Home</a></li></ul></nav>%s<div class=sidebar><p>Sidebar text that is long enough to look like content.</p></div>"
    "<section id=comments><div class=comment><p>I am a reader comment and quite long, too.</p></div></section><footer><p>Footer text &copy; 2020.</p></footer></body>"
)
ARTICLE = (
    "<article><h1>T &amp; U</h1><p>Real   text\nof the <b>art</b>icle goes here, rather long &lt;b&gt;.<br>Next<aside><p>Related: see another article of ours.</p></aside>"
    "<div class=ad>Buy now something good</div><form><input><button>Go</button></form><p>End of text.</p><script>var x='</p>'</script><!-- no --></article>"
)
TEXT = "T & U Real text of the article goes here, rather long <b>. Next End of text."


def test_article_without_furniture(model):
    assert html.main_text(FURNITURE % ARTICLE, model) == TEXT


def test_article_without_its_tag(model):
    bare = ARTICLE.replace("<article>", "<div class=content>").replace("</article>", "</div>")
    assert html.main_text(FURNITURE % bare, model) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &eacute; only\n\t text", "plain é only text"),
        ("a < b & c", "a < b & c"),
        ("<p>unclosed <b>x", "unclosed x"),
        ("<div><p>One.<p>Two.</div>", "One. Two."),
        ("<script>never closed", ""),
        ("<!-- open", ""),
        ("<" * 1000, "<" * 1000),
        ("<div>" * 5 + "deep text of the page" + "</div>" * 5, "deep text of the page"),
        ("<body><dl><dt>Term</dt><dd>Meaning of it.</dd></dl></body>", "Term Meaning of it."),
        ("<div data-x=it's>Text isn't lost</div><p>More text here.</p>", "Text isn't lost More text here."),
        ("<p title='a > b' x=\"c>d\" y = 'e>'>Text with <b class=q\">quotes</b> in tags.</p>", "Text with quotes in tags."),
        ("<article><p>One text</p><noscript>Image of a thing</noscript></article>", "One text Image of a thing"),
        ("<article><p>a\x00b and more of it</p></article>", "a\x00b and more of it"),
        ("<body><nav><a>Home</a> <a>News</a></nav><footer>Imprint of it</footer></body>", ""),
    ],
)
def test_odd_pages(model, page, text):
    assert html.main_text(page, model) == text


@pytest.mark.parametrize(
    "page, blocks",
    [
        ('<p>A <svg class="i"/> b</p><p>rest of page</p>', ["A b", "rest of page"]),
        ("<p>A<svg/>b</p><p>c</p><svg><text>no</text></svg><p>d</p>", ["Ab", "c", "d"]),
        ("<p>A <svg title='a/>b' href=/x/y />b <svg title='a/>b'><path d='x'/>no</svg>c</p>", ["A b c"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><p>A<math/>b</p><p>c</p>", ["Let x=1 hold.", "Ab", "c"]),
        ("<SVG/><p>A</p><svg\n/><p>b</p><svgx>c</svgx>", ["A", "b", "c"]),
    ],
)
def test_drawings_and_formulas(page, blocks):
    assert html.parse(page).blocks == blocks


def test_deep_and_long_pages(model):
    assert html.main_text("<div>" * 3000 + "deep text of the page" + "</div>" * 3000, model) == "deep text of the page"
    inside = "<div>" * 3000 + "<p>A paragraph with some words.</p>" + "</div>" * 3000
    assert html.main_text(f"<article>{inside}</article>", model) == "A paragraph with some words."
    assert html.main_text(FURNITURE % f"<article>{inside}</article>", model) == "A paragraph with some words."
    began = time.process_time()
    assert html.main_text("<div>" * 50_000 + "deep text of the page" + "</div>" * 50_000, model) == "deep text of the page"
    html.main_text("<p><button>" + "<div>" * 20_000 + "x" + "</div>" * 20_000, model)
    html.main_text("<ul><li>" * 10_000 + "x", model)
    assert time.process_time() - began < 10
    assert len(html.main_text("<div><p>A text of some length here.</p></div>" * 2000, model)) == 2000 * 28 - 1


def test_marginals_as_by_enumeration(model):
    """Sum-product on a small tree against the sum over all states."""
    from itertools import product

    import numpy as np

    page = html.parse("<div><p>A text that is long enough.</p><ul class=menu><li><a>x</a></li></ul></div>")
    sums, weights = html._subtrees(page), {}
    for states in product(range(3), repeat=len(page.nodes)):
        w = np.log(model.prior[states[0]])
        for i, node in enumerate(page.nodes):
            w += sum(model.emitted[e][states[i]] for e in html.emissions(node, *sums[i]) if e in model.emitted)
            if i:
                w += np.log(model.passed[states[node.parent]][states[i]])
        weights[states] = np.exp(w)
    total = sum(weights.values())
    for i, got in enumerate(html.marginals(page, model)):
        assert got == pytest.approx(sum(w for s, w in weights.items() if s[i] == html.CONTENT) / total)


def test_extraction_over_a_table(spark, pages, small):
    assert html.extracted(pages).count() == len(PAGES)
    assert html.extracted(pages.limit(0)).count() == 0
    given = spark.read.parquet(f"{small}/pages.parquet")
    inside = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    rows = given.join(html.extracted(given).select("page_id", "text"), "page_id").select("text", inside.alias("inside")).collect()
    for r in rows:
        assert r["text"].replace(" ", "") == html.unescape(r["inside"]).replace(" ", "").replace("\n", "")
