"""Rendering of pages: expected layouts, and that no visible word is lost."""

import re
from html import unescape

import pytest

from conftest import SMALL
from millrun.llm import html, queries

CASES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>one<p>two": "one\n\ntwo",
    "<h1>A  b</h1>text<br>more<div>x</div><div>y</div>": "A b\n\ntext\nmore\nx\ny",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>":
        "- a\n- b\n  3. c\n  4. d\n- e",
    "<table><caption>T</caption><tr><th>name<th>n<tr><td>apple<td>3<tr><td>fig</table>":
        "T\nname   n\napple  3\nfig",
    "<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>": "ab     c\nd   e  f",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in  out",
    "<pre>  x\n   y</pre>": "  x\n   y",
    "<head><title>no</title><style>p{}</style></head>yes<script>var t='</p>'</script>!": "yes!",
    "<p hidden>no</p><span style='x:y; display : none'>no</span>yes": "yes",
    "<p class=hidden-x>yes</p><input hidden><b data-hidden=1>too</b>": "yes\n\ntoo",
    "a<!-- no -->b<!-- never ends": "ab",
    "a < b <i>c</i> <unclosed": "a < b c <unclosed",
    "<a title=\"x>y\">z</a>": "z",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "x<hr>y": "x\n\n---\n\ny",
    "</p></b>ok</td>": "ok",
    "<script>x": "",
    "<b><p>in bold</b> after": "in bold after",
}


@pytest.mark.parametrize("page", list(CASES))
def test_layout(page):
    assert html.render(page) == CASES[page]


def test_deep_and_long_pages():
    assert html.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.render("<b>" * 5000 + "x" + "</i>" * 5000) == "x"
    assert html.render("<" * 20000) == "<" * 20000
    assert html.render("<a " * 3000).startswith("<a <a")
    assert len(html.render("<p>word " * 50000)) == 50000 * 6 - 2


def test_whole_table_keeps_every_visible_word(spark):
    pages = {r["page_id"]: r["html"] for r in
             spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op6_html_text(spark, SMALL).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", page)
        words = unescape(re.sub(r"<[^>]*>", " ", body)).split()
        text = got[i]["text"]
        rendered = [w for line in text.split("\n") for w in re.sub(r"^- ", "", line).split()]
        assert rendered == words
        assert got[i]["n_chars"] == len(text) and got[i]["n_lines"] == len(text.split("\n"))


def test_awkward_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "<p>x"), (3, "a\x00b"), (4, "<td>cell")]
    df = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr(
        "*", "'x' as text", "1 as id", "2 as n_chars")
    got = sorted((str(r["page_id"]), r["text"]) for r in html.extract_text(df).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("3", "a�b"), ("4", "cell"), ("None", "x")]
    assert html.extract_text(df.limit(0)).count() == 0


SEEN = {
    '<p title="a hidden gem">yes</p>': "yes",
    '<div class="hidden md:block">yes</div>': "yes",
    '<a href="/hidden/path">yes</a> <a href=/hidden/>too</a>': "yes too",
    '<p style="overflow: hidden !important">yes</p>': "yes",
    '<p data-style="display:none">yes</p>': "yes",
    '<p style="display:none;display:block">yes</p>': "yes",
    "<p style=\"background:url('x;display:none')\">yes</p>": "yes",
    '<p HIDDEN="">no</p><p class=x hidden>no</p><b style=display:none>no</b>yes': "yes",
    '<p style="display:none !important;display:block">no</p>yes': "yes",
    "<p style='VISIBILITY:hidden'>no</p>yes": "yes",
    "<table>a <b>b</b><tr><td>c<td>d</tr>e<tbody>f<tr><td>g</table>": "a b\ne\nf\nc  d\ng",
    "<table><colgroup><col>a<tr><td>b</table>": "a\nb",
    "<table><tr><td data-colspan=2>ab<td>c<tr><td>d<td>e</table>": "ab  c\nd   e",
}


SEEN |= {
    # visibility is inherited and can be set back
    "<div style='visibility:hidden'>no<p style='visibility:visible'>yes <b>too</b></p>no</div>":
        "yes too",
    "<div style='visibility:collapse'>no<div style='visibility:inherit'>no</div></div>yes": "yes",
    "<div style='visibility:hidden'><p style='display:none;visibility:visible'>no</p></div>yes":
        "yes",
    "<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>": "- yes",
    "<div style='visibility:hidden'><hr></div>yes": "yes",
    "<table><tr><td style='visibility:hidden'>no<td>a<tr><td>bb<td>c</table>": "    a\nbb  c",
    # closed and open widgets
    "<details><summary>more</summary><p>no</p>no</details>yes": "more\nyes",
    "<details open><summary>more</summary>yes</details>": "more\nyes",
    "<details>no<b>no</b></details>yes": "yes",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    # numbers of items
    "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
    "<ol reversed><li>a<li>b<li>c</ol>": "3. a\n2. b\n1. c",
    "<ol start=9 reversed><li>a<li>b</ol>": "9. a\n8. b",
    "<ul><li value=7>a</ul>": "- a",
    # cells over several rows
    "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A  b\n   c",
    "<table><tr><td>a<td rowspan=3>B<td>c<tr><td>d<td>e<tr><td>f<td>g</table>":
        "a  B  c\nd     e\nf     g",
    "<table><tr><td rowspan=2 colspan=2>AA<td>b<tr><td>c<tr><td>d<td>e<td>f</table>":
        "AA     b\n       c\nd   e  f",
    "<table><tbody><tr><td rowspan=5>A<td>b<tbody><tr><td>c<td>d</table>": "A  b\nc  d",
    "<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>": "A  b\n   c\n   d",
    "<table><tr><td>a<td>b<td rowspan=2>C<tr><td>d<tr><td>e<td>f<td>g</table>":
        "a  b  C\nd\ne  f  g",
}


@pytest.mark.parametrize("page", list(SEEN))
def test_all_that_is_seen_and_nothing_else(page):
    assert html.render(page) == SEEN[page]


@pytest.mark.parametrize("depth", [200, 3000])
def test_depth_changes_no_layout(depth):
    for inner in ("x<p hidden>no</p><ul><li>a<li>b</ul>", "<table><tr><td>a<td>b</table>c",
                  "<pre>  a\n b</pre>", "<ol start=4><li>a</ol>"):
        for tag in ("div", "b", "section"):
            page = f"<{tag}>" * depth + inner + f"</{tag}>" * depth + "<p>end"
            assert html.render(page) == html.render(f"<div>{inner}</div><p>end")
    lists = html.render("<ul><li>" * 200 + "a<br>b" + "</ul>" * 200)
    assert lists == "- " * 200 + "a\n" + "  " * 200 + "b"
    tables = html.render("<table><tr><td>" * depth + "a<td>b" + "</table>" * depth)
    assert tables == "a  b"
    assert html.render("<pre>" + "<i>" * depth + "a") == "a"
