"""Layout of small pages, and that no visible word is lost."""

import re
import time
from html.parser import HTMLParser

import pytest

from joulewright.llm.html_text import extract_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a <b> b </b>c\n d", "a b c d"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name       Qty\nApple pie  3"),
    ("<table><td>a<td>b<tr><td colspan=2>wide<td>x</table>", "a     b\nwide     x"),
    ("<table>stray<tr><td>in</table>out", "stray\n\nin\n\nout"),
    ("<table><caption>Cap</caption><tbody><tr><td>1<br>2<td>3</table>", "Cap\n1  3\n2"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<head><title>T</title></head><body>b", "b"),
    ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- no -->y<template>n</template>", "xy"),
    ("<div hidden>n</div><p style='display: none'>n</p><i style=visibility:hidden>n<u style='visibility:visible'>y</u></i>", "y"),
    ("<style>.ad, #z {display:none} p b{display:none}</style><p class='x ad'>n</p><p id=z>n</p><p>y <b>k</b>", "y k"),
    ("<input value=n><select><option>a<option>b</select>", "a\nb"),
    ("&lt;p&gt; &amp;amp; &nbsp;&copy; &#233;", "<p> &amp;  © é"),
    ("a</p>b</div>c", "a\n\nb\n\nc".replace("b\n\nc", "bc")),
    ("<p title='a>b'>x</p><a href=\"unclosed>y", "x\n\n<a href=\"unclosed>y"),
    ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert render(page) == text


DRAWN = [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
    ("<math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math>", "y"),
    ("a<svg>n<title>n</title><desc>n</desc><defs><text>n</text></defs><g><rect/><text>one <tspan>two</tspan></text><text>three</text></g></svg>b", "a one two three b"),
    ("<svg><text hidden>n</text><foreignObject><p>y</p></foreignObject></svg>", "y"),
    ("<svg/>a<p><svg viewBox='0 0 1 1'><path d=''/></svg>b", "a\n\nb"),
    ("<svg><text>a<p>b</p>c", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize("page,text", DRAWN)
def test_drawings_and_formulas(page, text):
    assert render(page) == text


def test_deep_and_long_pages():
    assert render("<div>" * 5000 + "x").strip() == "x"
    assert render("<ul><li>" * 300 + "x").endswith("x")
    assert len(render("<p>word</p>" * 20000).split()) == 20000
    assert len(render("<table>" + "<tr><td>" + "y" * 5000 + "<td>z" + "<tr><td>a<td>b" * 2000 + "</table>")) < 40000


@pytest.mark.parametrize("piece", ["<![CDATA[>", "<p title='", '<a "', "<a b='\"", "<!-", "<!--", "</", "<style>", "<title", "<b>", "</i>", "<p><b>", "<td>x", "&amp", "<a b=c d", "<x" + " " * 50])
def test_long_broken_pages_take_linear_time(piece):
    began = time.process_time()
    render(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 10


def test_cells_longer_than_a_line_are_wrapped_and_stay_aligned():
    words = " ".join(f"word{i}" for i in range(20))
    got = render(f"<table><tr><td>{words}<td>x<tr><td>a<td>y<tr><td>b<td>{words}</table>").split("\n")
    assert got[0].index("  x") + 2 == got[-2].index("y") == got[-1].index("word0")
    assert " ".join(x.replace("  x", "") for x in got[:-2]).split() == words.split() and got[-1].endswith(words)


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_visible_letter_is_lost_or_added(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        p = Words()
        p.feed(r.html)
        p.close()
        letters = lambda s: re.sub(r"[\s\xa0]+|^- ", "", s)
        mine = "\n".join(re.sub(r"^- ", "", x) for x in got[r.page_id].text.split("\n"))
        assert letters(mine) == letters("".join(p.out)), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_operator_on_nulls(spark):
    df = spark.createDataFrame([(1, None, "t"), (None, "<p>a", "t"), (1, None, "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract_text(df).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert extract_text(df.limit(0)).count() == 0


def test_what_hides_deep_elements_hides_them():
    for deep in (20, 509, 511, 512, 520, 3000):
        for wrap in ("<div>", "<ul><li>", "<b>", "<table><tr><td>"):
            for hidden in ("<div hidden>SECRET</div>", '<div style="display:none"><p>SECRET<b>SECRET</b></div>', '<i class="x">SECRET</i>', "<div hidden><div>SECRET</div><span>SECRET</span></div>", "<xyz>SECRET</xyz>"):
                page = "<style>.x, xyz {display: none}</style>" + wrap * deep + "before " + hidden + " after"
                got = render(page)
                assert "SECRET" not in got and "before" in got and "after" in got, (deep, wrap, hidden)
    assert render("<div>" * 600 + "<div style='visibility:hidden'>a<div style='visibility:visible'>b</div></div>c") == "b\nc"


def test_deep_pages_take_linear_time():

    n = 16000
    for page in ("<div><b>" * n + "x", "<div class=a>" * n + "x" + "</div>" * n, "<ul><li>x" * n, "<p><table><tr><td>x" * n, "<b>x</i>" * n, "<div a><span b>x</div>" * n, "<p>x" * n + "<p><div>" * n):
        t = time.perf_counter()
        assert render(page).count("x") == page.count("x")
        assert time.perf_counter() - t < 5
