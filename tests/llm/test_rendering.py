"""Rendering of pages: single cases, and generated pages against a second renderer on Python's own HTML parser."""

import random
import re
from html.parser import HTMLParser

import pytest

from parallax.llm import render

PAGE = (
    "<html><head><title>no</title><style>p{}</style></head><body><h1>A &amp; B</h1><p>one<p>two <b>three</b><br>four"
    "<ul><li>x<li>y<ol start=3><li>z</ol></ul><div hidden>no</div><span style='display: none'>no</span>"
    "<table><tr><th>k<th>value<tr><td>long key<td>1</table><pre>a\n  b</pre><!-- no --><script>var a='</p>';</script>end"
)
CASES = [
    (PAGE, "A & B\n\none\n\ntwo three\nfour\n\n- x\n- y\n  3. z\n\nk         value\nlong key  1\n\na\n  b\n\nend"),
    (None, None), ("", ""), ("<p", ""), ("a</>b</ x>c", "abc"), ("x<!-", "x"),
    ("<p class=it's>hello world</p><p>don't go</p>tail", "hello world\n\ndon't go\n\ntail"),
    ("<!-->shown<p>text</p>", "shown\n\ntext"), ("<!--->a<!-- > -->b<!-- x --!>c<!-- open", "abc"),
    ("<a title='x>y'>in</a>", "in"), ("<b \"q>t", "t"), ("<textarea>\n<p>ta</textarea>b", "<p>ta\nb"),
    ('<table><tr><td colspan="²">a<td>b</table>', "a  b"), (f"<table><tr><td colspan={'9' * 5000}>x<td>y</table>", "x  y"),
    ('<ol start="²"><li>x</ol>', "1. x"), ("<ol start=--5><li>x</ol>", "1. x"), ("<ol start=-5><li>x<li>y</ol>", "-5. x\n-4. y"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<div>" * 5000 + "<span hidden>SECRET</span>deep", "deep"), ("<ul><li>" * 300 + "x", "  " * render.INDENT + "- x"),
    ("<table><tr><td>" * 500 + "deep", "deep"),
    ("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>dddd<td>e</table>", "aa    b\n      c\ndddd  e"),
    ("<table><tr><td colspan=2>a long one<tr><td>x<td>y</table>", "a long one\nx  y"),
    ("<table><tr><td><p>a</p><p>b</p></td><td><pre>x\n\ny</pre></td></table>", "a  x\n\nb  y"),
    ("<table><tr><td colspan=2>a long heading cell</td><td>R</td><tr><td>1<td>2<td>3</table>", "a long heading cell  R\n1  2                 3"),
    ("<table><tr><td colspan=3>wide cell here<td>e<tr><td colspan=2>two<td>c<td>d</table>", "wide cell here  e\ntwo  c          d"),
    ("<table><tr><td>a<tr><td><tr><td>b</table>", "a\nb"), ("<table><tr><td>a<br><br>c<td>d<br><br><br>e</table>after", "a  d\n\nc\n   e\n\nafter"),
    ("<ol start=12345678901><li>x<li>y</ol>", "12345678901. x\n12345678902. y"), (f"<ol start={'7' * 9000}><li>x</ol>", f"{10**18}. x"),
    ("<style>.h{display:none}</style><p class=h>no</p><p class='a h'>no</p>yes", "yes"),
    ("<style>/* p{display:none} */ #x, b.c , i { color:red; Display : NONE }</style><p id=x>no</p><b>y</b><b class=c>no</b><i>no</i>", "y"),
    ("<style>p{display:none} p.k{display:block} #z{visibility:hidden}</style><p>no<p class=k>yes<p class=k id=z>no<b style='visibility:visible'>in</b>", "yes\n\nin"),
    ("<style>@media print{p{display:none}} @media screen { b { display: none } }</style><p>yes <b>no</b>", "yes"),
    ("<style media=print>p{display:none}</style><style>u{display:none!important} u{display:inline}</style><p>yes<u style='display:inline'>no</u><u style='display:inline!important'>in</u>", "yesin"),
    ("<style>div > p{display:none} p:hover{display:none} {display:none} *{} @x</style><div><p>yes", "yes"), ("<style>p{display:none</style><p>yes", "yes"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<details>a<summary>s</summary>b</details><details open><summary>t</summary>in</details>", "s\nt\nin"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
    ("<div hidden style='display:block'>yes</div><p style='xdisplay:none'>too</p><i style='color:red;DISPLAY:None !important'>no</i>", "yes\n\ntoo"),
    ("<svg><title>no</title><text>drawn</text></svg> <math><mi>m</mi><annotation>no</annotation></math>", "drawn m"),
    ("<select><optgroup label=g><option>o1<option>o2</select><input value=v><input type=hidden value=no>", "g\no1\no2\nv"),
    ("<head>text<p>more", "text\n\nmore"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<img alt='a &lt; b'> c", "a < b c"), ("<p>İ<script>x</script>after", "İafter"), ("<div title=a title=b hidden=x>no</div>y", "y"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_case(page, text):
    assert render.render(page) == text


def test_text_outside_of_cells_stays():
    page = (
        "<table>bare<tbody>body<tr><form><td>a</td><td>b</td></form></tr><tr><p>para</p><td>c</td>between<td>d</td></tr>"
        "<tr><form><div hidden><td>no</td></div><span><td>e</td>in</span></form></tr><img alt=pic></tbody></table>end"
    )
    got = render.render(page)
    assert "no" not in got
    for word in "bare body para between in pic".split():
        assert word in got and got.index(word) < got.index("a  b")
    assert "a  b\nc  d\ne" in got and got.endswith("end")


class Second(HTMLParser):
    """Visible words of well-formed pages in the order of the page, with a mark where a block begins or ends."""

    def __init__(self, page):
        super().__init__()
        self.shown, self.out = [True], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        gone = tag in ("script", "style", "template") or any(k == "hidden" or (k == "style" and "none" in v) for k, v in attrs)
        if tag not in ("br", "hr"):
            self.shown.append(self.shown[-1] and not gone)
        if self.shown[-1] and tag in ("div", "p", "li", "br", "hr", "h2", "ul", "section", "pre"):
            self.out.append("|")

    def handle_endtag(self, tag):
        if self.shown.pop() and tag in ("div", "p", "li", "h2", "ul", "section", "pre"):
            self.out.append("|")

    def handle_data(self, data):
        if self.shown[-1]:
            self.out += [w for w in data.split() if w]


def generated(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "div", "p", "b", "ul", "br", "hr", "h2", "section", "script", "hidden", "comment", "span"])
        word = lambda: "".join(rng.choice("abcdeé&") for _ in range(rng.randint(1, 5))).replace("&", "&amp;")
        if kind == "text" or depth > 5:
            out.append(" ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", "\n"]))
        elif kind in ("br", "hr"):
            out.append(f"<{kind}>")
        elif kind == "comment":
            out.append("<!-- " + word() + " -->")
        elif kind == "script":
            out.append("<script>if (a<b) { '</p>' }</script>")
        elif kind == "hidden":
            out.append(rng.choice(["<div hidden>", "<div style='display:none'>"]) + generated(rng, depth + 1) + "</div>")
        elif kind == "ul":
            out.append("<ul>" + "".join("<li>" + generated(rng, depth + 1) + "</li>" for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind in ("p", "h2"):
            out.append(f"<{kind}>" + " ".join(word() for _ in range(3)) + f"</{kind}>")
        else:
            out.append(f"<{kind}>" + generated(rng, depth + 1) + f"</{kind}>")
    return "".join(out)


def test_generated_pages_match_a_second_renderer():
    rng = random.Random(11)
    for _ in range(400):
        page = generated(rng)
        want = [line.split() for line in " ".join(Second(page).out).split("|")]
        got = [re.sub(r"^\s*- ", "", line).split() for line in render.render(page).split("\n")]
        assert [w for w in got if w] == [w for w in want if w], page


def test_generated_tables_are_aligned():
    rng = random.Random(12)
    for _ in range(100):
        cells = [["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(4)] for _ in range(5)]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>"
        widths = [max(len(r[k]) for r in cells) for k in range(4)]
        assert render.render(page) == "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def test_frames(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, None, None), (None, "", "y")], "page_id long, html string, visible_text string")
    out = render.visible_text(pages)
    assert out.columns == ["page_id", "html", "visible_text"]
    assert sorted(((r[0], r[2]) for r in out.collect()), key=str) == [(1, "a"), (1, None), (None, "")]
    assert render.visible_text(pages.limit(0)).count() == 0


def test_generated_tables_with_blocks_and_spans():
    """Whole lines against a plain layout: blank lines in cells, and places after spans of columns."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    for _ in range(200):
        rows = []
        for _ in range(rng.randint(1, 4)):
            row, at = [], 0
            while at < 4:
                across = min(rng.choice([1, 1, 1, 2, 3]), 4 - at)
                row.append((at, across, [word(6 * across) for _ in range(rng.randint(1, 3))]))
                at += across
            rows.append(row)
        rows.append([(k, 1, [word(4)]) for k in range(4)])  # every column has a cell of its own
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a}>" + "".join(f"<p>{w}</p>" for w in ws) + "</td>" for _, a, ws in r) + "</tr>" for r in rows) + "</table>"
        widths = [max(len(w) for r in rows for k, a, ws in r if k == c and a == 1 for w in ws) for c in range(4)]
        for span in (2, 3):
            for k in range(4):
                for r in rows:
                    for c, a, ws in r:
                        if c == k and a == span:
                            widths[k + a - 1] += max(0, max(map(len, ws)) - sum(widths[k : k + a]) - 2 * (a - 1))
        want = []
        for r in rows:
            lines = [[line for w in ws for line in (w, "")][:-1] for *_, ws in r]
            for i in range(max(map(len, lines))):
                text = ""
                for (k, *_), cell in zip(r, lines, strict=True):
                    if i < len(cell) and cell[i]:
                        text = text.ljust(sum(widths[:k]) + 2 * k) + cell[i]
                want.append(text)
        assert render.render(page) == "\n".join(want), page
