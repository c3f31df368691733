"""Main text of pages: the parser on broken pages, the tree on pages that its table doesn't hold, the query on the whole table."""

import html as references
import re

import pytest

from glossweave.llm.html_blocks import blocks
from glossweave.llm.html_labelled import labelled
from glossweave.llm.html_text import features, op13_html_extraction, page_text, tree, with_main_text

LONG = "The council met on Tuesday evening to discuss the repair of the old stone bridge, which has been closed to traffic since the floods of last spring."
NEXT = "Members agreed that work should begin before winter, although two of them asked for a second survey of the northern arch and its foundations."


def _texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</p> c", ["a b", "c"]), ("a<br>b", ["a b"]), ("<p>x<i>y</i>z</p>", ["xyz"]),
        ("<script>if (a < b) '</p>'</script>x", ["x"]), ("x<script>never ended", ["x"]), ("<style>p{}</STYLE >x", ["x"]), ("<!-- a --> b <!-- c", ["b"]), ("1 < 2 <3", ["1 < 2 <3"]),
        ("a &lt;b&gt; &#8364; &nbsp; c&copy;", ["a <b> € c©"]), ('<p title="a > b">c</p>', ["c"]), ('<p title="never ended>c</p><p>d', ["c", "d"]), ("<p>a<", ["a<"]), ("<p>a<b", ["a"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("</div></p>a</span>b", ["ab"]), ("<div hidden>a</div><p style='display: none'>b</p>c", ["c"]),
        ("<title>t</title><h1>a<h2>b", ["a", "b"]), ("<p>a<select><option>b<option>c</select>d", ["a", "d"]), ("<textarea><p>x</textarea>y", ["y"]), ("<?php echo 1 ?>a<!doctype html>b", ["ab"]), ("<P>A</P>\n\t<P>B   C", ["A", "B C"]),
    ],
)
def test_blocks(page, want):
    assert _texts(page) == want


def test_links_and_places():
    page = '<nav><a>one two</a> three</nav><article><p>x</p><aside>y</aside><section class="post-comments"><article>z</article></section></article><div class="content"><div class="adSlot">w</div>v</div>'
    assert [(b.text, b.linked, b.zone) for b in blocks(page)] == [("one two three", 2, -2), ("x", 0, 2), ("y", 0, -2), ("z", 0, -2), ("w", 0, -1), ("v", 0, 1)]
    assert [(b.text, b.linked) for b in blocks("<p><a>a<p>b <a>c<a>d</a> e")] == [("a", 1), ("b cd e", 2)]


PAGES = {
    "elements": (f"<header><p>Daily News of the Valley</p></header><nav><a>Home</a><a>Sport</a></nav><main><h1>Bridge</h1><p>{LONG}</p><p>Yes.</p></main><aside>{NEXT}</aside><footer>{NEXT}</footer>", f"Bridge {LONG} Yes."),
    "classes": (f'<div class="mainMenu"><a>Home</a></div><div id="cookieBar">{NEXT}</div><div class="entry-content"><p>{LONG}</p><p>{NEXT}</p><div class="adsbygoogle">Buy now</div></div><div class="page-footer">All rights reserved</div>', f"{LONG} {NEXT}"),
    "bare": (f"<div><a>Home</a> <a>News</a> <a>Sport</a></div><p>{LONG}</p><p>{NEXT}</p><p>{LONG}</p><div><a>More news from here</a></div><div><a>Contact</a></div>", f"{LONG} {NEXT} {LONG}"),
    "comments": (f'<article><h2>Bridge</h2><p>{LONG}</p></article><div id="comments"><h3>2 comments</h3><div class="comment"><p>{NEXT}</p></div></div>', f"Bridge {LONG}"),
    "form": (f'<article><p>{LONG}</p></article><form class="newsletter"><p>{NEXT}</p><input><button>Send</button></form>', LONG),
    "unclosed": (f'<div class="ad">Buy<article><p>{LONG}<p>Ok<b>ay<p>{NEXT}', f"{LONG} Okay {NEXT}"),
    "nothing": ('<nav><a>Home</a></nav><div class="notice">We use cookies</div><footer>2020</footer>', ""),
    "links": ("<ul><li><a>Home</a></li><li><a>Sport</a></li></ul>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_not_in_the_table(name):
    page, want = PAGES[name]
    assert page_text(page) == want


def test_tree_fits_its_table():
    met = [(k, own) for page in labelled() if page for k, (_, own) in zip(tree()(features([b for b, _ in page])), page, strict=True)]
    assert sum(a == b for a, b in met) >= 0.97 * len(met)


def test_long_and_odd_pages():
    many = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert page_text(many).count("word") == 50_000
    assert page_text("<div>" * 3000 + "x" + '<a "' * 2000).startswith("") and page_text(None) == ""
    assert len(page_text(f"<article><p>{'x' * 1_000_000}</article>")) == 1_000_000


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "old", 1), (None, "", "old", 2), (3, f"<p>{LONG}</p>", "old", 3), (3, f"<p>{LONG}</p>", "old", 3)], "page_id long, html string, text string, n_chars int")
    out = with_main_text(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "", 2), (1, "", 1), (3, LONG, 3), (3, LONG, 3)]
    assert with_main_text(df.limit(0)).count() == 0
    assert [r["html"] for r in with_main_text(df.limit(1).select("html"), text_col="html").collect()] == [""]


def test_query(spark, sf_dir):
    """The tables' pages name their article: by hand, its text is all within that element, without the tags."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op13_html_extraction(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        inside = re.search(r"<article>(.*?)</article>", page["html"], re.DOTALL)[1]
        want = " ".join(references.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert (got[k]["url"], got[k]["text"], got[k]["n_chars"]) == (page["url"], want, len(want))
