"""Main text of pages in several layouts, and odd markup."""

import html

import pytest

from basketlens.llm import pages

PROSE = ["The harbour was quiet in the morning, and few boats had left; the wind, they said, would turn.", "By noon, however, the fog had lifted. Children ran along the pier, shouting, and the bells rang.", "“Nobody,” the keeper wrote, “has seen such a tide since 1911.” He shut the book, lit the lamp, and waited.", "Be."]
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "About us", "Contact"))
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
WANT = "A day &amp; a night at the harbour".replace("&amp;", "&") + " " + " ".join(PROSE)
LAYOUTS = {
    "labelled": f'<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul>{MENU}</ul></nav><div class="ad">Buy now, cheap!</div><article><h1>A day &amp; a night at the harbour</h1>{BODY}</article><footer>&copy; us, 2020.</footer></body></html>',
    "classes": f'<body><div id="site-header"><a href="/">Harbour Times</a></div><div class="main-menu">{MENU}</div><div class="content no-sidebar"><h1>A day &amp; a night at the harbour</h1>{BODY}<form>Your name, please: <input><button>Send</button></form></div><div class="sidebar">Most read, this week: the tide.</div><section id="comments"><h2>Comments</h2><p>Great text, thanks! I loved it, really.</p></section><div class="cookieNotice">We use cookies, as all do.</div></body>',
    "plain": f"<div><div>{MENU}</div><div><h1>A day &amp; a night at the harbour</h1>{BODY}</div><div>{MENU}</div><div>&copy; Harbour Times, all rights reserved.</div></div>",
    "tables": f"<table><tr><td><ul>{MENU}</ul><td><h1>A day &amp; a night at the harbour</h1>{BODY}<tr><td>© 1999",
    "headers": f'<body><header><h1>Harbour Times</h1></header><main><article class="post"><header><h1>A day &amp; a night at the harbour</h1></header>{BODY}</article><aside>Read also: the tide, again.</aside></main><script>var a = "</p><p>no, no, no.";</script><noscript>Turn on scripts, please.</noscript>',
    "linked": f'<body><article><h1><a href="/1">A day &amp; a night at the harbour</a></h1>{BODY}</article><div><ul>{MENU}</ul></div></body>',
    "unclosed": f"<head><title>x</title><body><nav><ul>{MENU}<main><h1>A day &amp; a night at the harbour</h1>" + "".join(f"<p>{x}" for x in PROSE) + "<footer>The end, at last.",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert pages.main_text(LAYOUTS[name]) == WANT


def test_text_of_blocks():
    page = "<article><p>One\n\t two<b>three</b>&nbsp;four &lt;five&gt; &#233;&eacute; AT&T<br>six<!-- no > no --> seven</p>\n\n<ul><li>eight, <a href='#'>nine</a><li>ten.</ul><p hidden>no</p><pre>a\n  b</pre></article>"
    assert pages.main_text(page) == "One twothree four <five> éé AT&T six seven eight, nine ten. a b"
    assert [pages.main_text(x) for x in (None, "", "  ", "<p>", "<nav><a>x</a></nav>", "plain, text.", "<!-- never ends", "<script>never ends", "a < b & c", "<p title='never ends>x</p>")] == ["", "", "", "", "", "plain, text.", "", "", "a < b & c", "x"]


def test_long_and_deep_pages():
    words = "word, " * 400_000
    assert pages.main_text(f"<p>{words}</p>") == words.strip()
    assert pages.main_text("<div>" * 20_000 + "deep, text." + "</div>" * 20_000) == "deep, text."
    assert pages.main_text("<b>x, <hr>" * 20_000).count("x,") == 20_000


def test_ratios_by_plain_sums():
    blocks = pages.Reader().read("<div><p>aa, b.</p><p>cc <a>dddd</a></p><h2>t</h2></div>")
    assert [(b.text, b.linked, b.marks, b.depth, b.shared) for b in blocks] == [("aa, b.", 0, 2, 2, 0), ("cc dddd", 4, 0, 2, 1), ("t", 0, 0, 2, 1)]
    fused, path = pages.ratios(blocks)
    assert path.tolist()[0] == path.tolist()[1] != path.tolist()[2]
    import math

    length, marks = [(6 + 3) / 2, (6 + 3) / 2, 1.0], [1.0, 1.0, 0.0]
    alike = [[1, 1, 0.5], [1, 1, 0.5], [0.5, 0.5, 1]]
    smooth = lambda v, i: sum(v[j] * alike[i][j] ** 2 * math.exp(-((i - j) ** 2) / 2) for j in range(3)) / sum(alike[i][j] ** 2 * math.exp(-((i - j) ** 2) / 2) for j in range(3))
    own = [smooth(length, i) * (1 + smooth(marks, i)) for i in range(3)]
    assert fused.tolist() == pytest.approx([(own[0] + own[1]) / 2 * 9 / 13] * 2 + [own[2]])


def test_table_with_odd_rows(spark):
    rows = [(1, "u", LAYOUTS["labelled"], "t", 5), (1, "u", LAYOUTS["labelled"], "t", 5), (2, None, None, "t", 5), (None, "v", "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = pages.extract(df).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in got) == sorted([("1", "u", WANT, len(WANT))] * 2 + [("2", "None", "", 0), ("None", "v", "", 0)])
    assert pages.extract(df.limit(0)).count() == 0


def test_whole_table_of_pages(spark):
    """The invented pages hold one ``article`` each; its text, tags taken out, is what must come."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    want = {r["page_id"]: " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", re.search("<article>(.*?)</article>", r["html"], re.S)[1]))).split()) for r in rows}
    got = {r["page_id"]: r["text"] for r in pages.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
