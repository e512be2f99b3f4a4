"""Main text of pages: structure, broken markup and site templates."""

import html
import re
import time

from emberlog.llm import html_extract

PAGES = "/root/testdata/sf0.001/pages.parquet"


def texts(source):
    return [b.text for b in html_extract.blocks_of(source)]


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body class="ad">
      <NAV><p>menu</p></NAV><header>top</header><div class="cookie-notice">notice</div>
      <article><h1>Head &amp;amp; more</h1><!-- <p>gone</p> --><p>one <b>two</b>
      three<br>four<p>five &#8364; <a href="x>y">six</a><div id="comments"><p>a comment</p></div>
      <ul><li>a<li>b</ul><form><p>f</p></form><aside>side</aside><p hidden>h</p><div role="alert">r</div>last</article>
      <footer>foot</footer></body></html>"""
    assert texts(page) == ["Head &amp; more", "one two three four", "five € six", "a", "b", "last"]


def test_broken_markup():
    assert texts("<article><p><b>bold<br><p>next</article><p>after") == ["bold", "next"]
    assert texts("plain <i>text") == ["plain text"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<p") == ["<p"]
    assert texts("<article>a<script>never closed <p>b</article>") == ["a"]
    assert texts("</div></p>x</article>y") == ["x", "y"]
    assert texts("<p>a < b and c > d</p>") == ["a < b and c > d"]
    assert texts("<div>" * 3_000 + "deep") == ["deep"]


def test_given_pages(spark):
    """Every given page has one article of headings and paragraphs; its text is read here with patterns."""
    pages = spark.read.parquet(PAGES)
    want = {}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"(?s)<!--.*?-->|</?b>", "", article.replace("<br>", " ")))
        found = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        want[r.page_id] = "\n\n".join(b for b in found if b)
    got = html_extract.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_templates_go_and_copies_stay(spark):
    box = '<div class="box"><p>Read our other stories</p></div>'
    rows = [(i, "http://a.test/x", f"<body>{box}<div><p>story number {i}</p></div></body>") for i in range(8)]
    rows += [(20 + i, "http://b.test/", f"<body>{box}<p>one page only</p></body>") for i in range(6)]  # copies
    rows += [(40 + i, "http://c.test/", f"<article><p>shared prose</p><p>own {i}</p>{box}</article>") for i in range(5)]
    rows += [(60, None, None), (61, "http://a.test/", ""), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {}
    for r in html_extract.main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert all(got[i] == [f"story number {i}"] for i in range(8))
    assert all(got[20 + i] == ["Read our other stories\n\none page only"] for i in range(6))
    assert all(got[40 + i] == [f"shared prose\n\nown {i}"] for i in range(5))
    assert got[60] == [""] and got[61] == [""] and got[None] == ["x", "x"]
    assert html_extract.main_text(df.where("false")).count() == 0


def test_passages_of_few_pages_stay_on_large_hosts(spark):
    """A passage on 60 of 3,000 pages is prose, in a container of an article or in a bare paragraph."""
    quote = "<p>a passage that some pages share</p>"
    rows = []
    for i in range(3_000):
        shared = i % 50 == 0
        rows.append((i, "http://l.test/x", f"<article><p>own {i}</p>{f'<div>{quote}</div>' * shared}</article>"))
        rows.append((10_000 + i, "http://m.test/x", f"<p>own {i}</p>{quote * shared}"))
    rows += [(20_000 + i, "http://s.test/x", f"<p>own {i}</p>{quote * (i < 4)}<div>{quote * (i < 4)}</div>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert sum("passage" in got[i] for i in range(3_000)) == 60
    assert sum("passage" in got[10_000 + i] for i in range(3_000)) == 60
    assert sum(got[20_000 + i].count("passage") for i in range(30)) == 8


def test_recurrence_decides_over_structure(spark):
    """What recurs on most pages of a host goes from articles too, and dropped parts count."""
    note, card, tip = "<p>read also our letters</p>", "<article>today's offer</article>", "<div class=tip>ask us</div>"
    rows = [(i, "http://a.test/x", f"<article><h1>title {i}</h1><p>own {i}</p>{note}</article>{card}") for i in range(40)]
    # The box is in the sidebar of most pages and inside the article of a few.
    rows += [(100 + i, "http://b.test/x", f"<aside>{tip}</aside><main><p>own {i}</p></main>") for i in range(30)]
    rows += [(200 + i, "http://b.test/x", f"<main><p>other {i}</p>{tip}</main>") for i in range(3)]
    # A passage that less than half of the pages share is prose.
    rows += [(300 + i, "http://c.test/x", f"<article><p>own {i}</p>{note * (i < 25)}</article>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert all(got[i] == f"title {i}\n\nown {i}" for i in range(40))
    assert all(got[100 + i] == f"own {i}" for i in range(30))
    assert all(got[200 + i] == f"other {i}" for i in range(3))
    assert sum("read also" in got[300 + i] for i in range(60)) == 25


def test_hostile_pages_take_time_in_proportion():
    """Tags that never end, open quotes, deep nesting: half a megabyte each, quadratic work would take minutes."""
    size = 500_000
    for piece in ("<a ", "<a", '<a "', "<a '\" ", "<div><p>x</p>", "<center><h1>", "<i><li>x", "</a ", "<!--", "<table><tr><td>", "</script "):
        page = piece * (size // len(piece))
        began = time.perf_counter()
        html_extract.parse_page(page)
        html_extract.parse_page("<script>" + page)
        assert time.perf_counter() - began < 20, piece
    assert texts('<a "' * 3) == ['<a "<a "<a "'] and texts("<a <a <b>x") == ["x"]
    assert texts('<p title="a > b">x</p><p title=\'"\'>y</p>') == ["x", "y"]
