import html as entities
import itertools
import random
import re
import time

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import html, queries  # noqa: E402

LONG = "This is a paragraph of the story, and it goes on for quite a while so that nobody takes it for a menu entry."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body class="has-ads">
<div class="cookie-banner"><p>We use cookies. {LONG}</p><button>Accept</button></div>
<div id="site-header"><h1>Site name</h1></div>
<nav><ul><li><a href="/">Home</a><li><a href=/x>About</a></ul>
<div class="content with-sidebar"><article><header><h1>Title &amp; more&#33;</h1></header>
<p>First <b>bold</b>   text.
<p>{LONG}<div class="ad"><p>Buy this now. {LONG}</p></div>
<p>Short one.</p><blockquote>Quoted words here.</blockquote><ul><li>point one.<li>point two.</ul>
<form><label>Your mail</label><input></form><!-- <p>hidden</p> -->
<div class="share">Share on X</div></article>
<aside><p>{LONG}</p></aside><div class="related"><a href=/1>Another story</a></div></div>
<section id="comments"><article><p>I disagree. {LONG}</p></article></section>
<footer><p>&copy; someone</p></footer></body></html>"""


def test_page_with_all_kinds_of_boilerplate():
    want = ["Title & more!", "First bold text.", LONG, "Short one.", "Quoted words here.", "point one.", "point two."]
    assert html.main_text(PAGE).split("\n") == want


def test_page_without_article_tags():
    page = f"<body><div class=menu><a href=/>Home</a> <a href=/b>News</a></div><div><h2>Heading of it</h2><p>{LONG}</p><p>{LONG}</p></div><div class='footer'>{LONG}</div>"
    assert html.main_text(page) == f"Heading of it\n{LONG}\n{LONG}"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<nav>x</nav>", ""), ("<article><p>cut off &amp", "cut off &"), ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>one.<p class=\"unfinished", "one."), ("<article>a<br>b.</article>", "a b."), ("<article><p>x < y and z > w.</p>", "x < y and z > w."),
    ("<article><script>if (a</b>c) {</script><p>t.</p>", "t."), ("<article><p>é \xa0 🙂.</p><STYLE>İ</STYLE><p>u.</p>", "é 🙂.\nu."),
])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def cost(side, costs, edges):
    return sum(b if s else a for s, (a, b) in zip(side, costs, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])


def test_cut_is_minimal():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        costs = [(rnd.randrange(5) * 1.0, rnd.randrange(5) * 1.0) for _ in range(n)]
        edges = [(a, b, rnd.choice([0.5, 1.0, 2.0])) for a in range(n) for b in range(a) if rnd.random() < 0.4]
        best = min(cost(side, costs, edges) for side in itertools.product([True, False], repeat=n))
        assert cost(html.min_cut(costs, edges), costs, edges) == pytest.approx(best)


def test_svg_and_math_without_end_do_not_end_the_page():
    assert html.main_text(f"<article><p>{LONG}</p><svg><path d='M0'><p>After {LONG}</p><math><p>More {LONG}</article>") == f"{LONG}\nAfter {LONG}\nMore {LONG}"
    assert html.main_text(f"<article><p>{LONG}<svg><text>no</text></svg><math/></p></article>") == LONG


@pytest.mark.parametrize("page", [
    "<div>x" * 100_000, "<li><ul>" + "<x>" * 50_000 + "<li>a</li>" * 50_000, "<b>" * 50_000 + "<div>" * 50_000 + "</b>" * 50_000 + "<p>end.",
    "<a><div>" * 50_000 + "</div>" * 50_000, "<svg>" * 100_000, "<i> </i>" * 50_000 + "<i>y</i>" * 50_000, "<x>" * 50_000 + "</y>" * 50_000,
])
def test_reading_is_linear_however_deep(page):
    start = time.process_time()
    html.read_blocks(page)
    assert time.process_time() - start < 5


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "<p>" + LONG, 6), (3, "x" * 200_000 + "<" * 5000, 7)], "page_id long, html string, text int")
    got = html.extract(df).orderBy("page_id").collect()
    assert [r.text for r in got[:3]] == ["", "", LONG] and len(got) == 4 and got[0].asDict().keys() == {"page_id", "html", "text"}
    assert html.extract(df.limit(0)).collect() == []


def test_query_on_generated_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.QUERIES["op9_html"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.split("</article>", pages[r.page_id].split("<article>", 1)[1])[0]
        blocks = [re.sub(r"<[^>]*(>|$)", "", b) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        assert r.text == "\n".join(x for b in blocks if (x := " ".join(entities.unescape(b).split()))) and r.n_chars == len(r.text)
