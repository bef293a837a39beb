"""Main text of pages, hand-worked, and branches that a host's pages share."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanloom.llm import html_extract as hx
from spanloom.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain &lt;text&gt; &amp here", "plain <text> & here"),
        ("<p>a<br>b <b>c</b>d</p><p>e&nbsp; f", "a b cd\ne f"),
        ("<title>t</title><script>var x='</p>';</script><style>p{}</style><p>x</p>", "x"),
        ("<nav><ul><li>m</li></ul></nav><article><h1>H</h1><p><b>one<br><p>two</article><footer>f</footer>", "H\none\ntwo"),
        ("<article><p>in</p></article><div>out</div>", "in"),
        ("<main><div class='share-buttons'>s</div><p>x</p><div id=comments><article>r</article></div></main>", "x"),
        ("<header>top</header><article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
        ("<p>a <span class=ad>buy</span>b <button>go</button>c</p>", "a b c"),
        ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div><p>x", "x"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<!-- <p>no</p> --><p>x<!-- open", "x"),
        ("<p title='a > b'>x</p></div></p>y<", "x\ny<"),
        ("<form><p>in</p></form><aside>a</aside><p>&#x41;&#66;&am", "AB&am"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>" * 3000 + "deep", "deep"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "after", "deep\nafter"),
        ("<div class='adhesive'>kept</div><div class='left-sidebar'>gone</div>", "kept"),
    ],
)
def test_hand_worked(source, text):
    assert hx.Page(source).text() == text


def page(i, body, host="h.example"):
    return (i, f"https://{host}/{i}", body)


def test_shared_branches_are_cut(spark):
    rows = []
    for i in range(30):
        promo = "<div class='zone-x'><p>Read our five best offers</p><p>Join now</p></div>"
        rows.append(page(i, f"<body><div class='top{i}'><p>Story {i} begins</p><p>and ends {i * i}</p></div>{promo}</body>"))
    rows += [page(100 + i, "<body><p>all alike</p></body>", "copy.example") for i in range(20)]
    rows += [page(200 + i, "<body><div class='zone-x'><p>Read our five best offers</p></div></body>", "small.example") for i in range(3)]
    rows += [(300, None, None), (None, "x", "<p>no id"), (301, None, "<p>t"), (302, "https://h.example/9", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("host", F.lit(1))
    for limit in (200_000, -1):  # broadcast and joined
        hx_limit, hx.BROADCAST_BRANCHES = hx.BROADCAST_BRANCHES, limit
        try:
            got = {r.page_id: r for r in hx.extract(df).collect()}
        finally:
            hx.BROADCAST_BRANCHES = hx_limit
        assert len(got) == len(rows)
        for i in range(30):
            assert got[i].text == f"Story {i} begins\nand ends {i * i}"
        assert {got[100 + i].text for i in range(20)} == {"all alike"}
        assert got[200].text == "Read our five best offers"
        assert (got[300].text, got[300].n_chars, got[None].text, got[301].text, got[302].text) == ("", 0, "no id", "t", "")
    assert hx.extract(df.filter(F.lit(False))).count() == 0


def test_importance_is_the_entropy(spark):
    pages = ["<div><p>a</p></div>", "<div><p>a</p></div>", "<div><p>a</p><p>b</p></div>", "<div><ul><li>c</li></ul></div>"]
    df = spark.createDataFrame([page(i, b) for i, b in enumerate(pages)], "page_id long, url string, html string")
    nodes = {r.path: r for r in hx.node_importance(hx.tree_counts(df)).collect()}
    root = hx._hash("")
    div = hx._hash(f"{root}>div")
    p = hx._hash(f"{div}>p")
    assert nodes[root].presentation == pytest.approx(0) and nodes[div].m == 4
    h = -(3 / 4 * math.log(3 / 4) + 1 / 4 * math.log(1 / 4)) / math.log(4)
    assert nodes[div].presentation == pytest.approx(h)
    assert nodes[p].content == pytest.approx(1 - (1 + 0) / 2) and nodes[p].m == 3


def test_query_against_the_articles(spark, small_dir):
    rows = {r.page_id: r for r in QUERIES["op2_html_main_text"](spark, small_dir).collect()}
    for source in spark.read.parquet(f"{small_dir}/pages.parquet").collect():
        body = source.html.split("<article>")[1].split("</article>")[0]
        import html
        import re

        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert rows[source.page_id].text == want and rows[source.page_id].n_chars == len(want)
        assert rows[source.page_id].url == source.url


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div class='layout with-sidebar'><article><p>x</p></article><div class=sidebar>s</div></div>", "x"),
        ("<div class='entry has-comments'><p>x y</p></div><div class=comments>c</div>", "x y"),
        ("<article class='post hentry category-social'><p>x</p></article><p>y</p>", "x"),
        ("<div class='search-results'><p>x</p></div>", "x"),
        ("<div class='related-work'><p>x</p></div>", "x"),
        ("<div class='site-banner'><article><p>x</p><div class='share'>s</div></article></div><p>y</p>", "x"),
        ("<article class='sponsored'><p>x</p></article>", "x"),
        ("<div class=widget><p>most of the text</p><div class=ad>buy</div></div><p>y</p>", "most of the text\ny"),
        ("<div class=menu>only</div><nav>n</nav>", "only"),
        ("<article><p>x</p></article><div id=comments><article>long comment</article></div>", "x"),
        ("<p>text here</p><div id=comments><article>c</article></div>", "text here"),
        ("<p>x</p><div id=comments><p>long comment</p></div>", "x"),
    ],
)
def test_names_do_not_cut_the_article(source, text):
    assert hx.Page(source).text() == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>a</p><p class='social'>b</p><h2 id='search'>c</h2></article>", "a\nb\nc"),
        ("<article><p>a</p><section id='comments-on-war'><p>b</p></section><div class='notice-of-sale'>c</div></article>", "a\nb\nc"),
        ("<article><p>a</p><p class='ad'>b</p><p class='comment'>c</p><div class='social'>d</div></article>", "a"),
        ("<div><p>the long text of this page</p><p>and more of it</p></div><article>one</article><article>two</article>", "the long text of this page\nand more of it"),
        ("<p>short</p><article>the first long article</article><article>the second long article</article>", "the first long article\nthe second long article"),
    ],
)
def test_names_and_articles_by_their_text(source, text):
    assert hx.Page(source).text() == text


@pytest.mark.parametrize(
    "piece", ["<a ", "<p '", "</b ", "<b '>'", "<b><div>", "<div></p>", "<i></b>", "<li><div></ul>", "<div><li></li>", "<!", "</script ", "<p class=a", "&", "<p a='\">"]
)
def test_hostile_pages_take_linear_time(piece):
    import time

    half, whole = ("<script>" if "script" in piece else "") + piece * (400_000 // len(piece)), piece * (2_000_000 // len(piece))
    begin = time.process_time()
    hx.Page(half, styles=True).text()
    one = time.process_time() - begin
    begin = time.process_time()
    hx.Page(whole, styles=True).text()
    assert time.process_time() - begin < max(20 * one, 30)


def test_deep_pages_keep_apart_what_is_deep_down(spark):
    """Entropy sees branches at any depth."""
    rows = []
    for i in range(12):
        inner = f"<div class='s{i}'><p>Story {i} of the day</p></div><div class='zone'><p>Same words</p></div>"
        rows.append(page(i, "<div>" * 60 + inner + "</div>" * 60, "deep.example"))
    got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i} of the day" for i in range(12)}


def test_small_hosts_lose_what_all_their_pages_share(spark):
    rows = [page(i, f"<div class='a{i}'><p>A story of some length, number {i}</p></div><div class='zone'><p>Same words</p></div>", "three.example") for i in range(3)]
    copies = "<div class='top'><p>A story that stands on two pages of its host</p></div>"
    rows += [page(10 + i, copies + f"<p>printed as {i}</p>", "two.example") for i in range(2)]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"A story of some length, number {i}" for i in range(3)]
    assert [got[10 + i] for i in range(2)] == [f"A story that stands on two pages of its host\nprinted as {i}" for i in range(2)]
