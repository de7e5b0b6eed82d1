import random

import pytest

from pageloom.operators.article import collapse
from pageloom.operators.search_markup import parse_markup_hits
from pageloom.plans.match import Matcher, selection_texts
from pageloom.plans.selectors import select_all
from pageloom.sources.html import parse
from pageloom.sources.pages import parse_pages

SELECTORS = ("p", "div > p", "div p + b", "b ~ p", "li:nth-child(2n+1)", ":not(p):not(div)", "div:has(b, li)", "p:empty", "[x]", ":is(p, li):last-of-type", "div p:first-child, b", "b:only-child", "ul li b", ":root > body p")


def test_both_forms_agree(spark):
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<b x=1>", "</b>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "t", " ", "<!--c-->"]
    pages = {k: "".join(rng.choice(parts) for _ in range(25)) for k in range(20)}
    nodes = parse_pages(spark.createDataFrame(list(pages.items()), "page_id long, html string")).cache()
    for s in SELECTORS:
        got = {(r.doc_id, r.node_id) for r in select_all(nodes, s).select("doc_id", "node_id").collect()}
        assert got == {(k, j) for k, h in pages.items() for j in Matcher(parse(h)).all(s)}, s


def test_selection_texts():
    page = parse("<p> a  b</p><p>c</p>")
    assert selection_texts(page, "p", collapse) == ["a b", "c"] and selection_texts(page, "p::x", collapse) == []


@pytest.fixture
def payloads(spark):
    return spark.createDataFrame([
        ("duckduckgo", '<div class="result"><a class=result__a href="//duckduckgo.com/l/?uddg=http%3A%2F%2Fx.org%2Fa&r=1"> T </a><div class=result__snippet>S</div></div><div class="web-result"><a class=result__url href="http://X.org/a">again</a></div>'),
        ("brave", '<div class=snippet><a href="http://b.org/"><h2>B</h2></a></div><div class=snippet><a href="/own">no</a></div>'),
        ("mojeek", '<div class=result><h2><a href="http://m.org/">M</a></h2><p class=s>s</p></div>'),
        ("arxiv", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title> A </title><summary>s</summary><author><name>X</name></author><author><name>Y</name></author></entry></feed>'),
        ("bingnews", '<rss><channel><item><title>N</title><link>http://www.bing.com/news/apiclick.aspx?url=http%3a%2f%2fn.org%2f1&amp;x=1</link><pubDate>d</pubDate></item></channel></rss>'),
        ("arxiv", "broken <"), ("github", "{}"), ("brave", None),
    ], "provider string, payload string")


def test_markup_hits(payloads):
    got = {r.source: (r.url, r.title, r.snippet, r.extra) for r in parse_markup_hits(payloads).collect()}
    assert got == {
        "duckduckgo": ("http://x.org/a", "T", "S", None), "brave": ("http://b.org/", "B", None, None), "mojeek": ("http://m.org/", "M", "s", None),
        "arxiv": ("http://arxiv.org/abs/1", "A", "s", {"authors": "X; Y"}), "bingnews": ("http://n.org/1", "N", None, {"publishedAt": "d"}),
    }


def test_records_as_lines(spark, tmp_path):
    from pageloom.operators.selections import selections, write_jsonl

    rows = selections(spark.createDataFrame([(1, "<li>a<li> b  c"), (2, None)], "page_id int, html string"), ["li", "p::x"])
    assert {r.page_id: (r.selections[0].plain_text, r.selections[0].match_count, r.selections[1].match_count) for r in rows.collect()} == {1: ("a\n\nb c", 2, 0), 2: ("", 0, 0)}
    write_jsonl(rows.select("page_id", "plain_text").selectExpr("page_id", "nullif(plain_text, '') as plain_text"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"pageId":1,"plainText":"a\\n\\nb c"}', '{"pageId":2}']
