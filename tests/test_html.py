import random

import pytest

from pageloom.operators.article import collapse, extract, paragraphs
from pageloom.operators.render import serialize, to_html, to_json, to_markdown
from pageloom.operators.article import kept_nodes
from pageloom.sources.html import ParseError, decode, parse, sniff, tokens, unescape


def shape(html):
    p = parse(html)
    return [(p.tag[k] or p.kind[k], p.depth[k], p.data[k]) for k in range(1, len(p.kind))]


def test_tokens():
    assert list(tokens("<!DOCTYPE html><P Class=a id='b' x=\"c&amp;\" y a=2 />t<!-- c --></p>")) == [
        ("doctype", "html"), ("start", "p", [("class", "a"), ("id", "b"), ("x", "c&"), ("y", ""), ("a", "2")], True), ("text", "t"), ("comment", " c "), ("end", "p"),
    ]
    assert list(tokens("<a x=1 x=2>")) == [("start", "a", [("x", "1")], False)]
    assert list(tokens("<script>var a='</p>';</script>x"))[1] == ("text", "var a='</p>';")
    assert list(tokens("<title>a&amp;b</title>"))[1] == ("text", "a&b")
    assert list(tokens("a<!-- open")) == [("text", "a")] and list(tokens("a<b c")) == [("text", "a")]


@pytest.mark.parametrize("raw,want", [("&amp;&lt;", "&<"), ("&amp", "&amp"), ("&#65;&#x41", "AA"), ("&#x80;", "€"), ("&#xD800;", "�"), ("&#99999999;", "�"), ("&nope;", "&nope;"), ("&copy;", "©")])
def test_references(raw, want):
    assert unescape(raw) == want


def test_tree():
    assert shape("x") == [("html", 1, None), ("head", 2, None), ("body", 2, None), ("text", 3, "x")]
    assert [s[:2] for s in shape("<ul><li>a<li>b</ul>")][3:] == [("ul", 3), ("li", 4), ("text", 5), ("li", 4), ("text", 5)]
    assert [s[:2] for s in shape("<p>a<div>b")][3:] == [("p", 3), ("text", 4), ("div", 3), ("text", 4)]
    assert [s[:2] for s in shape("<p>a<hr>b")][3:] == [("p", 3), ("text", 4), ("hr", 4), ("text", 4)]
    assert [s[0] for s in shape("<head><title>t</title></head><body>b</body><!-- z -->")] == ["html", "head", "title", "text", "body", "text", "comment"]
    assert [s[:2] for s in shape("</x>a</b>b")][3:] == [("text", 3)]


def test_intervals_nest_for_any_input():
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<b", '="x', ">", "<!--", "-->", "<!doctype html>", "<head>", "</head>", "<body>", "</body>", "</html>", "<li>", "<td>", "a ", "&#x", "<title>", "</title>", "<script>", "</script>", "<br/>"]
    for _ in range(2000):
        try:
            p = parse("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))))
        except ParseError:
            continue
        for k in range(1, len(p.kind)):
            assert p.parent[k] < k <= p.end[k] <= p.end[p.parent[k]]


def test_encoding():
    assert sniff(b"\xef\xbb\xbfx") == "utf-8" and sniff(b"\xff\xfex") == "utf-16-le"
    assert sniff(b"<meta charset=latin-1>", "text/html; charset=cp1252") == "cp1252" and sniff(b"<meta charset='latin-1'>") == "iso8859-1"
    assert sniff(b"<meta charset=what>") == "utf-8" and decode(b"\xef\xbb\xbf\xc3\xa9") == "é"


PAGE = """<html lang=en><head><title> T </title><meta name=author content=Ann><meta property="og:description" content="D"></head><body>
<nav><a href="/a">A</a><a href="/i"><img alt="pic"></a><a href="#x">no</a></nav>
<article class=post><h1>Head</h1><p>%s <a href="/b">link</a><a href="/b">again</a></p><img src="p.png" alt=P><div class=share>drop</div><ul><li>one<li>two</ul><pre><code class="language-py">x = 1</code></pre></article>
<footer><a href=/f>f</a></footer></body></html>""" % ("Words *here* " * 30)


def test_article():
    p = parse(PAGE)
    a = extract(p, "http://Example.com/x/y")
    assert (a["title"], a["byline"], a["lang"], a["description"], a["site_name"]) == ("T", "Ann", "en", "D", "example.com")
    assert p.tag[a["content_root"]] == "article" and "drop" not in a["plain_text"] and a["hero_image"] == "http://example.com/x/p.png"
    assert [x["text"] for x in a["nav_links"]] == ["A", "pic"] and a["links"] == [{"href": "http://example.com/b", "text": "link"}]
    nodes = kept_nodes(p, a["content_root"])
    md = to_markdown(p, nodes, a)
    assert md.startswith("# T\n\nBy **Ann**") and "- one\n- two" in md and "```py\nx = 1\n```" in md and "Words \\*here\\*" in md
    safe = to_html(p, nodes, a)
    assert "class" not in safe and '<a href="/b"' not in safe and "<span>link</span>" in safe
    assert '"wordCount":' in to_json(p, nodes, a)


def test_serialize_round_trip():
    html = '<html><head></head><body><p a="1&quot;">x &amp; y<br>z</p><!--c--></body></html>'
    assert serialize(parse(html)) == html


def test_white_space():
    assert paragraphs(" a \n\n b\nc ") == "a\n\nb c" and collapse(" a\t b ") == "a b"
