import pytest
from pyspark.sql import functions as F

from pageloom.plans.selectors import SelectorError, closest, parse_selector, select_all, select_first, specificity, text_content
from pageloom.sources.pages import parse_pages

HTML = """<html><body><div id=a class="x y" lang="en-US" data-k="Foo Bar"><p>1</p>t<p class=z>2</p><span></span><ul><li>a</li><li>b</li><li>c<b>d</b></li></ul></div><p title="">4</p><p>5</p></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return parse_pages(spark.createDataFrame([(1, HTML), (2, None), (3, "<table/><html><b></html><i>")], "page_id long, html string")).cache()


def texts(nodes, selector, **kw):
    return [r.text for r in text_content(nodes, select_all(nodes, selector, **kw).where("doc_id = 1")).orderBy("node_id").collect()]


@pytest.mark.parametrize("selector,want", [
    ("p", ["1", "2", "4", "5"]), ("#a > p", ["1", "2"]), (".z", ["2"]), ("div.x.y p", ["1", "2"]), ("[title]", ["4"]), ("[title=x]", []), ("[lang|=en] > .z", ["2"]), ("[data-k~=Bar] .z", ["2"]),
    ("[data-k^=foo i] .z", ["2"]), ("[data-k$=Bar] .z", ["2"]), ("[data-k*='o B'] .z", ["2"]), ("[data-k*=''] .z", []), ("li:first-child", ["a"]), ("li:last-child", ["cd"]), ("li:nth-child(2)", ["b"]),
    ("li:nth-child(odd)", ["a", "cd"]), ("li:nth-child(-n+2)", ["a", "b"]), ("li:nth-last-child(1)", ["cd"]), ("p:first-of-type", ["1", "4"]), ("p:nth-of-type(2)", ["2", "5"]), ("b:only-child", ["d"]),
    ("li:not(:first-child)", ["b", "cd"]), ("li:has(b)", ["cd"]), ("li:not(:has(b))", ["a", "b"]), (":is(b, .z)", ["2", "d"]), ("p ~ p", ["2", "5"]), ("p + p", ["5"]), ("span:empty", [""]), ("p, b", ["1", "2", "d", "4", "5"]),
    ("ul > li b", ["d"]), ("body p:not(#a p)", ["4", "5"]), ("li:nth-child(2n+1):not(:last-child)", ["a"]),
])
def test_selectors(nodes, selector, want):
    assert texts(nodes, selector) == want


def test_quirks(nodes):
    assert texts(nodes, "p + p", spec=True) == ["2", "5"]
    assert [r.tag for r in select_all(nodes, "b:has(b)").collect()] == ["b", "b"] and select_all(nodes, "b:has(b)", spec=True).count() == 0
    assert [r.tag for r in select_all(nodes, ":root").where("doc_id = 1").collect()] == ["html"]


def test_first_and_closest(nodes):
    assert select_first(nodes, "li").where("doc_id = 1").count() == 1
    b = select_all(nodes, "li b").select("doc_id", "node_id")
    got = closest(nodes, b, "div, li").collect()
    li = select_all(nodes, "li:has(b)").first()
    assert [(r.doc_id, r.closest_id) for r in got] == [(1, li.node_id)]


@pytest.mark.parametrize("bad", ["", "p::before", ":hover", "p >", "[x", "a:nth-child(z)", "p)", ":not(p"])
def test_errors(bad):
    with pytest.raises(SelectorError):
        parse_selector(bad)


def test_specificity():
    assert [specificity(parse_selector(s)[0]) for s in ("p", "#a .b p", "p:not(#x)", "li:first-child")] == [(0, 0, 1), (1, 1, 1), (1, 0, 1), (0, 1, 1)]


def test_plans_have_no_nested_loops(nodes):
    plan = select_all(nodes, "div > p ~ ul li:has(b)")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Join" not in select_all(nodes, "li.x[y]:nth-child(2)")._jdf.queryExecution().executedPlan().toString()
    assert F is not None


def test_subtrees_over_many_cells(spark, monkeypatch):
    """The same matches, texts and ancestors whatever the size of a cell."""
    from pageloom.operators import css, dom
    from pageloom.plans import selectors

    html = "".join(f"<div class=c{k % 3}>t{k}<p><b>{k}</b></p><ul><li>x<ul><li>y{k}</ul></ul></div>" for k in range(40)) + "<div>" * 30 + "<i>deep</i>"
    nodes = parse_pages(spark.createDataFrame([(1, html), (2, "<div><p>a")], "page_id long, html string")).cache()
    found = []
    for size in (256, 7, 1):
        monkeypatch.setattr(selectors, "CELL", size)
        hits = {s: sorted((r.doc_id, r.node_id) for r in selectors.select_all(nodes, s).collect()) for s in ("div b", "ul li", "div:has(b)", "body div div i", "div:has(p b) ul")}
        texts = sorted(tuple(r) for r in selectors.text_content(nodes, selectors.select_all(nodes, "ul, i")).collect())
        near = sorted(tuple(r) for r in selectors.closest(nodes, selectors.select_all(nodes, "b, li"), "div, ul").collect())
        below = sorted((r.from_id, r.node_id) for r in dom.descendants(nodes, nodes.where("tag = 'ul'")).collect())
        styles = sorted(tuple(r) for r in css.computed_style(nodes, "div { color: red } ul { color: blue } p { margin: 0 }").collect())
        found.append((hits, texts, near, below, styles, dom.mutations(nodes, nodes).count()))
    assert found[0] == found[1] == found[2] and all(found[0][0].values()) and found[0][5] == 0
