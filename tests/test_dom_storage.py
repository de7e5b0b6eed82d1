import pytest
from pyspark.sql import functions as F

from pageloom.operators import dom, storage
from pageloom.sources import fetch
from pageloom.sources.fetch import from_files, intercept, page_errors
from pageloom.sources.pages import parse_pages


def test_storage(spark):
    frame = lambda rows: spark.createDataFrame(rows, storage.SCHEMA)
    t = frame([("d", "s", 1, "a", "1"), ("d", "s", 2, "b", "2"), ("d", "o", 3, "a", "3")])
    up = storage.put(t, frame([("d", "s", 4, "a", "x"), ("d", "s", 5, "c", "y"), ("d", "s", 6, "c", None)]))
    assert [tuple(r) for r in storage.get_all(up, "d", "s").collect()] == [("a", "x"), ("b", "2"), ("c", None)]
    assert storage.add(t, frame([("d", "s", 9, "z", "9")])).count() == 4
    with pytest.raises(Exception, match="ConstraintError"):
        storage.add(t, frame([("d", "s", 9, "a", "9")])).collect()
    assert storage.get(t, "d", "s", "b").first().value == "2" and storage.delete(t, "d", "s", "b").count() == 2
    assert storage.clear(t, "d", "s").count() == 1 and storage.count(t, "d", "s").first().n == 2


def test_dom(spark):
    pages = spark.createDataFrame([(1, '<div id=a data-foo-bar=1><p>x</p>y<b>z</b></div>')], "page_id long, html string")
    nodes = parse_pages(pages).cache()
    div, p = dom.by_id(nodes, "a"), nodes.where("tag = 'p'")
    tags = lambda df: [r.tag or r.data for r in df.orderBy("node_id").collect()]
    assert tags(dom.children(nodes, div)) == ["p", "b"] and tags(dom.child_nodes(nodes, div)) == ["p", "y", "b"] and tags(dom.parent(nodes, p)) == ["div"]
    assert tags(dom.next_sibling(nodes, p)) == ["y"] and tags(dom.first_child(nodes, div)) == ["p"] and tags(dom.descendants(nodes, div)) == ["p", "x", "y", "b", "z"]
    assert tags(dom.walk(nodes, dom.SHOW["text"])) == ["x", "y", "z"]
    assert div.select(dom.dataset(F.col("attr_map")).alias("d")).first().d == {"fooBar": "1"}
    after = parse_pages(spark.createDataFrame([(1, '<div id=c><p>q</p>y</div>')], "page_id long, html string"))
    got = {(r.type, r.tag, r.attribute, r.old_value, r.new_value) for r in dom.mutations(nodes, after).collect()}
    assert got == {("childList", "b", None, "element", None), ("childList", None, None, "text", None), ("characterData", None, None, "x", "q"), ("attributes", "div", "id", "a", "c"), ("attributes", "div", "data-foo-bar", "1", None)}


def test_fetch(spark, tmp_path, monkeypatch):
    rows = [("u1", 200, "text/html", b"x"), ("u2", 404, None, b"x"), ("u3", 200, None, b"\xef\xbb\xbf <p>"), ("u4", 200, "image/png", b"\x89"), ("u5", 200, "text/html", None)]
    df = spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in rows], "url string, status int, content_type string, body binary")
    assert {r.url: r.error for r in page_errors(df).collect()} == {"u1": None, "u2": "HTTP 404", "u3": None, "u4": "not HTML", "u5": "empty response"}
    mocked = {r.url: r.status for r in intercept(df, df.where("url = 'u2'").withColumn("status", F.lit(201))).collect()}
    assert mocked["u2"] == 201 and len(mocked) == 5
    (tmp_path / "a.html").write_bytes(b"<p>")
    assert [bytes(r.body) for r in from_files(spark, str(tmp_path)).collect()] == [b"<p>"]
    (tmp_path / "b.html").write_bytes(b"<p>" * 10)
    monkeypatch.setattr(fetch, "MAX_BODY", 5)
    got = {r.url[-6:]: (r.status, r.body and bytes(r.body), r.error) for r in page_errors(from_files(spark, str(tmp_path), "text/html")).collect()}
    assert got == {"a.html": (200, b"<p>", None), "b.html": (413, None, "HTTP 413")}
