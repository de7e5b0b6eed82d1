"""Navigation and differences over the node table: every step is an equi-join, by page, parent or cell of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.css import inline_declarations
from pageloom.plans import selectors

#: The bits of a tree walker's mask.
SHOW = {"element": 1, "text": 4, "comment": 128, "document": 256, "doctype": 512}


def _step(nodes: DataFrame, starts: DataFrame, on: Column) -> DataFrame:
    s = starts.select(F.col("doc_id").alias("s_doc"), F.col("node_id").alias("s_node"), F.col("end_id").alias("s_end"), F.col("parent_id").alias("s_parent"), F.col("child_idx").alias("s_child"))
    return nodes.join(s, (F.col("doc_id") == F.col("s_doc")) & on).drop("s_doc", "s_end", "s_parent", "s_child").withColumnRenamed("s_node", "from_id")


def parent(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The parent of each start, with from_id, the start's node."""
    return _step(nodes, starts, F.col("node_id") == F.col("s_parent"))


def child_nodes(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return _step(nodes, starts, F.col("parent_id") == F.col("s_node"))


def children(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return child_nodes(nodes.where(F.col("kind") == "element"), starts)


def next_sibling(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return _step(nodes, starts, (F.col("parent_id") == F.col("s_parent")) & (F.col("child_idx") == F.col("s_child") + 1))


def previous_sibling(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return _step(nodes, starts, (F.col("parent_id") == F.col("s_parent")) & (F.col("child_idx") == F.col("s_child") - 1))


def first_child(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return child_nodes(nodes.where(F.col("child_idx") == 0), starts)


def descendants(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """All nodes below each start, met by page and cell."""
    s = starts.select(F.col("doc_id").alias("s_doc"), F.col("node_id").alias("from_id"), F.col("end_id").alias("s_end"), F.explode(selectors.cells(F.col("node_id") + 1, F.col("end_id"))).alias("s_cell"))
    on = (F.col("doc_id") == F.col("s_doc")) & (selectors.cell(F.col("node_id")) == F.col("s_cell")) & (F.col("node_id") > F.col("from_id")) & (F.col("node_id") <= F.col("s_end"))
    return nodes.join(s, on).drop("s_doc", "s_end", "s_cell")


def contains(a: Column, a_end: Column, b: Column) -> Column:
    """Whether node b stands in a (or is it)."""
    return b.between(a, a_end)


def walk(nodes: DataFrame, what_to_show: int = 0xFFFFFFFF, accept: Column | None = None) -> DataFrame:
    """The nodes of the kinds in the mask that a filter accepts, in document order within each page."""
    kinds = [k for k, bit in SHOW.items() if what_to_show & bit]
    out = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes.where("false")
    return out if accept is None else out.where(accept)


def by_id(nodes: DataFrame, value: str) -> DataFrame:
    """The first element of each page with the id."""
    hits = nodes.where((F.col("kind") == "element") & (F.col("elem_id") == value))
    return hits.join(hits.groupBy("doc_id").agg(F.min("node_id").alias("node_id")), ["doc_id", "node_id"], "left_semi")


def dataset(attr_map: Column) -> Column:
    """data-* attributes with camelCase names."""
    own = F.map_filter(attr_map, lambda k, _: k.startswith("data-"))
    parts = lambda k: F.split(F.substring(k, 6, 1 << 20), "-")
    return F.transform_keys(own, lambda k, _: F.concat(F.get(parts(k), F.lit(0)), F.array_join(F.transform(F.slice(parts(k), 2, 1 << 20), lambda w: F.initcap(w)), "")))


def mutations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records (doc_id, type, tag, path, attribute, old_value, new_value) of what differs between two snapshots.

    Nodes are the same if their path (kinds and positions from the root) is the same.
    """
    b, a = _placed(before).alias("b"), _placed(after).alias("a")
    both = b.join(a, ["doc_id", "path"], "full_outer")
    gone, new = F.col("b.kind").isNull(), F.col("a.kind").isNull()
    lists = both.where(gone | new).select("doc_id", F.lit("childList").alias("type"), F.coalesce("a.tag", "b.tag").alias("tag"), "path", F.lit(None).cast("string").alias("attribute"), F.col("b.kind").alias("old_value"), F.col("a.kind").alias("new_value"))
    kept = both.where(~gone & ~new)
    data = kept.where(~F.col("a.data").eqNullSafe(F.col("b.data"))).select("doc_id", F.lit("characterData").alias("type"), "a.tag", "path", F.lit(None).cast("string").alias("attribute"), F.col("b.data").alias("old_value"), F.col("a.data").alias("new_value"))
    names = F.array_union(F.map_keys("a.attr_map"), F.map_keys("b.attr_map"))
    attrs = kept.select("doc_id", "path", "a.tag", F.col("a.attr_map").alias("am"), F.col("b.attr_map").alias("bm"), F.explode(names).alias("attribute"))
    attrs = attrs.withColumn("old_value", F.try_element_at("bm", F.col("attribute"))).withColumn("new_value", F.try_element_at("am", F.col("attribute")))
    attrs = attrs.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("doc_id", F.lit("attributes").alias("type"), "tag", "path", "attribute", "old_value", "new_value")
    return lists.unionByName(data).unionByName(attrs)


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with their path: the positions and kinds of all ancestors, by one interval join."""
    up = nodes.select(F.col("doc_id").alias("u_doc"), F.col("node_id").alias("u"), F.col("end_id").alias("u_end"), F.concat_ws(":", "child_idx", F.coalesce("tag", "kind")).alias("step"), F.explode(selectors.cells(F.col("node_id"), F.col("end_id"))).alias("u_cell"))
    joined = nodes.select("doc_id", "node_id").join(up, (F.col("doc_id") == F.col("u_doc")) & (selectors.cell(F.col("node_id")) == F.col("u_cell")) & F.col("node_id").between(F.col("u"), F.col("u_end")))
    paths = joined.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("u", "step"))).alias("p")).select("doc_id", "node_id", F.array_join(F.transform("p", lambda x: x["step"]), "/").alias("path"))
    return nodes.join(paths, ["doc_id", "node_id"]).select("doc_id", "path", "kind", "tag", "data", "attr_map")


# --- queries from an element ---


def matches(nodes: DataFrame, starts: DataFrame, selector: str) -> DataFrame:
    """doc_id, node_id of starts and whether each matches the selector."""
    hits = selectors.select_all(nodes, selector).select("doc_id", "node_id", F.lit(True).alias("hit")).distinct()
    return starts.select("doc_id", "node_id").join(hits, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("hit", F.lit(False)).alias("matches"))


def select_within(nodes: DataFrame, starts: DataFrame, selector: str) -> DataFrame:
    """The matches below each start (not the start itself), with from_id. Compounds may match above the start."""
    return descendants(selectors.select_all(nodes, selector), starts)


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.where(F.col("kind") == "element") if tag == "*" else nodes.where((F.col("kind") == "element") & (F.col("tag") == tag))


def by_class(nodes: DataFrame, names: str) -> DataFrame:
    """The elements that have all the names."""
    out = nodes.where(F.col("kind") == "element")
    for name in names.split():
        out = out.where(F.array_contains("classes", name))
    return out


def first_element_child(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return children(nodes.where(F.col("elem_idx") == 1), starts)


def last_element_child(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return children(nodes.where(F.col("elem_idx_last") == 1), starts)


def next_element_sibling(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    placed = starts.select("doc_id", F.col("node_id").alias("from_id"), "parent_id", (F.col("elem_idx") + 1).alias("elem_idx"))
    return nodes.where(F.col("kind") == "element").join(placed, ["doc_id", "parent_id", "elem_idx"])


def child_element_count(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, from_id, n; starts without a child element are left out."""
    return children(nodes, starts).groupBy("doc_id", "from_id").agg(F.count("*").alias("n"))


# --- classList, style and document accessors ---


def class_add(classes: Column, name: str) -> Column:
    return F.when(F.array_contains(classes, name), classes).otherwise(F.concat(classes, F.array(F.lit(name))))


def class_remove(classes: Column, name: str) -> Column:
    return F.filter(classes, lambda c: c != name)


def class_toggle(classes: Column, name: str) -> Column:
    return F.when(F.array_contains(classes, name), class_remove(classes, name)).otherwise(class_add(classes, name))


def class_contains(classes: Column, name: str) -> Column:
    return F.array_contains(classes, name)


def style(attr_map: Column) -> Column:
    """element.style: the inline declarations as a map; of equal properties the last wins."""
    pairs = inline_declarations(F.coalesce(F.try_element_at(attr_map, F.lit("style")), F.lit("")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["property"] == p["property"]))
    return F.map_from_entries(last)


def document(nodes: DataFrame) -> DataFrame:
    """One row per page: doc_id, title (white space collapsed), the nodes of the document element, head and body, and the
    numbers of links, images, forms and scripts. One aggregate over the elements, and one join for the title's text."""
    elements = nodes.where(F.col("kind") == "element")
    first = lambda tag: F.min(F.when(F.col("tag") == tag, F.col("node_id"))).alias(tag)
    count = lambda test, name: F.count_if(test).alias(name)
    of = elements.groupBy("doc_id").agg(first("html"), first("head"), first("body"), count(F.col("tag").isin("a", "area") & F.map_contains_key("attr_map", "href"), "n_links"), count(F.col("tag") == "img", "n_images"), count(F.col("tag") == "form", "n_forms"), count(F.col("tag") == "script", "n_scripts"))
    title = selectors.text_content(nodes, selectors.select_first(nodes, "title")).select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")).alias("title"))
    return of.join(title, "doc_id", "left")
