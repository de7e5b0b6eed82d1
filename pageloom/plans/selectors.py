"""CSS selectors: parsed to a small tree, then compiled to filters, semi joins and anti joins over the node table.

Every join carries doc_id, so Spark plans hash or sort-merge joins with a range condition, never a nested loop.
`+` looks at the directly preceding sibling node and `:has()` includes the element itself, unless spec=True.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectorError(ValueError):
    """The selector is not valid here."""


@dataclass
class Compound:
    tag: str | None = None
    tests: list[tuple] = field(default_factory=list)


@dataclass
class Complex:
    """compounds[k] and compounds[k + 1] stand in relation combinators[k]."""

    compounds: list[Compound]
    combinators: list[str]


_NAME = re.compile(r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*|--[\w-]*")
_NTH = re.compile(r"\s*(?:(even|odd)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)
_POSITION = {"first-child": ("elem_idx", 0, 1), "last-child": ("elem_idx_last", 0, 1), "first-of-type": ("type_idx", 0, 1), "last-of-type": ("type_idx_last", 0, 1)}
_NTH_OF = {"nth-child": "elem_idx", "nth-last-child": "elem_idx_last", "nth-of-type": "type_idx", "nth-last-of-type": "type_idx_last"}


class _Parser:
    def __init__(self, text: str):
        self.s, self.at = text, 0

    def fail(self, why: str):
        raise SelectorError(f"{why} at {self.at} in {self.s!r}")

    def blank(self) -> bool:
        m = re.compile(r"[ \t\r\n\f]*").match(self.s, self.at)
        self.at = m.end()
        return m.end() > m.start()

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def name(self) -> str:
        m = _NAME.match(self.s, self.at)
        if not m:
            self.fail("a name is missing")
        self.at = m.end()
        return re.sub(r"\\(.)", r"\1", m[0])

    def list(self, inner: bool = False) -> list[Complex]:
        out = [self.complex()]
        while self.peek() == ",":
            self.at += 1
            out.append(self.complex())
        if not inner and self.at < len(self.s):
            self.fail("unexpected text")
        return out

    def complex(self) -> Complex:
        self.blank()
        compounds, combinators = [self.compound()], []
        while True:
            space = self.blank()
            c = self.peek()
            if c in ("", ",", ")"):
                return Complex(compounds, combinators)
            if c in ">+~":
                self.at += 1
                self.blank()
            elif space:
                c = " "
            else:
                self.fail("unexpected text")
            combinators.append(c)
            compounds.append(self.compound())

    def compound(self) -> Compound:
        out, start = Compound(), self.at
        if self.peek() == "*":
            self.at += 1
        elif _NAME.match(self.s, self.at):
            out.tag = self.name().lower()
        while (c := self.peek()) and c in "#.[:":
            self.at += 1
            if c in "#.":
                out.tests.append(("id" if c == "#" else "class", self.name()))
            elif c == "[":
                out.tests.append(self.attribute())
            else:
                out.tests.append(self.pseudo())
        if self.at == start:
            self.fail("a selector is missing")
        return out

    def attribute(self) -> tuple:
        self.blank()
        name = self.name().lower()
        self.blank()
        m = re.compile(r"[~|^$*]?=").match(self.s, self.at)
        if not m:
            op = value = None
        else:
            self.at, op = m.end(), m[0]
            self.blank()
            quoted = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s\]]+)").match(self.s, self.at)
            if not quoted:
                self.fail("a value is missing")
            self.at, value = quoted.end(), next(v for v in quoted.groups() if v is not None)
            self.blank()
        fold = self.peek() in ("i", "I", "s", "S") and op is not None
        if fold:
            fold, self.at = self.peek() in "iI", self.at + 1
            self.blank()
        if self.peek() != "]":
            self.fail("] is missing")
        self.at += 1
        return ("attr", name, op, value, fold)

    def pseudo(self) -> tuple:
        if self.peek() == ":":
            self.fail("pseudo-elements are not supported")
        name = self.name().lower()
        if name in ("not", "is", "where", "has"):
            if self.peek() != "(":
                self.fail("( is missing")
            self.at += 1
            inner = self.list(inner=True)
            if self.peek() != ")":
                self.fail(") is missing")
            self.at += 1
            return (name, inner)
        if name in _NTH_OF:
            end = self.s.find(")", self.at)
            m = _NTH.match(self.s[self.at + 1 : end]) if self.peek() == "(" and end > 0 else None
            if not m:
                self.fail("a bad position")
            self.at = end + 1
            if m[1]:
                a, b = 2, int(m[1].lower() == "odd")
            elif m[5]:
                a, b = 0, int(m[5])
            else:
                a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
                b = int((m[3] or "+") + (m[4] or "0"))
            return ("nth", _NTH_OF[name], a, b)
        if name in _POSITION:
            return ("nth", *_POSITION[name])
        if name in ("only-child", "only-of-type"):
            return ("only", "elem_idx" if name == "only-child" else "type_idx")
        if name in ("root", "scope", "empty"):
            return (name if name == "empty" else "root",)
        self.fail(f"unknown pseudo-class :{name}")


def parse_selector(text: str) -> list[Complex]:
    return _Parser(text).list()


def specificity(c: Complex) -> tuple[int, int, int]:
    """(ids, classes and the like, types); :not() counts as its strongest argument."""
    a = b = t = 0
    for compound in c.compounds:
        t += compound.tag is not None
        for test in compound.tests:
            if test[0] == "id":
                a += 1
            elif test[0] == "not":
                x = max(map(specificity, test[1]))
                a, b, t = a + x[0], b + x[1], t + x[2]
            else:
                b += 1
    return a, b, t


def _attribute(name: str, op: str | None, value: str | None, fold: bool) -> Column:
    v = F.element_at("attr_map", name) if op else None
    if op is None:
        return F.map_contains_key("attr_map", name)
    v = F.coalesce(F.try_element_at("attr_map", F.lit(name)), F.lit(None).cast("string"))
    if fold:
        v, value = F.lower(v), value.lower()
    there = F.map_contains_key("attr_map", name)
    if op == "=":
        hit = v == value
    elif op == "|=":
        hit = (v == value) | v.startswith(value + "-")
    elif not value:
        return F.lit(False)
    elif op == "~=":
        hit = F.array_contains(F.split(v, r"[ \t\n\r\f]+"), value)
    else:
        hit = {"^=": v.startswith, "$=": v.endswith, "*=": v.contains}[op](value)
    return there & F.coalesce(hit, F.lit(False))


def _local(test: tuple) -> Column | None:
    """A test that one node row answers, or None."""
    kind = test[0]
    if kind == "id":
        return F.coalesce(F.col("elem_id") == test[1], F.lit(False))
    if kind == "class":
        return F.array_contains("classes", test[1])
    if kind == "attr":
        return _attribute(*test[1:])
    if kind == "nth":
        _, col, a, b = test
        return F.col(col) == b if a == 0 else ((F.col(col) - b) % a == 0) & ((F.col(col) - b) / a >= 0)
    if kind == "only":
        return (F.col(test[1]) == 1) & (F.col(test[1] + "_last") == 1)
    if kind == "root":
        return F.col("parent_id") == 0
    if kind in ("not", "is", "where"):
        inner = [_compound(c.compounds[0]) for c in test[1] if not c.combinators]
        if len(inner) < len(test[1]) or any(x is None for x in inner):
            return None
        any_of = reduce(lambda x, y: x | y, inner)
        return ~any_of if kind == "not" else any_of
    return None


def _compound(c: Compound) -> Column | None:
    tests = [_local(t) for t in c.tests]
    if any(t is None for t in tests):
        return None
    return reduce(lambda x, y: x & y, tests, (F.col("tag") == c.tag) if c.tag else F.lit(True))


#: Nodes to a cell. Subtrees are joined with their nodes by page and cell, so that a page of many nodes is dealt out to
#: many tasks, and a node meets only the subtrees that reach into its cell.
CELL = 256


def cell(node: Column) -> Column:
    return F.floor(node / CELL)


def cells(first: Column, last: Column) -> Column:
    """The cells that a subtree reaches into, to explode; none if it is empty."""
    return F.when(last >= first, F.sequence(cell(first), cell(last))).otherwise(F.array().cast("array<bigint>"))


_KEYS = ("doc_id", "node_id", "end_id", "parent_id", "child_idx", "elem_idx", "prev_kind")


def _matches(nodes: DataFrame, c: Compound, spec: bool) -> DataFrame:
    """The elements that satisfy a compound. Tests of one row are one filter; others are joins of the survivors."""
    elements = nodes.where(F.col("kind") == "element")
    local = [x for x in map(_local, c.tests) if x is not None]
    out = elements.where(reduce(lambda x, y: x & y, local, (F.col("tag") == c.tag) if c.tag else F.lit(True)))
    for test in c.tests:
        if _local(test) is not None:
            continue
        if test[0] == "empty":
            filled = nodes.where((F.col("kind") == "element") | ((F.col("kind") == "text") & (F.length("data") > 0))).select(F.col("doc_id").alias("d"), F.col("parent_id").alias("p"))
            out = out.join(filled, (F.col("doc_id") == F.col("d")) & (F.col("node_id") == F.col("p")), "left_anti")
        elif test[0] == "has":
            inner = _any(nodes, test[1], spec).select(F.col("doc_id").alias("d"), F.col("node_id").alias("x"))
            low = F.col("node_id") + 1 if spec else F.col("node_id")
            reach = out.select("doc_id", "node_id", "end_id", low.alias("low"), F.explode(cells(low, F.col("end_id"))).alias("cell"))
            on = (F.col("doc_id") == F.col("d")) & (F.col("cell") == cell(F.col("x"))) & F.col("x").between(F.col("low"), F.col("end_id"))
            out = out.join(reach.join(inner, on, "left_semi").select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
        else:
            inner = _any(nodes, test[1], spec).select(F.col("doc_id").alias("d"), F.col("node_id").alias("x"))
            out = out.join(inner, (F.col("doc_id") == F.col("d")) & (F.col("node_id") == F.col("x")), "left_anti" if test[0] == "not" else "left_semi")
    return out


def _complex(nodes: DataFrame, c: Complex, spec: bool) -> DataFrame:
    left = None
    for k, compound in enumerate(c.compounds):
        own = _matches(nodes, compound, spec)
        if left is None:
            left = own
            continue
        l = left.select(*(F.col(x).alias(f"l_{x}") for x in _KEYS))  # noqa: E741
        on = F.col("doc_id") == F.col("l_doc_id")
        if c.combinators[k - 1] == " ":
            l = l.withColumn("l_cell", F.explode(cells(F.col("l_node_id") + 1, F.col("l_end_id"))))  # noqa: E741
            on = on & (cell(F.col("node_id")) == F.col("l_cell")) & (F.col("node_id") > F.col("l_node_id")) & (F.col("node_id") <= F.col("l_end_id"))
        elif c.combinators[k - 1] == ">":
            on = on & (F.col("parent_id") == F.col("l_node_id"))
        else:
            on = on & (F.col("parent_id") == F.col("l_parent_id"))
            if c.combinators[k - 1] == "~":
                on = on & (F.col("l_elem_idx") < F.col("elem_idx"))
            elif spec:
                on = on & (F.col("l_elem_idx") == F.col("elem_idx") - 1)
            else:
                on = on & (F.col("l_child_idx") == F.col("child_idx") - 1)
        left = own.join(l, on, "left_semi")
    return left


def _any(nodes: DataFrame, selectors: list[Complex], spec: bool) -> DataFrame:
    flat = [_compound(c.compounds[0]) if not c.combinators else None for c in selectors]
    if all(x is not None for x in flat):
        return nodes.where((F.col("kind") == "element") & reduce(lambda x, y: x | y, flat))
    parts = [_complex(nodes, c, spec) for c in selectors]
    if len(parts) == 1:
        return parts[0]
    hits = reduce(DataFrame.unionByName, [p.select("doc_id", "node_id") for p in parts]).distinct()
    return nodes.join(hits, ["doc_id", "node_id"], "left_semi")


def select_all(nodes: DataFrame, selector: str, spec: bool = False) -> DataFrame:
    """The node rows that match, once each; document order is (doc_id, node_id)."""
    return _any(nodes, parse_selector(selector), spec)


def select_first(nodes: DataFrame, selector: str, spec: bool = False) -> DataFrame:
    """The first match of each page."""
    hits = select_all(nodes, selector, spec)
    first = hits.groupBy("doc_id").agg(F.min("node_id").alias("node_id"))
    return hits.join(first, ["doc_id", "node_id"], "left_semi")


def closest(nodes: DataFrame, starts: DataFrame, selector: str) -> DataFrame:
    """For each (doc_id, node_id) of starts: the node itself or its nearest ancestor that matches, as closest_id."""
    hits = select_all(nodes, selector).select("doc_id", F.col("node_id").alias("a"), "end_id", F.explode(cells(F.col("node_id"), F.col("end_id"))).alias("cell"))
    near = starts.select("doc_id", "node_id", cell(F.col("node_id")).alias("cell")).join(hits, ["doc_id", "cell"]).where(F.col("node_id").between(F.col("a"), F.col("end_id")))
    return near.groupBy("doc_id", "node_id").agg(F.max("a").alias("closest_id"))


def text_content(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, node_id, text: the descendant text of each hit, in document order."""
    h = hits.select("doc_id", "node_id", "end_id", F.explode(cells(F.col("node_id"), F.col("end_id"))).alias("cell"))
    t = nodes.where(F.col("kind") == "text").select(F.col("doc_id").alias("d"), F.col("node_id").alias("t"), "data")
    joined = h.join(t, (F.col("doc_id") == F.col("d")) & (F.col("cell") == cell(F.col("t"))) & F.col("t").between(F.col("node_id"), F.col("end_id")), "left")
    grouped = joined.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "data")))).alias("parts"))
    return grouped.select("doc_id", "node_id", F.array_join(F.transform("parts", lambda p: p["data"]), "").alias("text"))
