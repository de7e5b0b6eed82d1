"""The CSS cascade as joins and aggregates: rules meet nodes by selector, the strongest declaration of each property
wins, inline style overwrites it, and inheritable properties come from the nearest ancestor that has one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.plans.selectors import SelectorError, _complex, cell, cells, parse_selector, specificity

# The properties that inherit.
INHERITED = (
    "color font font-family font-size font-weight font-style font-variant line-height text-align text-indent text-transform white-space letter-spacing word-spacing direction visibility cursor list-style "
    "list-style-type list-style-position list-style-image border-collapse border-spacing caption-side empty-cells quotes tab-size"
).split()
VIEWPORT = (1280, 720)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_VAR = re.compile(r"var\(\s*(--[\w-]+)\s*(?:,((?:[^()]|\([^()]*\))*))?\)")


def media_matches(query: str, width: int = VIEWPORT[0], height: int = VIEWPORT[1]) -> bool:
    """Commas are or, `and` is and; unknown conditions hold."""

    def one(part: str) -> bool:
        part = part.strip().lower()
        negate = part.startswith("not ")
        ok = True
        for cond in re.split(r"\s+and\s+", re.sub(r"^(?:not|only)\s+", "", part)):
            m = re.match(r"\(\s*(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)?\s*\)$", cond.strip())
            if m:
                limit = float(m[3]) * (16 if m[4] in ("em", "rem") else 1)
                have = width if m[2] == "width" else height
                ok = ok and (have >= limit if m[1] == "min" else have <= limit)
            elif cond.strip() in ("print", "speech"):
                ok = False
        return ok != negate

    return any(one(p) for p in query.split(",")) if query.strip() else True


def declarations(text: str) -> Iterator[tuple[str, str, bool]]:
    """(property, value, important); malformed ones are skipped."""
    for part in re.split(r";(?![^(]*\))", text):
        name, colon, value = part.partition(":")
        name, value = name.strip(), value.strip()
        if colon and name and value:
            bare = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I)
            yield (name if name.startswith("--") else name.lower()), bare, bare != value


def parse_css(css: str, media: str = "") -> list[tuple[str, str, list[tuple[str, str, bool]]]]:
    """(media, selector, declarations) of the style rules in order; @media and @supports are entered."""
    css, at, out = _COMMENT.sub(" ", css), 0, []
    while at < len(css):
        brace, semi = css.find("{", at), css.find(";", at)
        head = css[at : brace if brace >= 0 else len(css)].strip()
        if css[at:].lstrip().startswith("@") and 0 <= semi < (brace if brace >= 0 else len(css)):
            at = semi + 1
            continue
        if brace < 0:
            break
        depth, end = 1, brace + 1
        while end < len(css) and depth:
            depth += {"{": 1, "}": -1}.get(css[end], 0)
            end += 1
        inner = css[brace + 1 : end - (depth == 0)]
        if head.lower().startswith("@media"):
            out += parse_css(inner, head[6:].strip())
        elif head.lower().startswith("@supports"):
            out += parse_css(inner, media)
        elif not head.startswith("@"):
            out.append((media, head, list(declarations(inner))))
        at = end
    return out


def inline_declarations(style: Column) -> Column:
    """(property, value) pairs of a style attribute in order; a semicolon in brackets or quotes parts nothing."""
    parts = F.split(style, r""";(?=(?:[^"]*"[^"]*")*[^"]*$)(?=(?:[^']*'[^']*')*[^']*$)(?![^(]*\))""")
    name = lambda d: F.trim(F.regexp_extract(d, r"(?s)^([^:]*):", 1))
    value = lambda d: F.trim(F.regexp_replace(F.regexp_extract(d, r"(?s)^[^:]*:(.*)$", 1), r"(?i)\s*!\s*important\s*$", ""))
    pairs = F.transform(parts, lambda d: F.struct(F.when(name(d).startswith("--"), name(d)).otherwise(F.lower(name(d))).alias("property"), value(d).alias("value")))
    return F.filter(pairs, lambda p: (p["property"] != "") & (p["value"] != ""))


#: Attributes that set a property before any rule does, and on which elements.
HINTS = {"bgcolor": ("background-color", None), "color": ("color", ("font",)), "width": ("width", ("img", "table", "td", "th", "canvas", "video", "iframe")), "height": ("height", ("img", "table", "td", "th", "canvas", "video", "iframe")), "align": ("text-align", None)}


def presentation_hints(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, property, value by attributes; bare numbers of width and height are pixels."""
    parts = []
    for attribute, (name, tags) in HINTS.items():
        rows = nodes.where((F.col("kind") == "element") & F.map_contains_key("attr_map", attribute))
        rows = rows.where(F.col("tag").isin(*tags)) if tags else rows
        value = F.trim(F.element_at("attr_map", attribute))
        value = F.when(value.rlike(r"^\d+$"), F.concat(value, F.lit("px"))).otherwise(value) if name in ("width", "height") else value
        parts.append(rows.select("doc_id", "node_id", F.lit(name).alias("property"), value.alias("value")).where("value <> ''"))
    return reduce(DataFrame.unionByName, parts)


def computed_style(nodes: DataFrame, css: str, properties: tuple[str, ...] | None = None, viewport: tuple[int, int] = VIEWPORT) -> DataFrame:
    """doc_id, node_id, property, value: cascaded, then inherited. The sheet is the author's; its rules are the plan."""
    parts, order = [], 0
    for media, selector, decls in parse_css(css):
        order += 1
        if not media_matches(media, *viewport) or not decls:
            continue
        try:
            wanted = parse_selector(selector)
        except SelectorError:
            continue
        pairs = F.array(*(F.struct(F.lit(p).alias("property"), F.lit(v).alias("value"), F.lit(i).alias("important"), F.lit(k).alias("pos")) for k, (p, v, i) in enumerate(decls)))
        for c in wanted:
            a, b, t = specificity(c)
            hit = _complex(nodes, c, False).select("doc_id", "node_id", F.explode(pairs).alias("d"))
            parts.append(hit.select("doc_id", "node_id", "d.property", "d.value", F.struct(F.col("d.important").alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t"), F.lit(order).alias("o"), F.col("d.pos").alias("p")).alias("rank")))
    styled = nodes.where((F.col("kind") == "element") & F.map_contains_key("attr_map", "style"))
    inline = styled.select("doc_id", "node_id", F.posexplode(inline_declarations(F.element_at("attr_map", "style"))).alias("pos", "d"))
    inline = inline.select("doc_id", "node_id", "d.property", "d.value", F.struct(F.lit(True).alias("i"), F.lit(1 << 30).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("t"), F.lit(0).alias("o"), F.col("pos").alias("p")).alias("rank"))
    weakest = F.struct(F.lit(False).alias("i"), F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("t"), F.lit(0).alias("o"), F.lit(0).alias("p")).alias("rank")
    every = reduce(DataFrame.unionByName, parts, inline.unionByName(presentation_hints(nodes).select("*", weakest)))
    won = every.groupBy("doc_id", "node_id", "property").agg(F.max_by("value", "rank").alias("value"))
    if properties:
        won = won.where(F.col("property").isin(*properties))
    heirs = F.col("property").isin(*INHERITED) | F.col("property").startswith("--")
    spans = nodes.where(F.col("kind") == "element").select("doc_id", "node_id", "end_id")
    given = won.where(heirs).join(spans, ["doc_id", "node_id"]).select(F.col("doc_id").alias("d"), F.col("node_id").alias("a"), "end_id", "property", "value", F.explode(cells(F.col("node_id"), F.col("end_id"))).alias("cell"))
    below = spans.select("doc_id", "node_id").join(given, (F.col("doc_id") == F.col("d")) & (cell(F.col("node_id")) == F.col("cell")) & F.col("node_id").between(F.col("a"), F.col("end_id")))
    inherited = below.groupBy("doc_id", "node_id", "property").agg(F.max_by("value", "a").alias("value"))
    return won.where(~heirs).unionByName(inherited)


def substitute(value: str, custom: dict[str, str], depth: int = 16) -> str:
    """var() replaced by custom properties or fallbacks, to a bounded depth."""
    while depth and (m := _VAR.search(value)):
        value = value[: m.start()] + (custom.get(m[1]) or (m[2] or "").strip()) + value[m.end() :]
        depth -= 1
    return value.strip()


def resolve_vars(styles: DataFrame) -> DataFrame:
    """The ordinary properties of `computed_style` with var() resolved from the node's custom properties."""
    own = F.pandas_udf(lambda v, m: v.combine(m, lambda x, y: substitute(x, dict(y) if y is not None else {})), "string")
    custom = styles.where(F.col("property").startswith("--")).groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("custom"))
    plain = styles.where(~F.col("property").startswith("--"))
    has = plain.where(F.col("value").contains("var(")).join(custom, ["doc_id", "node_id"], "left")
    done = has.select("doc_id", "node_id", "property", own("value", "custom").alias("value"))
    return plain.where(~F.col("value").contains("var(")).unionByName(done)
