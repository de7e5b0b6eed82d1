"""The relational form of pages: one row per node, numbered in document order with intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pageloom.sources.html import ParseError, parse

NODE = "node_id int, end_id int, parent_id int, depth int, kind string, tag string, attrs array<struct<name:string,value:string>>, attr_map map<string,string>, elem_id string, classes array<string>, data string, child_idx int, elem_idx int, elem_idx_last int, type_idx int, type_idx_last int, prev_kind string, error string"


def _rows(key, html: str | None) -> list[tuple]:
    try:
        p = parse(html or "")
    except ParseError as e:
        return [(key, 0, 0, -1, 0, "document", None, [], {}, None, [], None, 0, 0, 0, 0, 0, None, str(e))]
    n = len(p.kind)
    child, elem, kinds, last_elem, last_type = [0] * n, [0] * n, [0] * n, {}, {}
    seen: dict = {}
    before: list[str | None] = [None] * n
    for k in range(1, n):
        up = p.parent[k]
        child[k], before[k] = seen.get((up, "n"), 0), seen.get((up, "k"))
        seen[(up, "n")], seen[(up, "k")] = child[k] + 1, p.kind[k]
        if p.kind[k] == "element":
            elem[k] = last_elem[up] = last_elem.get(up, 0) + 1
            kinds[k] = last_type[(up, p.tag[k])] = last_type.get((up, p.tag[k]), 0) + 1
    out = []
    for k in range(n):
        up, is_element = p.parent[k], p.kind[k] == "element"
        names = dict(reversed(p.attrs[k]))
        classes = names.get("class", "").split()
        out.append((key, k, p.end[k], up, p.depth[k], p.kind[k], p.tag[k], [{"name": a, "value": v} for a, v in p.attrs[k]], names, names.get("id"), classes, p.data[k], child[k], elem[k], last_elem.get(up, 0) - elem[k] + 1 if is_element else 0, kinds[k], last_type[(up, p.tag[k])] - kinds[k] + 1 if is_element else 0, before[k], None))
    return out


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc_id and the node columns. One Python hop; pages that cannot be built give one row with an error."""
    source = pages.select(id_col, html_col)
    schema = f"doc_id {source.schema[0].dataType.simpleString()}, {NODE}"
    names = [c.strip().split(" ")[0] for c in schema.replace("struct<name:string,value:string>", "struct").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                rows = [r for k, h in zip(part.iloc[:, 0], part.iloc[:, 1], strict=True) for r in _rows(k, h)]
                out = pd.DataFrame(rows, columns=names)
                yield out

    return source.mapInPandas(run, schema)
