"""Office documents as tables: kind detection, xlsx cells, docx blocks, and HTML that re-enters the page pipeline."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Content types and suffixes by kind, and number formats that show dates.
TYPES = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx"}
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TEXT_LIKE = re.compile(r"^text/|xhtml|xml$|json|javascript")


def detect(body: bytes, content_type: str | None, url: str | None) -> str | None:
    """pdf, docx, xlsx or None: the content type decides, then the first bytes (never for text types), then the suffix."""
    kind = (content_type or "").split(";")[0].strip().lower()
    if kind in TYPES:
        return TYPES[kind]
    if not _TEXT_LIKE.search(kind):
        if body.startswith(b"%PDF-"):
            return "pdf"
        if body.startswith(b"PK\x03\x04"):
            try:
                parts = zipfile.ZipFile(io.BytesIO(body)).read("[Content_Types].xml").decode("utf-8", "replace")
                found = next((k for t, k in TYPES.items() if t in parts), None)
                if found:
                    return found
            except (zipfile.BadZipFile, KeyError):
                pass
        path = re.sub(r"[?#].*$", "", url or "").lower()
        return next((k for k in ("pdf", "docx", "xlsx") if path.endswith("." + k)), None)
    return None


def kind_by_name(content_type: Column, url: Column) -> Column:
    """The cheap part of `detect`, in Spark: by type, then by suffix, for filters before any Python."""
    t = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    out = F.lit(None).cast("string")
    for kind in ("pdf", "docx", "xlsx"):
        out = F.when(F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith("." + kind), kind).otherwise(out)
    out = F.when(t.rlike(_TEXT_LIKE.pattern), F.lit(None).cast("string")).otherwise(out)
    for name, kind in TYPES.items():
        out = F.when(t == name, kind).otherwise(out)
    return out


class _Package:
    def __init__(self, body: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(body))

    def xml(self, name: str) -> ElementTree.Element | None:
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except KeyError:
            return None

    def relations(self, name: str) -> dict[str, str]:
        folder, _, file = name.rpartition("/")
        root = self.xml(f"{folder}/_rels/{file}.rels")
        return {r.get("Id"): r.get("Target") for r in root} if root is not None else {}


def _position(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _date(value: str) -> str:
    try:
        at = datetime(1899, 12, 30) + timedelta(days=float(value))
    except (ValueError, OverflowError):
        return value
    at = (at + timedelta(milliseconds=500)).replace(microsecond=0)
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M")


def xlsx_sheets(body: bytes) -> list[dict]:
    """name, rows (a rectangle of strings) and merges (row0, col0, row1, col1) of each sheet in workbook order."""
    p = _Package(body)
    strings = [("".join(t.text or "" for t in si.iter(_S + "t"))) for si in (p.xml("xl/sharedStrings.xml") if p.xml("xl/sharedStrings.xml") is not None else ())]
    styles, dates = p.xml("xl/styles.xml"), []
    if styles is not None:
        custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"', "", f.get("formatCode", "")) for f in styles.iter(_S + "numFmt")}
        cells = styles.find(_S + "cellXfs")
        for xf in cells if cells is not None else ():
            k = int(xf.get("numFmtId", 0))
            dates.append(k in DATE_FORMATS or bool(re.search("[ydsmhYDSMH]", custom.get(k, ""))))
    rels, out = p.relations("xl/workbook.xml"), []
    book = p.xml("xl/workbook.xml")
    for sheet in book.iter(_S + "sheet") if book is not None else ():
        target = rels.get(sheet.get(_R + "id"), "")
        root = p.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        grid: dict[tuple[int, int], str] = {}
        merges: list[tuple[int, ...]] = []
        if root is not None:
            for c in root.iter(_S + "c"):
                if not c.get("r"):
                    continue
                kind, v = c.get("t"), c.find(_S + "v")
                value = v.text or "" if v is not None else ""
                if kind == "s":
                    value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(_S + "t"))
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind in (None, "n") and value and int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                    value = _date(value)
                grid[_position(c.get("r"))] = value
            for m in root.iter(_S + "mergeCell"):
                a, _, b = m.get("ref").partition(":")
                merges.append((*_position(a), *_position(b or a)))
        height, width = max((r for r, _ in grid), default=-1) + 1, max((c for _, c in grid), default=-1) + 1
        out.append({"name": sheet.get("name"), "rows": [[grid.get((r, c), "") for c in range(width)] for r in range(height)], "merges": merges})
    return out


def _run_text(run: ElementTree.Element) -> str:
    out = []
    for x in run:
        out.append(x.text or "" if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag == _W + "br" else "")
    return "".join(out)


def _on(run: ElementTree.Element, name: str) -> bool:
    props = run.find(_W + "rPr")
    mark = props.find(_W + name) if props is not None else None
    return mark is not None and mark.get(_W + "val", "1") not in ("0", "false", "none")


def docx_blocks(body: bytes) -> list[dict]:
    """kind (heading, paragraph, item, table), level, ordered, text and html of the body's blocks in order."""
    p = _Package(body)
    doc, rels, levels = p.xml("word/document.xml"), p.relations("word/document.xml"), {}
    styles, numbering = p.xml("word/styles.xml"), p.xml("word/numbering.xml")
    for s in styles.iter(_W + "style") if styles is not None else ():
        level = s.find(f"{_W}pPr/{_W}outlineLvl")
        named = s.find(_W + "name")
        m = re.match(r"heading (\d)$", (named.get(_W + "val") if named is not None else "") or "", re.I)
        if level is not None or m:
            levels[s.get(_W + "styleId")] = int(level.get(_W + "val")) + 1 if level is not None else int(m[1])
    abstract, ordered = {}, {}
    if numbering is not None:
        for a in numbering.iter(_W + "abstractNum"):
            abstract[a.get(_W + "abstractNumId")] = {lv.get(_W + "ilvl"): lv.find(_W + "numFmt").get(_W + "val") not in ("bullet", "none") for lv in a.iter(_W + "lvl") if lv.find(_W + "numFmt") is not None}
        ordered = {n.get(_W + "numId"): abstract.get(n.find(_W + "abstractNumId").get(_W + "val"), {}) for n in numbering.iter(_W + "num") if n.find(_W + "abstractNumId") is not None}

    def inline(node: ElementTree.Element) -> tuple[str, str]:
        text, html = [], []
        for x in node:
            if x.tag == _W + "r":
                t = _run_text(x)
                h = escape(t, False).replace("\n", "<br>")
                for name, tag in (("u", "u"), ("i", "em"), ("b", "strong")):
                    h = f"<{tag}>{h}</{tag}>" if h and _on(x, name) else h
                text.append(t)
                html.append(h)
            elif x.tag == _W + "hyperlink":
                t, h = inline(x)
                target = rels.get(x.get(_R + "id"))
                text.append(t)
                html.append(f'<a href="{escape(target)}">{h}</a>' if target else h)
            elif x.tag in (_W + "ins", _W + "smartTag", _W + "sdt", _W + "sdtContent"):
                t, h = inline(x)
                text.append(t)
                html.append(h)
        return "".join(text), "".join(html)

    def blocks(node: ElementTree.Element) -> Iterator[dict]:
        for x in node:
            if x.tag == _W + "p":
                text, html = inline(x)
                style = x.find(f"{_W}pPr/{_W}pStyle")
                own = x.find(f"{_W}pPr/{_W}outlineLvl")
                number = x.find(f"{_W}pPr/{_W}numPr/{_W}numId")
                level = int(own.get(_W + "val")) + 1 if own is not None else levels.get(style.get(_W + "val")) if style is not None else None
                if level and level <= 9:
                    yield {"kind": "heading", "level": min(level, 6), "ordered": None, "text": text, "html": f"<h{min(level, 6)}>{html}</h{min(level, 6)}>"}
                elif number is not None and number.get(_W + "val") != "0":
                    depth = x.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
                    depth = depth.get(_W + "val") if depth is not None else "0"
                    yield {"kind": "item", "level": int(depth), "ordered": ordered.get(number.get(_W + "val"), {}).get(depth, False), "text": text, "html": html}
                elif text.strip():
                    yield {"kind": "paragraph", "level": 0, "ordered": None, "text": text, "html": f"<p>{html}</p>"}
            elif x.tag == _W + "tbl":
                rows = [["".join(b["html"] if b["kind"] == "table" else re.sub(r"^<p>|</p>$", "", b["html"]) for b in blocks(c)) for c in r.findall(_W + "tc")] for r in x.findall(_W + "tr")]
                yield {"kind": "table", "level": 0, "ordered": None, "text": "\n".join("\t".join(re.sub("<[^>]*>", "", c) for c in r) for r in rows), "html": "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"}
            elif x.tag == _W + "sdt":
                inner = x.find(_W + "sdtContent")
                yield from blocks(inner) if inner is not None else ()

    found = doc.find(_W + "body") if doc is not None else None
    return list(blocks(found)) if found is not None else []


def _page(title: str | None, inner: str) -> str:
    return f"<!DOCTYPE html><html><head><title>{escape(title or '', False)}</title></head><body><article>{inner}</article></body></html>"


def docx_html(body: bytes, title: str | None = None) -> str:
    """An article page; neighbouring items form nested lists."""
    out, open_ = [], []
    found = docx_blocks(body)
    for b in found:
        if b["kind"] != "item":
            while open_:
                out.append(f"</li></{open_.pop()}>")
            out.append(b["html"])
            continue
        while len(open_) > b["level"] + 1:
            out.append(f"</li></{open_.pop()}>")
        if len(open_) == b["level"] + 1:
            out.append("</li>")
        while len(open_) < b["level"] + 1:
            open_.append("ol" if b["ordered"] else "ul")
            out.append(f"<{open_[-1]}>")
        out.append(f"<li>{b['html']}")
    while open_:
        out.append(f"</li></{open_.pop()}>")
    first = next((b["text"] for b in found if b["kind"] == "heading"), None)
    return _page(title or first, "".join(out))


def xlsx_html(body: bytes, title: str | None = None) -> str:
    """An article page with a table for each sheet; merged ranges become spans."""
    out = []
    for sheet in xlsx_sheets(body):
        hidden = {(r, c) for r0, c0, r1, c1 in sheet["merges"] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) != (r0, c0)}
        spans = {(r0, c0): (r1 - r0 + 1, c1 - c0 + 1) for r0, c0, r1, c1 in sheet["merges"]}
        out.append(f"<h2>{escape(sheet['name'] or '', False)}</h2><table>")
        for r, row in enumerate(sheet["rows"]):
            out.append("<tr>")
            for c, v in enumerate(row):
                if (r, c) not in hidden:
                    down, across = spans.get((r, c), (1, 1))
                    extra = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{across}"' if across > 1 else "")
                    out.append(f"<{'td' if r else 'th'}{extra}>{escape(v, False)}</{'td' if r else 'th'}>")
            out.append("</tr>")
        out.append("</table>")
    return _page(title, "".join(out))


def to_pages(files: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, url, html, kind, error of files (id, url, content_type, body): documents become article pages, all else is
    decoded text. A file that cannot be read gives a row with its error, never a failed job."""
    from pageloom.sources.html import decode
    from pageloom.sources.pdf import PdfError, pdf_html

    source = files.select(id_col, "url", "content_type", "body")

    def one(key, url, content_type, body) -> tuple:
        body = bytes(body or b"")
        kind = detect(body, content_type, url)
        try:
            if kind == "docx":
                return key, url, docx_html(body), kind, None
            if kind == "xlsx":
                return key, url, xlsx_html(body), kind, None
            if kind == "pdf":
                try:
                    return key, url, _page(None, pdf_html(body)), kind, None
                except PdfError as e:
                    return key, url, _page(None, "<p>This document cannot be read.</p>"), kind, str(e)
            return key, url, decode(body, content_type), None, None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError, TypeError) as e:
            return key, url, None, kind, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(*r) for r in b.itertuples(index=False, name=None)], columns=[id_col, "url", "html", "kind", "error"])

    return source.mapInPandas(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, url string, html string, kind string, error string")


def sheet_cells(files: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, sheet, row, col, value of xlsx bodies."""
    source = files.select(id_col, "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, s["name"], r, c, v) for k, body in b.itertuples(index=False, name=None) for s in xlsx_sheets(bytes(body)) for r, row in enumerate(s["rows"]) for c, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=[id_col, "sheet", "row", "col", "value"])

    return source.mapInPandas(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, sheet string, row int, col int, value string")
