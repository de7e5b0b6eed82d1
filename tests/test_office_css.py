import io
import zipfile

import pytest

from pageloom.operators.css import computed_style, declarations, media_matches, parse_css, resolve_vars, substitute
from pageloom.sources.office import detect, docx_blocks, docx_html, sheet_cells, to_pages, xlsx_html, xlsx_sheets
from pageloom.sources.pages import parse_pages

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'



def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


XLSX = pack({
    "[Content_Types].xml": "<Types><Override ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/></Types>",
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A3" s="1"><v>45000.5</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
})
DOCX = pack({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="http://x/"/></Relationships>',
})


def test_xlsx():
    (sheet,) = xlsx_sheets(XLSX)
    assert sheet["rows"] == [["a", "", "bc"], ["", "", ""], ["2023-03-15 12:00", "TRUE", "x"]] and sheet["merges"] == [(0, 0, 1, 1)]
    assert '<th rowspan="2" colspan="2">a</th><th>bc</th>' in xlsx_html(XLSX)


def test_docx():
    kinds = [(b["kind"], b["level"], b["ordered"], b["text"]) for b in docx_blocks(DOCX)]
    assert kinds == [("heading", 2, None, "Title"), ("paragraph", 0, None, "boldlink"), ("item", 0, True, "one"), ("item", 1, False, "two"), ("table", 0, None, "c1\tc2")]
    html = docx_html(DOCX)
    assert "<strong>bold</strong>" in html and '<a href="http://x/">link</a>' in html and "<ol><li>one<ul><li>two</li></ul></li></ol><table>" in html and "<title>Title</title>" in html


@pytest.mark.parametrize("body,kind,url,want", [(b"%PDF-1", None, None, "pdf"), (b"%PDF-1", "text/html", None, None), (b"", "application/pdf; x=1", None, "pdf"), (b"", None, "http://x/a.DOCX?q", "docx"), (XLSX, None, None, "xlsx"), (b"PK\x03\x04", None, "a.xlsx", "xlsx"), (b"x", None, "a.html", None)])
def test_detect(body, kind, url, want):
    assert detect(body, kind, url) == want


def test_tables(spark):
    rows = [(1, "a.xlsx", None, bytearray(XLSX)), (2, "b.docx", None, bytearray(DOCX)), (3, "c.docx", None, bytearray(b"broken")), (4, "d", "text/html", bytearray(b"<p>\xc3\xa9")), (5, "e.pdf", None, bytearray(b"%PDF-")), (6, None, None, None)]
    files = spark.createDataFrame(rows, "page_id int, url string, content_type string, body binary")
    got = {r.page_id: (r.kind, r.error is None) for r in to_pages(files).collect()}
    assert got == {1: ("xlsx", True), 2: ("docx", True), 3: ("docx", False), 4: (None, True), 5: ("pdf", True), 6: (None, True)}
    assert sheet_cells(files.where("page_id = 1")).where("value <> ''").count() == 5


CSS = "/* c */ p { color: red; margin: 1px !important } #a p { color: blue; margin: 2px } @media (max-width: 10px) { p { color: green } } @media screen and (min-width: 100px) { b { x: y } } body { font-size: 9px; --k: 4px } i { width: var(--k); height: var(--no, 7px) }"


def test_css(spark):
    assert [(m, s) for m, s, _ in parse_css(CSS)][:3] == [("", "p"), ("", "#a p"), ("(max-width: 10px)", "p")]
    assert list(declarations("a:b;c;D: e !important")) == [("a", "b", False), ("d", "e", True)]
    assert media_matches("print, (min-width: 1em)") and not media_matches("not all and (min-width: 1px)") and media_matches("")
    html = '<div id=a><p>1</p></div><p style="color: black">2<b>3</b></p><i>4</i>'
    nodes = parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    rows = resolve_vars(computed_style(nodes, CSS)).join(nodes.select("node_id", "tag"), "node_id").orderBy("node_id").collect()
    got = {}
    for r in rows:
        got.setdefault((r.tag, r.property), []).append(r.value)
    assert got["p", "color"] == ["blue", "black"] and got["p", "margin"] == ["1px", "1px"] and got["b", "color"] == ["black"] and got["b", "font-size"] == ["9px"] and ("b", "margin") not in got
    assert got["i", "width"] == ["4px"] and got["i", "height"] == ["7px"] and got["b", "x"] == ["y"]
    assert substitute("var(--a)", {"--a": "var(--a)"}, 3) == "var(--a)"
