"""Registered queries of document readers, decoding and search providers, on files made from the tables, and their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators import search
from pageloom.queries import _t, query
from pageloom.sources import office, pdf

# --- files made from rows ---


def _pdf(text: Column, link: Column) -> Column:
    """A one-page file that shows a text and links it."""
    content = F.concat(F.lit("BT /F1 12 Tf 50 700 Td ("), text, F.lit(") Tj ET"))
    parts = [
        F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Contents 4 0 R /Annots [6 0 R] /Resources << /Font << /F1 5 0 R >> >> >> endobj\n4 0 obj << /Length "), F.length(content).cast("string"), F.lit(" >>\nstream\n"), content,
        F.lit("\nendstream endobj\n5 0 obj << /Type /Font /Subtype /Type1 >> endobj\n6 0 obj << /Subtype /Link /Rect [40 690 400 712] /A << /URI ("), link, F.lit(") >> >> endobj\ntrailer << /Root 1 0 R >>\n%%EOF"),
    ]
    return F.encode(F.concat(*parts), "ISO-8859-1")


def _packed(rows: DataFrame, make: Callable[[str, int], dict[str, str]]) -> DataFrame:
    """page_id, url, content_type and body, a zip package of the parts that make gives for a text and a number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, url, text, number in b.itertuples(index=False, name=None):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    for name, part in make(text, number).items():
                        z.writestr(name, part)
                out.append((key, url, None, buffer.getvalue()))
            yield pd.DataFrame(out, columns=["page_id", "url", "content_type", "body"])

    return rows.select("page_id", "url", "text", "number").mapInPandas(run, "page_id long, url string, content_type string, body binary")


def _customers(spark, d, suffix: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("http://h/"), "c_custkey", F.lit(suffix)).alias("url"), F.col("c_name").alias("text"), F.col("c_nationkey").alias("number"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _docx(text: str, number: int) -> dict[str, str]:
    p = lambda inner, style="": f"<w:p>{style}<w:r>{inner}</w:r></w:p>"
    body = p(f"<w:t>{text}</w:t>", '<w:pPr><w:pStyle w:val="H"/></w:pPr>') + p(f"<w:rPr><w:b/></w:rPr><w:t>nation {number}</w:t>")
    return {"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>'}


def _xlsx(text: str, number: int) -> dict[str, str]:
    cells = f'<row r="1"><c r="A1" t="inlineStr"><is><t>{text}</t></is></c><c r="B1"><v>{number}</v></c></row><row r="2"><c r="B2" t="b"><v>1</v></c></row>'
    return {
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f"<worksheet {_S}><sheetData>{cells}</sheetData></worksheet>",
    }


@query("select c_custkey as page_id, 0 as page_no, 50.0::double as x, 700.0::double as y, c_name as text, 'http://h/' || c_custkey as href, null::varchar as error from customer")
def pdf_runs(spark, d):
    """Text runs of PDF files with their place and link."""
    rows = _customers(spark, d, "")
    return pdf.run_table(rows.select("page_id", _pdf(F.col("text"), F.col("url")).alias("body")))


@query("select c_custkey as page_id, 'pdf' as kind, c_name as text, null::varchar as error from customer where c_custkey % 4 <> 0 union all select c_custkey, 'pdf', 'This document cannot be read.', 'no PDF header' from customer where c_custkey % 4 = 0")
def pdf_pages(spark, d):
    """PDF files as article pages; a broken file is a row with its error."""
    body = F.when(F.col("page_id") % 4 == 0, F.encode(F.lit("broken"), "UTF-8")).otherwise(_pdf(F.col("text"), F.col("url")))
    files = _customers(spark, d, ".pdf").select("page_id", "url", F.lit("application/pdf").alias("content_type"), body.alias("body"))
    return office.to_pages(files).select("page_id", "kind", F.regexp_extract("html", "<p>(.*?)</p>", 1).alias("text"), "error")


@query("select c_custkey as page_id, 'docx' as kind, '<h1>' || c_name || '</h1><p><strong>nation ' || c_nationkey || '</strong></p>' as inner_html, c_name as title, null::varchar as error from customer")
def docx_pages(spark, d):
    pages = office.to_pages(_packed(_customers(spark, d, ".docx"), _docx))
    return pages.select("page_id", "kind", F.regexp_extract("html", "<article>(.*)</article>", 1).alias("inner_html"), F.regexp_extract("html", "<title>(.*)</title>", 1).alias("title"), "error")


@query("select c_custkey as page_id, 'One' as sheet, x.r as row, x.c as col, x.v as value from (select c_custkey, unnest([{'r': 0, 'c': 0, 'v': c_name}, {'r': 0, 'c': 1, 'v': c_nationkey::varchar}, {'r': 1, 'c': 0, 'v': ''}, {'r': 1, 'c': 1, 'v': 'TRUE'}]) as x from customer)")
def xlsx_cells(spark, d):
    return office.sheet_cells(_packed(_customers(spark, d, ".xlsx"), _xlsx).select("page_id", "body"))


@query("""select page_id, md5(case when page_id % 4 = 3 then regexp_replace(html, '[^\\x00-\\x7F\\xA0-\\xFF]', '?', 'g') else html end) as html, null::varchar as kind from pages""")
def page_encodings(spark, d):
    """Bodies by byte order mark, by the header's charset, and by default, decoded to the same text."""
    k, h = F.col("page_id") % 4, F.col("html")
    latin = F.encode(F.regexp_replace(h, r"[^\x00-\x7F\xA0-\xFF]", "?"), "ISO-8859-1")
    body = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(h, "UTF-8"))).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(h, "UTF-16LE"))).when(k == 2, F.encode(h, "UTF-8")).otherwise(latin)
    files = _t(spark, d, "pages").select("page_id", "url", F.when(k == 3, "text/html; charset=ISO-8859-1").otherwise("text/html").alias("content_type"), body.alias("body"))
    return office.to_pages(files).select("page_id", F.md5("html").alias("html"), "kind")


@query("select page_id, case page_id % 5 when 0 then 'pdf' when 1 then 'docx' when 2 then null when 3 then 'xlsx' end as kind from pages")
def document_kinds(spark, d):
    """What a body is, by type and suffix."""
    k = F.col("page_id") % 5
    kind = F.when(k == 0, "application/pdf; v=1").when(k == 2, "text/html").otherwise(None)
    url = F.when(k == 1, "http://h/a.DOCX?q=.pdf").when(k == 2, "http://h/a.pdf").when(k == 3, "http://h/b.xlsx#f").otherwise("http://h/c")
    return _t(spark, d, "pages").select("page_id", office.kind_by_name(kind, url).alias("kind"))


# --- search providers ---

#: For each provider: what stands before and after the items of an answer, and an item, as SQL over u, t and n (address,
#: title and number, both safe to quote).
ANSWERS = {
    "github": ('{"items":[', ",", "]}", """'{"html_url":"' || u || '","full_name":"' || t || '"}'"""),
    "hackernews": ('{"hits":[', ",", "]}", """'{"objectID":"' || n || '","url":"' || u || '","title":"' || t || '"}'"""),
    "stackexchange": ('{"items":[', ",", "]}", """'{"link":"' || u || '","title":"' || t || '"}'"""),
    "crossref": ('{"message":{"items":[', ",", "]}}", """'{"URL":"' || u || '","title":["' || t || '"]}'"""),
    "openlibrary": ('{"docs":[', ",", "]}", """'{"key":"/works/' || n || '","title":"' || t || '"}'"""),
    "reddit": ('{"data":{"children":[', ",", "]}}", """'{"data":{"permalink":"/r/' || n || '","title":"' || t || '"}}'"""),
    "gdelt": ('{"articles":[', ",", "]}", """'{"url":"' || u || '","title":"' || t || '"}'"""),
    "guardian": ('{"response":{"results":[', ",", "]}}", """'{"webUrl":"' || u || '","webTitle":"' || t || '"}'"""),
    "duckduckgo": ("<html><body>", "", "</body></html>", """'<div class="result"><a class="result__a" href="' || u || '">' || t || '</a></div>'"""),
    "brave": ("<html><body>", "", "</body></html>", """'<div class="snippet"><a href="' || u || '"><div class="title">' || t || '</div></a></div>'"""),
    "mojeek": ('<html><body><ul class="results-standard">', "", "</ul></body></html>", """'<li><a class="ob" href="' || u || '">' || t || '</a></li>'"""),
    "arxiv": ('<feed xmlns="http://www.w3.org/2005/Atom">', "", "</feed>", """'<entry><id>' || u || '</id><title>' || t || '</title></entry>'"""),
    "bingnews": ("<rss><channel>", "", "</channel></rss>", """'<item><title>' || t || '</title><link>' || u || '</link></item>'"""),
}
_URLS = {"openlibrary": "'https://openlibrary.org/works/' || n", "reddit": "'https://www.reddit.com/r/' || n"}
_BY_PROVIDER = " union all ".join(f"select '{p}' as source, rank, {_URLS.get(p, 'u')} as url, t as title from s where k = {i}" for i, p in enumerate(ANSWERS))


@query(f"with s as (select c_custkey as n, 'http://h.org/' || c_custkey as u, 'Hit ' || c_custkey as t, c_custkey % {len(ANSWERS)} as k, (row_number() over (partition by c_custkey % {len(ANSWERS)} order by c_custkey) - 1)::int as rank from customer) {_BY_PROVIDER}")
def search_providers(spark, d):
    """The hits of thirteen providers from answers in their formats."""
    c = _t(spark, d, "customer").selectExpr("c_custkey as n", "concat('http://h.org/', c_custkey) as u", "concat('Hit ', c_custkey) as t", f"c_custkey % {len(ANSWERS)} as k")
    parts = []
    for i, (provider, (head, between, tail, item)) in enumerate(ANSWERS.items()):
        rows = c.where(F.col("k") == i).select("n", F.expr(item).alias("item"))
        items = F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"])
        parts.append(rows.agg(F.concat(F.lit(head), F.array_join(items, between), F.lit(tail)).alias("payload")).select(F.lit(provider).alias("provider"), "payload"))
    return search.fan_in(reduce(DataFrame.unionByName, parts), search.flags_of("all")).select("source", "rank", "url", "title")
