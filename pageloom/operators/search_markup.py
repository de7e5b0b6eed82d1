"""Search payloads in HTML, Atom and RSS as hits: one Python hop over all such payloads."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import resolve
from pageloom.operators.search import HIT
from pageloom.plans.match import Matcher
from pageloom.sources.html import ParseError, parse

# For each HTML provider its address, items (and items to fall back on), anchor, title and snippet.
HTML = {
    "duckduckgo": ("https://html.duckduckgo.com/html/", ("div.result, div.web-result",), "a.result__a, a.result__url", None, "a.result__snippet, div.result__snippet"),
    "brave": ("https://search.brave.com/search", ("div.snippet, div.result-wrapper",), "a[href]", ".title, h1, h2, h3", ".snippet-description, .snippet-content"),
    "mojeek": ("https://www.mojeek.com/search", ("ul.results-standard > li, li.result", "li.result, div.result"), "a.ob, a.title, h2 a, a.result-link", None, "p.s, p.snippet, p.desc, div.s"),
}
#: Hosts whose own pages are no hits, and redirects by host, path and parameter.
OWN = {"brave": "search.brave.com", "mojeek": "www.mojeek.com"}
REDIRECTS = {"duckduckgo": ("duckduckgo.com", "/l/", "uddg"), "bingnews": ("bing.com", "apiclick.aspx", "url")}
ATOM = "{http://www.w3.org/2005/Atom}"


def _target(provider: str, url: str | None) -> str | None:
    """The page that a link leads to, behind the provider's redirect."""
    if not url:
        return None
    s = urlsplit(url)
    if provider in REDIRECTS:
        host, path, name = REDIRECTS[provider]
        if (s.hostname or "").endswith(host) and s.path.lower().endswith(path):
            inner = next((unquote(v) for k, eq, v in (p.partition("=") for p in s.query.split("&")) if k == name and eq), None)
            if inner and inner.startswith(("http://", "https://")):
                return resolve(None, inner)
    return url if s.scheme in ("http", "https") and (s.hostname or "").lower() != OWN.get(provider) else None


def html_hits(provider: str, payload: str) -> Iterator[tuple]:
    """(url, title, snippet, extra)"""
    base, lists, anchor, title, snippet = HTML[provider]
    page = parse(payload)
    m, seen = Matcher(page), set()
    text = lambda k: (page.text(k).strip() or None) if k is not None else None
    items = next((found for s in lists if (found := m.all(s))), [])
    for item in items:
        a = m.first(anchor, item)
        href = page.attr(a, "href") if a is not None else None
        url = _target(provider, resolve(base, href) if (href or "").strip() else None)
        if url and url.lower() not in seen:
            seen.add(url.lower())
            yield url, text(m.first(title, item)) if title else text(a), text(m.first(snippet, item)), None


def feed_hits(provider: str, payload: str) -> Iterator[tuple]:
    root, seen = ElementTree.fromstring(payload), set()
    if provider == "arxiv":
        for e in root.iter(ATOM + "entry"):
            links = [x.get("href") for x in e.findall(ATOM + "link") if x.get("type") == "text/html" and x.get("href")]
            url = resolve(None, links[0] if links else e.findtext(ATOM + "id"))
            authors = [n.strip() for n in (x.findtext(ATOM + "name") or "" for x in e.findall(ATOM + "author")) if n.strip()]
            if url:
                yield url, (e.findtext(ATOM + "title") or "").strip() or None, (e.findtext(ATOM + "summary") or "").strip() or None, {"authors": "; ".join(authors)} if authors else None
        return
    for e in root.iter("item"):
        url = _target(provider, resolve(None, e.findtext("link")))
        if url and url.lower() not in seen:
            seen.add(url.lower())
            source = next((x.text for x in e if x.tag.rpartition("}")[2] == "Source" and x.text), None)
            extra = {k: v for k, v in (("source", source), ("publishedAt", e.findtext("pubDate"))) if v}
            yield url, e.findtext("title"), e.findtext("description"), extra or None


def parse_markup_hits(payloads: DataFrame) -> DataFrame:
    """Hits of the HTML, Atom and RSS providers from payloads (provider, payload). A broken payload gives none."""
    rows = payloads.select("provider", "payload").where(F.col("provider").isin(*HTML, "arxiv", "bingnews"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for provider, payload in b.itertuples(index=False, name=None):
                try:
                    found = list((html_hits if provider in HTML else feed_hits)(provider, payload or ""))
                except (ParseError, ElementTree.ParseError, ValueError):
                    found = []
                out += [(provider, k, *hit) for k, hit in enumerate(found)]
            yield pd.DataFrame(out, columns=["source", "rank", "url", "title", "snippet", "extra"])

    return rows.mapInPandas(run, HIT)
