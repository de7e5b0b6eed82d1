"""Article extraction from a parsed page: metadata, content root, plain text, links, images and navigation.

Scores come from prefix sums over the pre-order node list, so a page costs O(nodes), not O(candidates x nodes).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from pageloom.functions.urls import is_page_link, resolve
from pageloom.operators.render import to_html, to_json, to_markdown
from pageloom.sources.html import Page, ParseError, parse

# The tokens that class and id are searched for, and the weights of the score.
NOISE = "nav navbar navigation sidebar side-bar footer header menu breadcrumb pagination share social comments comment- related recommended trending popular advert ads- promo newsletter subscribe cookie consent gdpr popup modal search-results skip-link hidden".split()
CONTENT = "article post story entry content main body-text post-body article-body story-body blog-post markdown".split()
STRIPPED = frozenset("script style noscript iframe svg button form input select textarea nav aside template".split())
BLOCKS = frozenset("p div article section main header footer aside nav blockquote pre li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tr td th figure figcaption hr details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BYLINES = (("a", "rel", "author"), (None, "itemprop", "author"), (None, "class", "byline"), (None, "class", "author"), (None, "class", "post-author"), (None, "class", "article-author"))
_NOISE, _CONTENT = (re.compile("|".join(map(re.escape, words)), re.I) for words in (NOISE, CONTENT))
_CARD = re.compile(r"(?:^|[ \t\r\n\f])(?:card|tile|\S*-card|\S*-tile|\S*card-\S*)(?=$|[ \t\r\n\f])", re.I)
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}]+")


def units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def collapse(s: str) -> str:
    return _RUN.sub(" ", s).strip()


def paragraphs(s: str) -> str:
    """Runs of white space become a paragraph break if they hold two line ends, else one space."""
    return _RUN.sub(lambda m: "\n\n" if m[0].count("\n") > 1 else " ", s).strip()


def names_of(p: Page, k: int) -> str:
    return f"{p.attr(k, 'class') or ''} {p.attr(k, 'id') or ''}".strip()


def content_root(p: Page) -> int | None:
    """The best-scored candidate, the first one on a tie; body if none qualifies."""
    n = len(p.kind)
    text, link, inside = [0] * n, [0] * n, -1
    paras, heads, cards = [0] * n, [0] * n, [0] * n
    for k in range(n):
        if p.kind[k] == "element":
            if p.tag[k] == "a":
                inside = max(inside, p.end[k])
            paras[k], heads[k] = p.tag[k] == "p", p.tag[k] in HEADINGS
            cards[k] = bool(_CARD.search(p.attr(k, "class") or ""))
        elif p.kind[k] == "text":
            text[k] = units(p.data[k])
            link[k] = text[k] if k <= inside else 0
    sums = [[0, *accumulate(x)] for x in (text, link, paras, heads, cards)]
    best, top = None, float("-inf")
    for k in range(n):
        if p.kind[k] != "element" or p.tag[k] not in ("article", "main", "section", "div", "body"):
            continue
        size, linked, np_, nh, nc = (s[p.end[k] + 1] - s[k] for s in sums)
        own_card = cards[k]
        nc -= own_card
        if size < 100:
            continue
        density, grid = linked / size, nc >= 3 and nh >= 3
        if density > (0.95 if grid else 0.5):
            continue
        score = size * (1 - density) + 30 * np_ + 20 * nh + (500 * nc if grid else 0)
        names = names_of(p, k)
        if p.tag[k] in ("article", "main"):
            score *= 1.5
        if _NOISE.search(names):
            score -= 2000
        if _CONTENT.search(names):
            score += 1000
        if (p.attr(k, "role") or "").lower() in ("main", "article"):
            score *= 1.4
        if (p.attr(k, "aria-hidden") or "").lower() == "true" or p.attr(k, "hidden") is not None:
            score -= 5000
        if score > top:
            best, top = k, score
    return best if best is not None else next((k for k in range(n) if p.tag[k] == "body"), None)


def kept_nodes(p: Page, root: int) -> list[int]:
    """The nodes under root without noise, in document order. The root itself always stays."""
    out, k = [root], root + 1
    while k <= p.end[root]:
        if p.kind[k] == "element" and (p.tag[k] in STRIPPED or _NOISE.search(names_of(p, k))):
            k = p.end[k] + 1
            continue
        out.append(k)
        k += 1
    return out


def plain_text(p: Page, nodes: list[int]) -> str:
    out, closing = [], []
    for k in nodes:
        while closing and k > closing[-1]:
            closing.pop()
            out.append("\n\n")
        if p.kind[k] == "text":
            out.append(p.data[k])
        elif p.kind[k] == "element":
            if p.tag[k] in BLOCKS:
                out.append("\n\n")
                closing.append(p.end[k])
            elif p.tag[k] == "br":
                out.append("\n")
    return paragraphs("".join(out))


def metadata(p: Page) -> dict[str, str]:
    """The first non-blank content of each name, property or itemprop in head."""
    head = next((k for k in range(len(p.kind)) if p.tag[k] == "head"), None)
    out: dict[str, str] = {}
    for k in range(len(p.kind)):
        if p.tag[k] == "meta" and p.parent[k] == head:
            key = next((v for v in (p.attr(k, "name"), p.attr(k, "property"), p.attr(k, "itemprop")) if v is not None), None)
            value = (p.attr(k, "content") or "").strip()
            if key and value:
                out.setdefault(key.lower(), value)
    return out


def _byline(p: Page) -> str | None:
    for tag, attr, want in BYLINES:
        for k in range(len(p.kind)):
            value = p.attr(k, attr) if p.kind[k] == "element" and (tag is None or p.tag[k] == tag) else None
            if value is not None and (want in value.split() if attr == "class" else value == want):
                text = p.text(k).strip()
                if 0 < units(text) < 200:
                    return text
                break
    return None


def _links(p: Page, nodes: list[int], base: str | None, label: bool) -> list[dict]:
    """Anchors by resolved URL, the first of each; an unlabelled first one hides later ones."""
    out, seen, keep = [], set(), set(nodes)
    for k in nodes:
        if p.tag[k] != "a" or not is_page_link(p.attr(k, "href")):
            continue
        url = resolve(base, p.attr(k, "href"))
        if not url or url in seen:
            continue
        seen.add(url)
        text = collapse("".join(p.data[j] for j in range(k, p.end[k] + 1) if p.kind[j] == "text" and (label or j in keep)))
        if label and not text:
            alts = [p.attr(j, "alt") for j in range(k, p.end[k] + 1) if p.tag[j] == "img"]
            text = next((collapse(v) for v in (p.attr(k, "aria-label"), p.attr(k, "title"), *alts) if v and v.strip()), "")
        if text:
            out.append({"href": url, "text": text})
    return out


def extract(p: Page, url: str | None) -> dict:
    """The article record of a page."""
    meta, elements = metadata(p), range(len(p.kind))
    title = next((p.text(k).strip() for k in elements if p.tag[k] == "title"), None)
    root_html = next((k for k in elements if p.tag[k] == "html"), 0)
    in_nav, navs = set(), []
    for k in elements:
        if p.kind[k] == "element" and (p.tag[k] == "nav" or (p.attr(k, "role") or "").lower() == "navigation"):
            navs += [j for j in range(k, p.end[k] + 1) if j not in in_nav]
            in_nav.update(range(k, p.end[k] + 1))
    nav_links = _links(p, navs, url, True)
    root = content_root(p)
    nodes = kept_nodes(p, root) if root is not None else []
    text = plain_text(p, nodes)
    images = []
    for k in nodes:
        if p.tag[k] == "img":
            src = next((v for v in (p.attr(k, "src"), p.attr(k, "data-src"), p.attr(k, "data-original")) if v), None)
            full = resolve(url, src) if src else None
            if full:
                images.append({"src": full, "alt": p.attr(k, "alt") or ""})
    hero = meta.get("og:image") or meta.get("twitter:image")
    published = next((meta[m] for m in ("article:published_time", "datepublished", "date") if m in meta), None) or next((p.attr(k, "datetime") for k in elements if p.tag[k] == "time" and p.attr(k, "datetime")), None)
    return {
        "url": url, "title": meta.get("og:title") or meta.get("twitter:title") or title or None, "byline": meta.get("article:author") or meta.get("author") or _byline(p), "published_at": published,
        "lang": p.attr(root_html, "lang"), "site_name": meta.get("og:site_name") or (urlsplit(url).hostname if url and "://" in url else None), "description": meta.get("og:description") or meta.get("twitter:description") or meta.get("description"),
        "hero_image": resolve(url, hero) if hero else images[0]["src"] if images else None, "content_root": root, "word_count": len([w for w in _RUN.split(text) if w]), "plain_text": text, "images": images, "links": _links(p, nodes, url, False), "nav_links": nav_links,
    }


ARTICLE = "url string, title string, byline string, published_at string, lang string, site_name string, description string, hero_image string, content_root int, word_count int, plain_text string, images array<struct<src:string,alt:string>>, links array<struct<href:string,text:string>>, nav_links array<struct<href:string,text:string>>"
_FIELDS = re.findall(r"(?:^|, )(\w+) ", ARTICLE)
RENDERS = {"json": to_json, "markdown": to_markdown, "html": to_html}


def skim(pages: DataFrame, renders: tuple[str, ...] = (), id_col: str = "page_id", url_col: str = "url", html_col: str = "html", all_links: bool = False) -> DataFrame:
    """One row per page: id, the article, the asked renderings and error. Parsing and extraction are one Python hop.

    With all_links also page_links: every http(s) anchor of the page, each URL without fragment once.
    """
    source = pages.select(id_col, url_col, html_col)
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, {ARTICLE}{''.join(f', {r} string' for r in renders)}{', page_links array<string>' * all_links}, error string"

    def one(key, url, html) -> dict:
        try:
            p = parse(html or "")
            a = extract(p, url)
            nodes = kept_nodes(p, a["content_root"]) if renders and a["content_root"] is not None else []
            out = {id_col: key} | a | {r: RENDERS[r](p, nodes, a) for r in renders} | {"error": None}
            if all_links:
                hrefs = (resolve(url, p.attr(k, "href")) for k in range(len(p.kind)) if p.tag[k] == "a" and p.attr(k, "href"))
                out["page_links"] = list(dict.fromkeys(u.partition("#")[0] for u in hrefs if u and u.startswith(("http://", "https://"))))
            return out
        except ParseError as e:
            return {id_col: key, "url": url, "error": str(e)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.iloc[at : at + 128]
                rows = [one(*r) for r in part.itertuples(index=False, name=None)]
                out = pd.DataFrame(rows, columns=[id_col, *_FIELDS, *renders, *["page_links"] * all_links, "error"])
                for c in ("content_root", "word_count"):
                    out[c] = out[c].astype("Int32")
                yield out.astype({c: object for c in out.columns if out[c].dtype == float})

    return source.mapInPandas(run, schema)
