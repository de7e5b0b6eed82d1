"""An extracted article as JSON, Markdown or sanitised HTML."""

from __future__ import annotations

import json
import re
from html import escape

from pageloom.sources.html import VOID, Page

_RUN = re.compile(r"\s+")
_ESCAPED = re.compile(r"([\\`*_\[\]])")
# What sanitised HTML may hold.
ALLOWED = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code strong em b i u a img br hr table thead tbody tr th td figure figcaption dl dt dd span sub sup".split())
SAFE = re.compile(r"(?:https?:|mailto:|tel:|#|//)", re.I)
_BLOCK = frozenset("p div article section main header footer h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table figure figcaption hr dl dt dd".split())


def to_json(p: Page, nodes: list[int], a: dict) -> str:
    """The record with its keys in a fixed order; missing values are null."""
    keys = (("url", "url"), ("title", "title"), ("byline", "byline"), ("publishedAt", "published_at"), ("lang", "lang"), ("siteName", "site_name"), ("description", "description"), ("heroImage", "hero_image"), ("wordCount", "word_count"), ("plainText", "plain_text"), ("images", "images"), ("links", "links"), ("navLinks", "nav_links"))
    return json.dumps({k: a[v] for k, v in keys}, ensure_ascii=False, indent=2)


class _Tree:
    def __init__(self, p: Page, nodes: list[int]):
        self.p, self.children = p, {k: [] for k in nodes}
        for k in nodes[1:]:
            self.children[p.parent[k]].append(k)


def _inline(t: _Tree, k: int) -> str:
    """The children of a node as Markdown within a line."""
    out = []
    for c in t.children.get(k, ()):
        p, tag = t.p, t.p.tag[c]
        if p.kind[c] == "text":
            out.append(_ESCAPED.sub(r"\\\1", _RUN.sub(" ", p.data[c])))
        elif tag in ("strong", "b", "em", "i"):
            inner = _inline(t, c).strip()
            mark = "**" if tag in ("strong", "b") else "*"
            out.append(f"{mark}{inner}{mark}" if inner else "")
        elif tag == "code":
            inner = p.text(c)
            out.append(f"`{inner}`" if inner.strip() else "")
        elif tag == "a":
            inner, href = _inline(t, c).strip(), (p.attr(c, "href") or "").strip()
            out.append(f"[{inner}]({href})" if inner and href else inner)
        elif tag == "img":
            src = p.attr(c, "src") or p.attr(c, "data-src") or ""
            out.append(f"![{p.attr(c, 'alt') or ''}]({src})" if src else "")
        elif tag == "br":
            out.append("  \n")
        elif p.kind[c] == "element":
            out.append(_inline(t, c))
    return "".join(out)


def _list(t: _Tree, k: int, level: int) -> list[str]:
    out, number = [], 0
    for c in t.children[k]:
        if t.p.tag[c] != "li":
            continue
        number += 1
        nested = [j for j in t.children[c] if t.p.tag[j] in ("ul", "ol")]
        own = _Tree.__new__(_Tree)
        own.p, own.children = t.p, t.children | {c: [j for j in t.children[c] if j not in nested]}
        mark = f"{number}. " if t.p.tag[k] == "ol" else "- "
        out.append("  " * level + mark + _inline(own, c).strip())
        for j in nested:
            out += _list(t, j, level + 1)
    return out


def _table(t: _Tree, k: int) -> str:
    rows = [[_inline(t, c).strip().replace("|", "\\").replace("\n", " ") for c in t.children[r] if t.p.tag[c] in ("td", "th")] for r in sorted(_under(t, k)) if t.p.tag[r] == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def _under(t: _Tree, k: int) -> list[int]:
    out, stack = [], [k]
    while stack:
        j = stack.pop()
        out.append(j)
        stack += t.children.get(j, ())
    return out


def _blocks(t: _Tree, k: int) -> list[str]:
    """The children of a node as Markdown blocks; loose inline children form paragraphs."""
    out, loose = [], []

    def close() -> None:
        if loose:
            own = _Tree.__new__(_Tree)
            own.p, own.children = t.p, t.children | {-1: list(loose)}
            text = _inline(own, -1).strip()
            if text:
                out.append(text)
            loose.clear()

    for c in t.children.get(k, ()):
        p, tag = t.p, t.p.tag[c]
        if p.kind[c] != "element" or tag not in _BLOCK:
            if p.kind[c] in ("text", "element"):
                loose.append(c)
            continue
        close()
        if tag[0] == "h" and tag[1:].isdigit():
            text = _inline(t, c).strip()
            out += [f"{'#' * int(tag[1])} {text}"] if text else []
        elif tag in ("p", "figcaption", "dt", "dd"):
            text = _inline(t, c).strip()
            out += [f"*{text}*" if tag == "figcaption" else text] if text else []
        elif tag in ("ul", "ol"):
            out += ["\n".join(_list(t, c, 0))] if t.children[c] else []
        elif tag == "blockquote":
            inner = "\n\n".join(_blocks(t, c))
            out += ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        elif tag == "pre":
            code = next((j for j in t.children[c] if p.tag[j] == "code"), c)
            found = re.search(r"(?:language|lang)-(\S+)", f"{p.attr(code, 'class') or ''} {p.attr(c, 'class') or ''}")
            out.append(f"```{found[1] if found else ''}\n{p.text(c).strip(chr(10))}\n```")
        elif tag == "hr":
            out.append("---")
        elif tag == "table":
            text = _table(t, c)
            out += [text] if text else []
        else:
            out += _blocks(t, c)
    close()
    return out


def to_markdown(p: Page, nodes: list[int], a: dict) -> str:
    """Title, a line about the source, hero image, description and navigation, then the content."""
    out = []
    if a["title"]:
        out.append(f"# {a['title']}")
    about = [x for x in (a["byline"] and f"By **{a['byline']}**", a["published_at"], a["site_name"] and f"on _{a['site_name']}_", a["url"] and f"[source]({a['url']})") if x]
    if about:
        out.append(" • ".join(about))
    if a["hero_image"]:
        out.append(f"![]({a['hero_image']})")
    if a["description"]:
        out.append(f"> {a['description']}")
    if a["nav_links"]:
        out.append("| Navigation |\n| --- |\n" + "\n".join(f"| [{x['text'].replace('|', chr(92))}]({x['href']}) |" for x in a["nav_links"]))
    if nodes:
        out += _blocks(_Tree(p, nodes), nodes[0])
    return "\n\n".join(out) + "\n"


def to_html(p: Page, nodes: list[int], a: dict) -> str:
    """Allowed elements without attributes, but for images' src and alt and safe links' href."""
    out, closing = [], []
    if a["title"]:
        out.append(f"<h1>{escape(a['title'], False)}</h1>")
    for k in nodes:
        while closing and k > closing[-1][0]:
            out.append(closing.pop()[1])
        tag = p.tag[k]
        if p.kind[k] == "text":
            out.append(escape(p.data[k], False))
        elif p.kind[k] == "element" and tag in ALLOWED:
            if tag == "img":
                src = p.attr(k, "src") or ""
                out.append(f'<img src="{escape(src)}" alt="{escape(p.attr(k, "alt") or "")}">' if SAFE.match(src) else "")
            elif tag in VOID:
                out.append(f"<{tag}>")
            else:
                href = (p.attr(k, "href") or "").strip() if tag == "a" else ""
                name = "span" if tag == "a" and not SAFE.match(href) else tag
                out.append(f'<a href="{escape(href)}" title="{escape(href)}" target="_blank" rel="noopener noreferrer">' if name == "a" else f"<{name}>")
                closing.append((p.end[k], f"</{name}>"))
    while closing:
        out.append(closing.pop()[1])
    return "".join(out)


def serialize(p: Page, node: int = 0) -> str:
    """outerHTML of a node (of the document: of its children)."""
    out, closing = [], []
    for k in range(node, p.end[node] + 1):
        while closing and k > closing[-1][0]:
            out.append(closing.pop()[1])
        if p.kind[k] == "text":
            raw = p.tag[p.parent[k]] in ("script", "style", "noscript")
            out.append(p.data[k] if raw else p.data[k].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;"))
        elif p.kind[k] == "comment":
            out.append(f"<!--{p.data[k]}-->")
        elif p.kind[k] == "doctype":
            out.append(f"<!DOCTYPE {p.data[k]}>")
        elif p.kind[k] == "element":
            attrs = "".join(f' {a}="' + v.replace("&", "&amp;").replace('"', "&quot;").replace("\xa0", "&nbsp;") + '"' for a, v in p.attrs[k])
            out.append(f"<{p.tag[k]}{attrs}>")
            if p.tag[k] not in VOID:
                closing.append((p.end[k], f"</{p.tag[k]}>"))
    while closing:
        out.append(closing.pop()[1])
    return "".join(out)
