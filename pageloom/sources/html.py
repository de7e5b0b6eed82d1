"""HTML text to a flat tree, in pure Python: one pass of regular expressions and a stack of open elements.

Scripts do not run, foreign content and CDATA are not known, and a stray "<!x" or "</1" starts a comment that ends at
"-->". Parsing raises only ParseError, for an element that would stand outside the root.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.entities import name2codepoint

# Element names by how the parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("title textarea".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol p pre section table ul".split())
HEAD_ONLY = frozenset("base link meta title style script noscript noframes".split())
SAME_KIND = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WHITE = " \t\n\r\f"

#: Numeric references 0x80-0x9F stand for the Windows-1252 characters.
_CP1252 = {b: ord(bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_NAMED = {k: chr(v) for k, v in name2codepoint.items()} | {"apos": "'"}
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*);)")
_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|(![dD][oO][cC][tT][yY][pP][eE])|(!|/|\?))")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?""")
_TAG_END = re.compile(r"[\s/]*>")
_DOCTYPE = re.compile(r"\s*([^\s>]*)[^>]*>")


class ParseError(ValueError):
    """The page cannot be built; callers turn it into a row with an error."""


def _reference(m: re.Match) -> str:
    if m[3]:
        return _NAMED.get(m[3], m[0])
    digits = m[1] or m[2]
    code = int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000
    code = _CP1252.get(code, code)
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"


def unescape(text: str) -> str:
    """Character references decoded: numeric ones with or without a semicolon, named ones only with it."""
    return _REFERENCE.sub(_reference, text) if "&" in text else text


def tokens(html: str):
    """("text", data), ("start", name, attributes, self-closing), ("end", name), ("comment", data), ("doctype", name)."""
    at, n, pending = 0, len(html), []

    def flush():
        if pending:
            out = "".join(pending)
            pending.clear()
            return [("text", out)]
        return []

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            pending.append(unescape(html[at:]))
            break
        if m.start() > at:
            pending.append(unescape(html[at : m.start()]))
        slash, name, comment, doctype, _ = m.groups()
        if comment or (name is None and not doctype):
            start = m.end()
            end = html.find("-->", start)
            yield from flush()
            if end < 0:
                return  # an open comment is dropped
            yield ("comment", html[start:end])
            at = end + 3
        elif doctype:
            d = _DOCTYPE.match(html, m.end())
            yield from flush()
            if not d:
                return
            yield ("doctype", d[1].lower() or None)
            at = d.end()
        else:
            name, attributes, at = name.lower(), [], m.end()
            while not (end := _TAG_END.match(html, at)):
                a = _ATTRIBUTE.match(html, at)
                if not a or a.end() == at:
                    at += 1
                    if at >= n:
                        break
                    continue
                key = a[1].lower()
                if all(key != k for k, _ in attributes):
                    attributes.append((key, unescape(next((v for v in a.groups()[1:] if v is not None), ""))))
                at = a.end()
            yield from flush()
            if not end:
                return  # a half-written tag is dropped
            closing, at = end[0].rstrip(">").endswith("/"), end.end()
            if slash:
                yield ("end", name)
                continue
            yield ("start", name, attributes, closing)
            if (name in RAW or name in RCDATA) and not closing:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                body = html[at : stop.start()] if stop else html[at:]
                if body:
                    yield ("text", unescape(body) if name in RCDATA else body)
                if not stop:
                    return
                at = stop.start()
    yield from flush()


@dataclass
class Page:
    """Nodes in document order; node 0 is the document. end[k] is the last descendant of k."""

    kind: list[str] = field(default_factory=lambda: ["document"])
    tag: list[str | None] = field(default_factory=lambda: [None])
    attrs: list[list[tuple[str, str]]] = field(default_factory=lambda: [[]])
    data: list[str | None] = field(default_factory=lambda: [None])
    parent: list[int] = field(default_factory=lambda: [-1])
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def attr(self, node: int, name: str) -> str | None:
        return next((v for k, v in self.attrs[node] if k == name), None)

    def text(self, node: int) -> str:
        return "".join(self.data[k] for k in range(node, self.end[node] + 1) if self.kind[k] == "text")


class _Builder:
    def __init__(self):
        self.page, self.children, self.open, self.mode, self.body = Page(), [[]], [], "initial", None
        self.in_text = False  # inside an element that holds text only: start tags are ignored, any end tag leaves

    def add(self, kind: str, tag=None, attrs=(), data=None, under: int | None = None) -> int:
        p, at = self.page, self.open[-1] if self.open else 0
        if under is not None:
            at = under
        p.kind.append(kind)
        p.tag.append(tag)
        p.attrs.append(list(attrs))
        p.data.append(data)
        p.parent.append(at)
        self.children.append([])
        self.children[at].append(len(p.kind) - 1)
        return len(p.kind) - 1

    def element(self, name: str, attrs=(), push: bool = True) -> int:
        if not self.open and name != "html":
            raise ParseError(f"<{name}> stands outside the root")
        k = self.add("element", name, attrs)
        if push:
            self.open.append(k)
        return k

    def text(self, data: str) -> None:
        under = self.open[-1] if self.open else self.body if self.body is not None else 0
        own = self.children[under]
        if own and self.page.kind[own[-1]] == "text":
            self.page.data[own[-1]] += data
        else:
            self.add("text", data=data, under=under)

    def pop_to(self, *names: str) -> None:
        while self.open and self.page.tag[self.open.pop()] not in names:
            pass

    def has(self, *names: str) -> bool:
        return any(self.page.tag[k] in names for k in self.open)

    def feed(self, token: tuple) -> None:
        kind = token[0]
        name = token[1] if kind in ("start", "end") else None
        blank = kind == "text" and not token[1].strip(WHITE)
        if self.in_text:
            if kind == "text":
                self.text(token[1])
            elif kind == "end":
                self.open.pop()
                self.in_text = False
            return
        if self.mode == "initial":
            if kind == "doctype":
                self.add("doctype", data=token[1] or "html")
                self.mode = "before_html"
                return
            if blank:
                return
            self.mode = "before_html"
        if self.mode == "before_html":
            if kind == "comment":
                self.add("comment", data=token[1])
                return
            if blank:
                return
            self.mode = "before_head"
            self.element("html", token[2] if kind == "start" and name == "html" else ())
            if kind == "start" and name == "html":
                return
        if self.mode == "before_head":
            if kind == "comment":
                self.add("comment", data=token[1])
                return
            if blank:
                return
            self.mode = "head"
            self.element("head", token[2] if kind == "start" and name == "head" else ())
            if kind == "start" and name == "head":
                return
        if self.mode == "head":
            if kind == "comment":
                self.add("comment", data=token[1])
                return
            if blank:
                self.text(token[1])
                return
            if kind == "doctype" or (kind == "start" and name == "head"):
                return
            if kind == "start" and name in HEAD_ONLY:
                self.start(token)
                return
            if kind == "end" and name not in ("head", "body", "html", "br"):
                return
            self.pop_to("head")
            self.mode = "after_head"
            if kind == "end" and name == "head":
                return
        if self.mode == "after_head":
            if kind == "comment":
                self.add("comment", data=token[1])
                return
            if blank:
                self.text(token[1])
                return
            self.mode = "body"
            self.body = self.element("body", token[2] if kind == "start" and name == "body" else ())
            if kind == "start" and name == "body":
                return
        if self.mode == "after_body":
            if kind == "comment":
                self.add("comment", data=token[1], under=self.page.parent[self.body])
                return
            if blank or kind == "doctype" or (kind == "end" and name in ("html", "body")):
                return
            self.mode = "body"
            if not self.open and kind == "start":
                self.open = [self.page.parent[self.body], self.body]
        if kind == "text":
            self.text(token[1])
        elif kind == "comment":
            self.add("comment", data=token[1])
        elif kind == "start":
            self.start(token)
        elif kind == "end":
            self.finish(name)

    def start(self, token: tuple) -> None:
        _, name, attrs, _ = token
        if name in VOID:
            self.element(name, attrs, push=False)
            return
        if name not in RAW and name not in RCDATA:
            if name in CLOSES_P and self.has("p"):
                self.pop_to("p")
            same = SAME_KIND.get(name)
            if same and self.has(*same):
                self.pop_to(*same)
        self.element(name, attrs)
        self.in_text = name in RAW or name in RCDATA

    def finish(self, name: str) -> None:
        top = self.page.tag[self.open[-1]] if self.open else None
        if name in ("body", "html") and top in ("body", "html"):
            self.mode = "after_body"
        elif self.has(name):
            self.pop_to(name)

    def done(self) -> Page:
        """The page with nodes renumbered in document order."""
        old, order, stack, new = self.page, [], [0], Page([], [], [], [], [], [], [])
        while stack:
            k = stack.pop()
            order.append(k)
            stack += reversed(self.children[k])
        place = {k: i for i, k in enumerate(order)}
        new.kind, new.tag, new.attrs, new.data = ([x[k] for k in order] for x in (old.kind, old.tag, old.attrs, old.data))
        new.parent = [place[old.parent[k]] if k else -1 for k in order]
        new.depth = [0] * len(order)
        new.end = list(range(len(order)))
        for i in range(1, len(order)):
            new.depth[i] = new.depth[new.parent[i]] + 1
        for i in range(len(order) - 1, 0, -1):
            new.end[new.parent[i]] = max(new.end[new.parent[i]], new.end[i])
        return new


def parse(html: str) -> Page:
    """The tree of a page; html, head and body are always there."""
    b = _Builder()
    for token in tokens(html):
        b.feed(token)
    b.in_text = False
    for mode in ("initial", "before_html", "before_head", "head", "after_head"):
        if b.mode == mode:  # an empty or unfinished page still has a body
            b.feed(("end", "html"))
    return b.done()


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def sniff(body: bytes, content_type: str | None = None) -> str:
    """The encoding: byte order mark, then the header's charset, then one in the first 1024 bytes, then UTF-8."""
    import codecs

    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if body.startswith(mark):
            return name
    for where in ((content_type or "").encode("latin-1", "replace"), body[:1024]):
        if m := _CHARSET.search(where):
            try:
                return codecs.lookup(m[1].decode()).name
            except LookupError:
                continue
    return "utf-8"


def decode(body: bytes, content_type: str | None = None) -> str:
    return body.decode(sniff(body, content_type), "replace").removeprefix("﻿")
