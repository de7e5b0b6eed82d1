"""Selectors on one parsed page, for extractors that already are in Python. The relational form gives the same nodes."""

from __future__ import annotations

from functools import lru_cache

from pageloom.plans.selectors import Complex, Compound, SelectorError, parse_selector
from pageloom.sources.html import WHITE, Page


@lru_cache(maxsize=256)
def _parsed(selector: str) -> tuple[Complex, ...]:
    return tuple(parse_selector(selector))


class Matcher:
    """The sibling positions of a page, made once."""

    def __init__(self, page: Page):
        self.page = page
        self.children: dict[int, list[int]] = {}
        for k in range(1, len(page.kind)):
            self.children.setdefault(page.parent[k], []).append(k)

    def _siblings(self, k: int, same_tag: bool) -> list[int]:
        p = self.page
        return [j for j in self.children[p.parent[k]] if p.kind[j] == "element" and (not same_tag or p.tag[j] == p.tag[k])]

    def _position(self, k: int, column: str) -> int:
        own = self._siblings(k, column.startswith("type"))
        at = own.index(k)
        return len(own) - at if column.endswith("last") else at + 1

    def _test(self, k: int, test: tuple) -> bool:
        p, kind = self.page, test[0]
        if kind == "id":
            return p.attr(k, "id") == test[1]
        if kind == "class":
            return test[1] in (p.attr(k, "class") or "").split()
        if kind == "attr":
            _, name, op, value, fold = test
            v = p.attr(k, name)
            if v is None or op is None:
                return v is not None
            if fold:
                v, value = v.lower(), value.lower()
            if op == "=":
                return v == value
            if op == "|=":
                return v == value or v.startswith(value + "-")
            if not value:
                return False
            return {"~=": lambda: value in v.strip(WHITE).split(), "^=": lambda: v.startswith(value), "$=": lambda: v.endswith(value), "*=": lambda: value in v}[op]()
        if kind == "nth":
            _, column, a, b = test
            d = self._position(k, column) - b
            return d == 0 if a == 0 else d % a == 0 and d / a >= 0
        if kind == "only":
            return len(self._siblings(k, test[1].startswith("type"))) == 1
        if kind == "root":
            return p.parent[k] == 0
        if kind == "empty":
            return not any(p.kind[j] == "element" or (p.kind[j] == "text" and p.data[j]) for j in self.children.get(k, ()))
        if kind == "has":
            return any(p.kind[j] == "element" and self.any(j, test[1]) for j in range(k, p.end[k] + 1))
        return self.any(k, test[1]) != (kind == "not")

    def _compound(self, k: int, c: Compound) -> bool:
        return (c.tag is None or self.page.tag[k] == c.tag) and all(self._test(k, t) for t in c.tests)

    def _left(self, k: int, how: str) -> list[int]:
        """The elements that stand in relation `how` to k."""
        p = self.page
        if how in " >":
            out, up = [], p.parent[k]
            while up > 0:
                out.append(up)
                if how == ">":
                    break
                up = p.parent[up]
            return out
        own = self.children[p.parent[k]]
        before = own[: own.index(k)]
        if how == "+":
            return before[-1:] if before and p.kind[before[-1]] == "element" else []
        return [j for j in before if p.kind[j] == "element"]

    def complex(self, k: int, c: Complex) -> bool:
        now = {k} if self._compound(k, c.compounds[-1]) else set()
        for compound, how in zip(reversed(c.compounds[:-1]), reversed(c.combinators), strict=True):
            now = {j for x in now for j in self._left(x, how) if self._compound(j, compound)}
        return bool(now)

    def any(self, k: int, selectors: list[Complex] | tuple[Complex, ...]) -> bool:
        return any(self.complex(k, c) for c in selectors)

    def all(self, selector: str, under: int = 0) -> list[int]:
        """The matching descendants of a node in document order."""
        wanted = _parsed(selector)
        return [k for k in range(under + 1, self.page.end[under] + 1) if self.page.kind[k] == "element" and self.any(k, wanted)]

    def first(self, selector: str, under: int = 0) -> int | None:
        wanted = _parsed(selector)
        return next((k for k in range(under + 1, self.page.end[under] + 1) if self.page.kind[k] == "element" and self.any(k, wanted)), None)


def selection_texts(page: Page, selector: str, collapse) -> list[str]:
    """The collapsed texts of a selector's matches; an invalid selector matches nothing."""
    try:
        m = Matcher(page)
        return [collapse(page.text(k)) for k in m.all(selector)]
    except SelectorError:
        return []
