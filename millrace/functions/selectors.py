"""CSS selectors: type, universal, id, class, attribute, structural pseudo-classes, :not/:is/:where/:has, and combinators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .dom import Element

_IDENT = r"(?:-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*|--[\w-]+)"
_SIMPLE = re.compile(
    rf"(?P<type>\*|{_IDENT})|#(?P<id>(?:[\w\u0080-\U0010ffff-]|\\.)+)|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<raw>{_IDENT}))\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|::?(?P<pseudo>{_IDENT})(?P<open>\()?"
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<c>[+-]?\d+))\s*\Z", re.I)


class BadSelector(ValueError):
    """The text is no selector."""


@dataclass
class Compound:
    """Tests that one element must pass."""

    tests: list = field(default_factory=list)

    def matches(self, e: Element) -> bool:
        return all(t(e) for t in self.tests)


@dataclass
class Selector:
    """Compounds from right to left, with the combinator to the next on the left."""

    steps: list[tuple[Compound, str]]

    def matches(self, e: Element, scope: Element | None = None) -> bool:
        return self._from(e, 0, scope)

    def _from(self, e: Element, i: int, scope: Element | None) -> bool:
        compound, how = self.steps[i]
        if not compound.matches(e):
            return False
        if i + 1 == len(self.steps):
            if scope is None or not how:
                return True
            if how == ">":
                return e.parent is scope
            if how == " ":
                p = e.parent
                while p is not None and p is not scope:
                    p = p.parent
                return p is scope
            before = _before(e)
            return scope in (before[-1:] if how == "+" else before)
        if how == ">":
            return _element(e.parent) and self._from(e.parent, i + 1, scope)
        if how == " ":
            p = e.parent
            while _element(p):
                if self._from(p, i + 1, scope):
                    return True
                p = p.parent
            return False
        before = _before(e)
        return any(self._from(s, i + 1, scope) for s in (before[-1:] if how == "+" else before))


def _element(e: Element | None) -> bool:
    return e is not None and e.tag != "#document"


def _siblings(e: Element) -> list[Element]:
    return [c for c in e.parent.children if isinstance(c, Element)] if e.parent is not None else [e]


def _before(e: Element) -> list[Element]:
    s = _siblings(e)
    return s[: next(i for i, c in enumerate(s) if c is e)]


def _plain(s: str) -> str:
    return re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else m[2], s)


def _attribute(name: str, op: str | None, value: str, fold: bool):
    name = name.lower()
    same = (lambda s: s.lower()) if fold else (lambda s: s)
    value = same(value)
    if op is None:
        return lambda e: name in e.attrs
    tests = {
        "=": lambda s: s == value,
        "~=": lambda s: bool(value) and value in s.split(),
        "|=": lambda s: s == value or s.startswith(value + "-"),
        "^=": lambda s: bool(value) and s.startswith(value),
        "$=": lambda s: bool(value) and s.endswith(value),
        "*=": lambda s: bool(value) and value in s,
    }
    test = tests[op]
    return lambda e: name in e.attrs and test(same(e.attrs[name]))


def _nth(text: str):
    m = _NTH.match(text)
    if not m:
        raise BadSelector(f"bad position '{text}'")
    if m["word"]:
        a, b = 2, int(m["word"].lower() == "odd")
    elif m["c"]:
        a, b = 0, int(m["c"])
    else:
        a = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"])
        b = int(m["sign"] + m["b"]) if m["b"] else 0
    return lambda n: n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def _place(e: Element, last: bool, typed: bool) -> int:
    s = [c for c in _siblings(e) if not typed or c.tag == e.tag]
    i = next(i for i, c in enumerate(s) if c is e)
    return len(s) - i if last else i + 1


def _pseudo(name: str, inner: str | None):
    name = name.lower()
    if inner is None:
        plain = {
            "first-child": lambda e: _place(e, False, False) == 1,
            "last-child": lambda e: _place(e, True, False) == 1,
            "only-child": lambda e: len(_siblings(e)) == 1,
            "first-of-type": lambda e: _place(e, False, True) == 1,
            "last-of-type": lambda e: _place(e, True, True) == 1,
            "only-of-type": lambda e: _place(e, False, True) == _place(e, True, True) == 1,
            "empty": lambda e: not any(isinstance(c, Element) or (isinstance(c, str) and c) for c in e.children),
            "root": lambda e: e.parent is not None and e.parent.tag == "#document",
        }
        if name in plain:
            return plain[name]
    elif name in ("not", "is", "where", "has"):
        if name == "has":
            several = parse(inner, relative=True)
            return lambda e: any(s.matches(d, e) for s in several for d in _reach(e))
        several = parse(inner)
        if name == "not":
            return lambda e: not any(s.matches(e) for s in several)
        return lambda e: any(s.matches(e) for s in several)
    elif name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        test = _nth(inner)
        return lambda e: test(_place(e, "last" in name, "type" in name))
    raise BadSelector(f"unknown pseudo-class ':{name}'")


def _reach(e: Element):
    """Elements that :has may mean: those below e, and those below and after its later siblings."""
    yield from (d for d in e.walk() if d is not e)
    s = _siblings(e)
    for later in s[next(i for i, c in enumerate(s) if c is e) + 1 :]:
        yield from later.walk()


def parse(text: str, relative: bool = False) -> list[Selector]:
    """The selectors of a comma-separated list."""
    out, i, n = [], 0, len(text)
    while True:
        parts: list[tuple[Compound, str]] = []
        i = _blank(text, i)
        how = ""
        if relative:
            how = " "
            if i < n and text[i] in ">+~":
                how, i = text[i], _blank(text, i + 1)
        while True:
            compound, start = Compound(), i
            while m := _SIMPLE.match(text, i):
                if m["type"] is not None:
                    if i != start:
                        break
                    if m["type"] != "*":
                        tag = _plain(m["type"]).lower()
                        compound.tests.append(lambda e, tag=tag: e.tag == tag)
                    i = m.end()
                elif m["id"] is not None:
                    compound.tests.append(lambda e, v=_plain(m["id"]): e.attrs.get("id") == v)
                    i = m.end()
                elif m["cls"] is not None:
                    compound.tests.append(lambda e, v=_plain(m["cls"]): v in e.attrs.get("class", "").split())
                    i = m.end()
                elif m["attr"] is not None:
                    value = next((v for v in (m["dq"], m["sq"], m["raw"]) if v is not None), "")
                    compound.tests.append(_attribute(m["attr"], m["op"], value, (m["flag"] or "").lower() == "i"))
                    i = m.end()
                elif m["open"]:
                    depth, j = 1, m.end()
                    while j < n and depth:
                        depth += {"(": 1, ")": -1}.get(text[j], 0)
                        j += 1
                    if depth:
                        raise BadSelector("a bracket is not closed")
                    compound.tests.append(_pseudo(m["pseudo"], text[m.end() : j - 1]))
                    i = j
                else:
                    compound.tests.append(_pseudo(m["pseudo"], None))
                    i = m.end()
            if i == start:
                raise BadSelector(f"unexpected end or character at {i}")
            parts.append((compound, how))
            j = _blank(text, i)
            if j >= n or text[j] == ",":
                i = j
                break
            if text[j] in ">+~":
                how, i = text[j], _blank(text, j + 1)
            elif j > i:
                how, i = " ", j
            else:
                raise BadSelector(f"unexpected character '{text[j]}' at {j}")
        # from right to left: each compound with the combinator that stands before it
        out.append(Selector([(c, h) for c, h in reversed(parts)]))
        if i >= n:
            return out
        i += 1


def _blank(text: str, i: int) -> int:
    while i < len(text) and text[i] in " \t\n\r\f":
        i += 1
    return i
