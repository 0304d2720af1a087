"""An HTML tree built the way browsers do for the markup that occurs in practice.

Covered: implied html, head, body and tbody; void, raw-text and escapable raw-text elements; implied
ends of p, li, dt, dd, option and table parts; formatting elements left open are taken up again in the next block
(misnested ends close up to their start); what a table cannot hold goes before it; self-closing tags count inside svg
and math, and HTML blocks end these. Not covered: template contents.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD = frozenset("base link meta script style title noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p plaintext pre search section summary table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold rows and cells alone, and what may begin in them.
_ROWS = frozenset("table tbody thead tfoot tr".split())
_IN_ROWS = frozenset("caption colgroup col tbody thead tfoot tr td th form script style template".split())
_FOREIGN = ("svg", "math")
#: HTML that ends an svg or math element it begins in.
_BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup "
    "table tt u ul var".split()
)
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
# every repetition is possessive: what a tag has taken is never given back, so that a tag without an end fails in one pass
_TOKEN = re.compile(
    r"<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|<!(?P<doctype>[^>]*+)(?:>|\Z)|<\?[^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>"
    r"|(?P<text>[^<]++|<(?![a-zA-Z]))",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def add(self, child: Element | str | Comment) -> None:
        """Texts that follow one another stay apart: joining them one by one would copy them over and over."""
        if not isinstance(child, str):
            child.parent = self
        self.children.append(child)

    def walk(self):
        """Elements of the subtree in document order, the element itself first."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif isinstance(e, Element):
                stack += reversed(e.children)
        return "".join(out)


class Comment:
    __slots__ = ("data", "parent")

    def __init__(self, data: str):
        self.data, self.parent = data, None


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class _Stack(list):
    """Open elements, with what is asked of them again and again at hand: how many of a tag, and whether one is open."""

    def __init__(self, elements: list[Element]):
        super().__init__()
        self.count: Counter[str] = Counter()
        self.ids: set[int] = set()
        for e in elements:
            self.append(e)

    def append(self, e: Element) -> None:
        super().append(e)
        self.count[e.tag] += 1
        self.ids.add(id(e))

    def pop(self) -> Element:  # type: ignore[override]
        e = super().pop()
        self.count[e.tag] -= 1
        self.ids.discard(id(e))
        return e

    def cut(self, k: int) -> None:
        while len(self) > k:
            self.pop()

    def take_out(self, k: int) -> None:
        e = self[k]
        super().__delitem__(k)
        self.count[e.tag] -= 1
        self.ids.discard(id(e))

    def __contains__(self, e: object) -> bool:
        return id(e) in self.ids


class _Builder:
    def __init__(self, fragment: bool):
        self.root = Element("#document")
        self.fragment = fragment
        self.stack = _Stack([self.root])
        self.active: list[Element] = []
        self.head: Element | None = None
        self.body: Element | None = None
        if fragment:
            self.body = self.root
        else:
            self.html = Element("html")
            self.doctype = False

    # structure
    def _html(self) -> None:
        if not self.fragment and self.html.parent is None:
            self.root.add(self.html)
            self.stack = _Stack([self.root, self.html])

    def _in_head(self) -> None:
        self._html()
        if self.head is None:
            self.head = Element("head")
            self.html.add(self.head)
            self.stack = _Stack([self.root, self.html, self.head])

    def _in_body(self) -> None:
        if self.body is None:
            self._in_head()
            self.body = Element("body")
            self.html.add(self.body)
            self.stack = _Stack([self.root, self.html, self.body])

    def place(self, child: Element | str) -> None:
        """Add a node where it belongs: before the table, if the innermost open element holds rows and cells alone."""
        top = self.stack[-1]
        if top.tag in _ROWS and (isinstance(child, str) or child.tag not in _IN_ROWS) and (k := self.find({"table"}, {"html"})) > 0:
            table = self.stack[k]
            above = table.parent or self.stack[k - 1]
            at = len(above.children) - 1
            while at > 0 and above.children[at] is not table:
                at -= 1
            if not isinstance(child, str):
                child.parent = above
            above.children.insert(max(at, 0), child)
        else:
            top.add(child)

    def open(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        self.place(e)
        self.stack.append(e)
        return e

    def find(self, tags, stop=_SCOPE) -> int:
        """Place of the nearest open element of the tags, not looking beyond a scope; -1 if none."""
        if not any(self.stack.count[t] for t in tags):
            return -1
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in stop:
                return -1
        return -1

    def pop_to(self, k: int) -> None:
        self.stack.cut(k)

    def close_p(self) -> None:
        if (k := self.find({"p"}, _SCOPE | {"button"})) > 0:
            self.pop_to(k)

    def take_up(self) -> None:
        """Open again the formatting elements that a block's end has closed."""
        k = len(self.active)
        while k and self.active[k - 1] not in self.stack:
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            self.active[i] = self.open(old.tag, dict(old.attrs))

    # tokens
    def text(self, s: str) -> None:
        if self.body is None:
            blank = not s.strip(" \t\n\r\f")
            if self.head is not None and self.stack[-1] is self.head and blank:
                self.head.add(s)
                return
            if blank:
                return
            s = s.lstrip(" \t\n\r\f")
            self._in_body()
        if self.stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not s.strip(" \t\n\r\f"):
            self.stack[-1].add(s)
            return
        self.take_up()
        self.place(s)

    def raw(self, tag: str, attrs: dict[str, str], s: str) -> None:
        if self.body is None and (tag in HEAD or tag == "title"):
            self._in_head()
        else:
            self._in_body()
        e = Element(tag, attrs)
        if s:
            e.add(s)
        self.stack[-1].add(e)

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if any(self.stack.count[t] for t in _FOREIGN):
            k = max(self.find({t}, {"html"}) for t in _FOREIGN)
            if not any(e.tag in ("foreignobject", "desc", "title") for e in self.stack[k + 1 :]):
                if tag not in _BREAKS_OUT:
                    self.open(tag, attrs)
                    if closed:
                        self.stack.pop()
                    return
                self.pop_to(k)
        if tag == "html":
            self._html()
            if not self.fragment:
                for k, v in attrs.items():
                    self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if not self.fragment and self.head is None:
                self._in_head()
                self.head.attrs = attrs
            return
        if tag == "body":
            fresh = self.body is None
            self._in_body()
            if not self.fragment:
                for k, v in attrs.items():
                    if fresh or k not in self.body.attrs:
                        self.body.attrs[k] = v
            return
        if self.body is None:
            if tag in HEAD:
                self._in_head()
                self.stack[-1].add(Element(tag, attrs))
                return
            self._in_body()
        if tag in CLOSES_P:
            self.close_p()
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self.stack.pop()
        if tag == "li" and (k := self.find({"li"}, _SCOPE | {"ul", "ol"})) > 0:
            self.pop_to(k)
        elif tag in ("dt", "dd") and (k := self.find({"dt", "dd"}, _SCOPE | {"dl"})) > 0:
            self.pop_to(k)
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.stack.pop()
        elif tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption", "colgroup", "col"):
            self._table(tag)
        elif tag == "a" and (k := self.find({"a"})) > 0:
            self.end("a")
        if tag in FORMATTING:
            self.take_up()
            # of equal elements that are open for formatting three are taken up again at most
            equal = [i for i, e in enumerate(self.active) if e.tag == tag and e.attrs == attrs]
            if len(equal) >= 3:
                del self.active[equal[0]]
            self.active.append(self.open(tag, attrs))
            return
        if tag not in CLOSES_P and tag not in ("tr", "tbody", "thead", "tfoot", "td", "th"):
            self.take_up()
        self.open(tag, attrs)
        if tag in VOID or (closed and tag in _FOREIGN):
            self.stack.pop()

    def _table(self, tag: str) -> None:
        k = self.find({"table"}, {"html"})
        if k < 0:
            return
        if tag in ("td", "th"):
            if (c := self.find({"td", "th"}, {"table"})) > 0:
                self.pop_to(c)
            elif (c := self.find({"tr"}, {"table"})) > 0:
                self.pop_to(c + 1)
            if self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                self._table("tr")
                self.open("tr", {})
        elif tag == "tr":
            if (c := self.find({"tr"}, {"table"})) > 0:
                self.pop_to(c)
            elif (c := self.find({"tbody", "thead", "tfoot"}, {"table"})) > 0:
                self.pop_to(c + 1)
            else:
                self.pop_to(k + 1)
            if self.stack[-1].tag == "table":
                self.open("tbody", {})
        else:
            self.pop_to(k + 1)

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and self.head is not None and self.stack[-1] is self.head:
                self.stack.pop()
            return
        if tag == "p" and self.find({"p"}, _SCOPE | {"button"}) < 0:
            self._in_body()
            self.open("p", {})
            self.stack.pop()
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag in FORMATTING:
            own = next((e for e in reversed(self.active) if e.tag == tag), None)
            if own is None:
                return
            self.active.remove(own)
            if own in self.stack:
                k = self.stack.index(own)
                if all(e.tag in FORMATTING or e.tag not in CLOSES_P | {"table", "td", "th", "tr"} for e in self.stack[k + 1 :]):
                    self.pop_to(k)
                else:
                    self._part(own, k)
            return
        if tag in _ROWS:  # these end a cell that is open in them
            if (k := self.find({tag}, {"html", "table"} - {tag})) > 0:
                self.pop_to(k)
            return
        tags = _HEADINGS if tag in _HEADINGS else {tag}
        if (k := self.find(tags, _SCOPE - {tag})) > 0:
            self.pop_to(k)

    def _part(self, own: Element, k: int) -> None:
        """A formatting element that ends inside a block it began outside of: the block moves out, with a copy of it around what it holds."""
        block = self.stack[k + 1]
        copy = Element(own.tag, dict(own.attrs))
        for c in block.children:
            copy.add(c) if isinstance(c, str) else (copy.children.append(c), setattr(c, "parent", copy))
        block.children = []
        block.add(copy)
        own.children.remove(block)
        above = self.stack[k - 1]
        above.add(block)
        self.stack.take_out(k)


def parse(source: str, fragment: bool = False) -> Element:
    """The document tree under a "#document" element, or a fragment's nodes under it."""
    b = _Builder(fragment)
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    at, n, eat_newline = 0, len(source), False
    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            break  # a tag that is never closed is dropped
        at = m.end()
        if (s := m["text"]) is not None:
            parts = [s]
            while at < n and (t := _TOKEN.match(source, at)) and t["text"] is not None:
                parts.append(t["text"])
                at = t.end()
            s = "".join(parts)
            if eat_newline and s.startswith("\n"):
                s = s[1:]
            if s:
                b.text(unescape(s))
        elif m["start"] is not None:
            tag = m["start"].lower()
            attrs = attributes(m["attrs"])
            if tag in RAW or tag in ESCAPABLE:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                last = source.find(">", close.end()) if close else -1
                inner = source[at : close.start() if last >= 0 else n]
                at = last + 1 if last >= 0 else n
                if tag == "textarea" and inner.startswith("\n"):
                    inner = inner[1:]
                b.raw(tag, attrs, unescape(inner) if tag in ESCAPABLE else inner)
            else:
                b.start(tag, attrs, m["attrs"].endswith("/"))
                eat_newline = tag in ("pre", "listing")
                continue
        elif m["end"] is not None:
            b.end(m["end"].lower())
        elif m["comment"] is not None:
            where = b.stack[-1] if b.stack[-1] is not b.root or fragment or b.html.parent is None else b.root
            c = Comment(m["comment"])
            c.parent = where
            where.children.append(c)
        eat_newline = False
    if not fragment:
        b._in_body()
    return b.root


# -- writing


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(s: str) -> str:
    return s.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def serialize(e: Element | str | Comment, out: list[str]) -> None:
    """Outer HTML of a node."""
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(escape_text(x))
        elif isinstance(x, Comment):
            out.append(f"<!--{x.data}-->")
        else:
            if x.tag != "#document":
                out.append(f"<{x.tag}" + "".join(f' {k}="{escape_attr(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag in VOID:
                    continue
                todo.append((f"</{x.tag}>",))
            if x.tag in RAW:
                out += [c for c in x.children if isinstance(c, str)]
            else:
                todo += reversed(x.children)


def outer_html(e: Element) -> str:
    out: list[str] = []
    serialize(e, out)
    return "".join(out)
