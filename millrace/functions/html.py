"""HTML functions: extraction by selector, sanitizing by allow-lists, and rendering as plain text."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Mapping, Sequence

from ..errors import Fault, InvalidArg
from . import dom, selectors
from .codecs import integer
from .kernel import ANY, STR, Kernel, as_text

# -- extraction


EXTRACTS = ("text", "html", "{attr}")


class _Select:
    """A selector list, compiled again where a task runs."""

    def __init__(self, text: str):
        self.text = text
        self._list = selectors.parse(text)

    def __getstate__(self):
        return self.text

    def __setstate__(self, text):
        self.__init__(text)

    def find(self, root: dom.Element):
        return (e for e in root.walk() if e.tag != "#document" and any(s.matches(e) for s in self._list))


def html_extract(selector: str, extract: str | Mapping[str, str] = "text", all: bool | None = None) -> Kernel:  # noqa: A002
    """Text, outer HTML or an attribute of the first match ('' if none), or of all as a JSON list."""
    if not selector:
        raise InvalidArg("htmlExtract: selector must not be empty")
    attr = None
    if isinstance(extract, Mapping):
        attr = extract.get("attr")
        if not isinstance(attr, str) or not attr:
            raise InvalidArg("htmlExtract: attr must not be empty")
    elif extract not in EXTRACTS[:2]:
        raise InvalidArg(f"htmlExtract: extract must be one of {EXTRACTS}, got '{extract}'")
    try:
        select = _Select(selector)
    except selectors.BadSelector as why:
        raise InvalidArg(f"htmlExtract: invalid selector '{selector}': {why}") from None

    def one(e: dom.Element) -> str | None:
        return e.attrs.get(attr.lower()) if attr else e.text() if extract == "text" else dom.outer_html(e)

    def run(v: bytes | str) -> str:
        found = select.find(dom.parse(as_text(v)))
        if all:
            return json.dumps([one(e) for e in found], ensure_ascii=False, separators=(",", ":"))
        first = next(found, None)
        return (one(first) if first is not None else None) or ""

    return Kernel("htmlExtract", ANY, "string", run)


# -- sanitizing

TAGS = frozenset(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption "
    "figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li map mark nav ol p pre q rp rt rtc ruby s samp small span strike strong sub "
    "summary sup table tbody td th thead time tr tt u ul var wbr".split()
)
CLEAN_CONTENT = frozenset(("script", "style"))
TAG_ATTRS = {
    "a": ("href", "hreflang"), "bdo": ("dir",), "blockquote": ("cite",), "col": ("align", "char", "charoff", "span"), "colgroup": ("align", "char", "charoff", "span"),
    "del": ("cite", "datetime"), "hr": ("align", "size", "width"), "img": ("align", "alt", "height", "src", "width"), "ins": ("cite", "datetime"), "ol": ("start",),
    "q": ("cite",), "table": ("align", "char", "charoff", "summary"), "tbody": ("align", "char", "charoff"), "td": ("align", "char", "charoff", "colspan", "headers", "rowspan"),
    "tfoot": ("align", "char", "charoff"), "th": ("align", "char", "charoff", "colspan", "headers", "rowspan", "scope"), "thead": ("align", "char", "charoff"), "tr": ("align", "char", "charoff"),
}
GENERIC_ATTRS = ("lang", "title")
SCHEMES = frozenset("bitcoin ftp ftps geo http https im irc ircs magnet mailto mms mx news nntp openpgp4fpr sip sms smsto ssh tel url webcal wtai xmpp".split())
_URL_ATTRS = frozenset(("href", "src", "cite", "action", "formaction", "poster", "background", "longdesc", "data", "ping"))
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")


def _no_empty(values: Sequence[str], what: str) -> None:
    if any(not v for v in values):
        raise InvalidArg(f"sanitizeHtml: {what} must not contain empty strings")


def sanitize_html(allowed_tags: Sequence[str] | None = None, allowed_attrs: Mapping[str, Sequence[str]] | None = None, url_schemes: Sequence[str] | None = None, strip_comments: bool | None = None) -> Kernel:
    """Only listed tags, attributes and URL schemes remain; a tag that goes leaves its content, script and style take theirs along."""
    tags, clean, per_tag, generic, rel = TAGS, set(CLEAN_CONTENT), TAG_ATTRS, frozenset(GENERIC_ATTRS), True
    if allowed_tags is not None:
        _no_empty(allowed_tags, "allowedTags")
        tags = frozenset(t.lower() for t in allowed_tags)
        clean -= tags
    if url_schemes is not None:
        _no_empty(url_schemes, "urlSchemes")
    if allowed_attrs is not None:
        for tag, attrs in allowed_attrs.items():
            if not tag:
                raise InvalidArg("sanitizeHtml: allowedAttrs keys must not be empty")
            _no_empty(attrs, "allowedAttrs values")
            if "rel" in attrs and tag in ("*", "a"):
                rel = False
        own = {t: tuple(a) for t, a in allowed_attrs.items() if t != "*"}
        if own:
            per_tag = own
            clean -= set(own)
        generic = frozenset(allowed_attrs.get("*", ()))
    schemes = SCHEMES if url_schemes is None else frozenset(s.lower() for s in url_schemes)
    strip = True if strip_comments is None else strip_comments

    def fine(name: str, value: str) -> bool:
        if name not in _URL_ATTRS:
            return True
        m = _SCHEME.match(re.sub(r"[\x00-\x20]", "", value))
        return m is None or m[1].lower() in schemes

    def kept(node: dom.Element, out: list) -> None:
        todo = [(c, out) for c in reversed(node.children)]
        while todo:
            c, out = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif isinstance(c, dom.Comment):
                if not strip:
                    out.append(c)
            elif c.tag in clean:
                continue
            elif c.tag in tags:
                e = dom.Element(c.tag, {k: v for k, v in c.attrs.items() if (k in generic or k in per_tag.get(c.tag, ())) and fine(k, v)})
                if rel and c.tag == "a":
                    e.attrs["rel"] = "noopener noreferrer"
                out.append(e)
                todo += [(x, e.children) for x in reversed(c.children)]
            else:
                todo += [(x, out) for x in reversed(c.children)]

    def run(s: str) -> str:
        root = dom.Element("#document")
        kept(dom.parse(s, fragment=True), root.children)
        return dom.outer_html(root)

    return Kernel("sanitizeHtml", STR, "string", run)


# -- plain text

_GONE = frozenset("head script style noscript template title iframe svg math object".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul #document".split()
)
_MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**", "code": "`", "s": "", "del": ""}


class _Text:
    """Renders a tree as lines: blocks apart by blank lines, lists and quotes with prefixes, links with footnote numbers."""

    def __init__(self):
        self.links: list[str] = []

    def block(self, node: dom.Element, width: int) -> list[str]:
        if width < 1:
            raise Fault("Output width not wide enough.")
        out: list[str] = []
        words: list[str] = []

        def end_line() -> None:
            if words:
                out.extend(_wrapped("".join(words), width))
                words.clear()

        def apart() -> None:
            if out and out[-1] != "":
                out.append("")

        def inline(n) -> None:
            for c in n.children:
                if isinstance(c, str):
                    words.append(re.sub(r"[ \t\n\r\f]+", " ", c))
                elif isinstance(c, dom.Element) and c.tag not in _GONE:
                    element(c)

        def element(c: dom.Element) -> None:
            tag = c.tag
            if tag == "br":
                if words:
                    end_line()
                else:
                    out.append("")
            elif tag == "img":
                words.append(f"[{c.attrs['alt']}]" if c.attrs.get("alt") else "")
            elif tag == "a" and c.attrs.get("href"):
                words.append("[")
                inline(c)
                self.links.append(c.attrs["href"])
                words.append(f"][{len(self.links)}]")
            elif tag in _BLOCKS:
                end_line()
                if tag == "hr":
                    out.append("─" * width)
                elif tag in ("ul", "ol"):
                    apart()
                    out.extend(self.list(c, width))
                    out.append("")
                elif tag == "blockquote":
                    apart()
                    out.extend(("> " + line).rstrip() if line else ">" for line in self.block(c, width - 2))
                    out.append("")
                elif tag == "pre":
                    apart()
                    for line in c.text().rstrip("\n").split("\n"):
                        out.extend(line[i : i + width] for i in range(0, len(line), width)) if line else out.append("")
                    out.append("")
                elif tag == "table":
                    apart()
                    out.extend(self.table(c, width))
                    out.append("")
                elif tag[0] == "h" and tag[1:].isdigit():
                    apart()
                    mark = "#" * int(tag[1:]) + " "
                    out.extend(mark + line for line in self.block(c, width - len(mark)))
                    out.append("")
                elif tag == "dd":
                    out.extend("  " + line for line in self.block(c, width - 2))
                else:
                    if tag == "p":
                        apart()
                    out.extend(self.block(c, width))
                    if tag == "p":
                        out.append("")
            else:
                mark = _MARKS.get(tag, "")
                words.append(mark)
                inline(c)
                words.append(mark)

        inline(node)
        end_line()
        while out and out[-1] == "":
            out.pop()
        while out and out[0] == "":
            out.pop(0)
        return out

    def list(self, node: dom.Element, width: int) -> list[str]:
        items = [c for c in node.children if isinstance(c, dom.Element) and c.tag not in _GONE]
        start = int(node.attrs["start"]) if re.fullmatch(r"-?\d+", node.attrs.get("start", "")) else 1
        wide = len(f"{start + len(items) - 1}. ") if node.tag == "ol" else 2
        out = []
        for i, item in enumerate(items):
            head = f"{start + i}. ".ljust(wide) if node.tag == "ol" else "* "
            lines = self.block(item, width - wide) or [""]
            out += [((head if k == 0 else " " * wide) + line).rstrip() for k, line in enumerate(lines)]
        return out

    def table(self, node: dom.Element, width: int) -> list[str]:
        rows = [[c for c in r.children if isinstance(c, dom.Element) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return []
        n = max(map(len, rows))
        want = [max([1, *(len(" ".join(r[i].text().split())) for r in rows if i < len(r))]) for i in range(n)]
        room = width - (n - 1)
        if room < n:
            raise Fault("Output width not wide enough.")
        if sum(want) > room:
            want = [max(1, w * room // sum(want)) for w in want]
        rule = "─" * (sum(want) + n - 1)
        out = [rule]
        for r in rows:
            cells = [self.block(r[i], want[i]) if i < len(r) else [] for i in range(n)]
            for k in range(max(map(len, cells), default=0)):
                out.append("│".join((cells[i][k] if k < len(cells[i]) else "").ljust(want[i]) for i in range(n)).rstrip())
            out.append(rule)
        return out


def _wrapped(text: str, width: int) -> list[str]:
    lines, now = [], ""
    for word in text.split():
        if now and len(now) + 1 + len(word) <= width:
            now += " " + word
            continue
        if now:
            lines.append(now)
        while len(word) > width:
            lines.append(word[:width])
            word = word[width:]
        now = word
    return [*lines, now] if now else lines


def html_to_text(width: int | None = None) -> Kernel:
    width = integer("htmlToText: width", 80 if width is None else width, 1, 1000, "htmlToText: width must be 1-1000")

    def run(s: str) -> str:
        t, limit = _Text(), sys.getrecursionlimit()
        try:
            # three calls a level: some 30,000 levels, which take about as many kilobytes
            sys.setrecursionlimit(max(limit, 100_000))
            lines = t.block(dom.parse(s), width)
        except RecursionError:
            raise Fault("nesting is too deep") from None
        finally:
            sys.setrecursionlimit(limit)
        if t.links:
            lines += ["", *(f"[{i}]: {href}" for i, href in enumerate(t.links, 1))]
        return "".join(line + "\n" for line in lines)

    return Kernel("htmlToText", STR, "string", run)
