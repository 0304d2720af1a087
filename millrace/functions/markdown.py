"""Markdown to HTML: CommonMark blocks and inlines, with tables, strikethrough, autolinks, task lists, tag filter, footnotes and smart punctuation.

Blocks are read line by line against the stack of open blocks, inlines with a delimiter stack; neither recurses,
so nesting may be of any depth, and no text is read twice for want of an end that it lacks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from html.entities import html5
from urllib.parse import quote

from .kernel import STR, Kernel

_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
).replace(" ", "|")
_ATTR = r"""\s+[a-zA-Z_:][a-zA-Z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_OPEN = rf"<[A-Za-z][A-Za-z0-9-]*(?:{_ATTR})*\s*/?>"
_CLOSE = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML_STARTS = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{_BLOCK_TAGS})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_OPEN}|{_CLOSE})\s*$"), None),
]
_INLINE_HTML = re.compile(rf"{_OPEN}|{_CLOSE}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FENCE = re.compile(r"(`{3,}|~{3,})([^\n]*)$")
_BULLET = re.compile(r"[-+*](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_DELIM_ROW = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FOOT_DEF = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*")
_TASK = re.compile(r"\[([ xX])\][ \t]+(?=\S)")
_FILTERED = re.compile(r"<(?=/?(?:title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)(?:[\s/>]|$))", re.I)


class Options:
    def __init__(self, gfm: bool, tables: bool, footnotes: bool, smart: bool, unsafe: bool):
        self.gfm, self.tables, self.footnotes, self.smart, self.unsafe = gfm, tables, footnotes, smart, unsafe


class Block:
    __slots__ = ("kind", "children", "lines", "text", "info", "start", "end")

    def __init__(self, kind: str, line: int = 0, **info):
        self.kind, self.children, self.lines, self.text, self.info, self.start, self.end = kind, [], [], "", info, line, line


def esc(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _entity(m: re.Match) -> str:
    e = m[0]
    if e[1] == "#":
        n = int(e[3:-1], 16) if e[2] in "xX" else int(e[2:-1])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"
    return html5.get(e[1:], e)


def _plain(s: str) -> str:
    """Backslash escapes and entities resolved."""
    return re.sub(rf"\\([{re.escape(_PUNCT)}])|{_ENTITY.pattern}", lambda m: m[1] if m[1] else _entity(re.match(r".*", m[0], re.S)), s)


def _url(s: str) -> str:
    return quote(s, safe="!#$%&'()*+,-./:;=?@_~").replace("&", "&amp;").replace("'", "&#x27;")


# -- blocks


class _Line:
    """A line that is consumed by columns; pad is what is left of a tab that was consumed in part."""

    __slots__ = ("s", "i", "col", "pad", "tails")

    def __init__(self, s: str):
        self.s, self.i, self.col, self.pad = s, 0, 0, 0
        self.tails: dict[str, int] = {}

    def look(self) -> tuple[int, int]:
        """Columns of indentation, and the place of the first character behind it."""
        s, j, n = self.s, self.i, len(self.s)
        col = self.col + self.pad
        while j < n:
            if s[j] == " ":
                col += 1
            elif s[j] == "\t":
                col += 4 - col % 4
            else:
                break
            j += 1
        return col - self.col, j

    def skip(self, n: int) -> None:
        """Consume up to n columns of blanks."""
        while n > 0:
            if self.pad:
                t = min(self.pad, n)
                self.pad, self.col, n = self.pad - t, self.col + t, n - t
            elif self.s[self.i : self.i + 1] == " ":
                self.i, self.col, n = self.i + 1, self.col + 1, n - 1
            elif self.s[self.i : self.i + 1] == "\t":
                self.i, self.pad = self.i + 1, 4 - self.col % 4
            else:
                return

    def take(self, n: int) -> None:
        """Consume n characters other than tabs."""
        self.i, self.col = self.i + n, self.col + n

    def rest(self) -> str:
        return " " * self.pad + self.s[self.i :]

    def is_rule(self, j: int) -> bool:
        """Whether from j on the line is three marks or more, all like the first, and blanks."""
        c = self.s[j]
        tail = self.tails.get(c)
        if tail is None:
            tail = self.tails[c] = len(self.s.rstrip(c + " \t"))
        return tail <= j and self.s.count(c, j) >= 3


_CONTAINERS = frozenset(("document", "quote", "list", "item", "note"))
#: Characters that a block other than a paragraph may begin with.
_STARTS = frozenset(">#`~<=-*+_[|:0123456789")


class Parser:
    def __init__(self, options: Options):
        self.o = options
        self.refs: dict[str, tuple[str, str]] = {}
        self.notes: dict[str, Block] = {}

    def parse(self, source: str) -> Block:
        self.open = [Block("document")]
        self.number = 0
        text = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
        lines = text.split("\n")
        if lines and not lines[-1]:
            lines.pop()
        for line in lines:
            self.number += 1
            self.line(_Line(line))
        self.close(1)
        return self.open[0]

    def line(self, at: _Line) -> None:
        """Find the open blocks that the line goes on, the blocks that begin in it, and add what is left."""
        k = self.go_on(at)
        if k < 0:
            return
        lazy_para = self.open[-1] if self.open[-1].kind == "paragraph" and k < len(self.open) else None
        began = False
        while True:
            block = self.open[k - 1] if not began else self.open[-1]
            if block.kind in ("code", "html"):
                break
            indent, j = at.look()
            if j >= len(at.s):
                break
            if indent >= 4:
                if block.kind not in ("paragraph", "table") and (began or lazy_para is None):
                    self.close(k if not began else len(self.open))
                    at.skip(4)
                    self.add(Block("code", self.number, fence=""))
                    began = True
                break
            if at.s[j] not in _STARTS:
                break
            done = self.begin(at, indent, j, block, k if not began else len(self.open))
            if done is None:
                break
            if done:
                return
            began = True
        self.content(at, k, began, lazy_para)

    def go_on(self, at: _Line) -> int:
        """The number of open blocks that the line belongs to; -1 when it only ends one."""
        k = 1
        while k < len(self.open):
            b = self.open[k]
            kind = b.kind
            if kind == "list":
                k += 1
                continue
            indent, j = at.look()
            blank = j >= len(at.s)
            if kind == "item":
                if blank:
                    if not b.children:
                        return k
                elif indent >= b.info["width"]:
                    at.skip(b.info["width"])
                else:
                    return k
            elif kind == "paragraph":
                return k if blank else k + 1
            elif kind == "quote":
                if blank or indent >= 4 or at.s[j] != ">":
                    return k
                at.skip(indent)
                at.take(1)
                at.skip(1)
                b.end = self.number
            elif kind == "code":
                if b.info["fence"]:
                    mark, n, own = b.info["fence"]
                    if not blank and indent < 4 and at.s[j] == mark:
                        tail = at.s[j:].rstrip(" \t")
                        if len(tail) >= n and tail == mark * len(tail):
                            b.end = self.number
                            self.close(k)
                            return -1
                    at.skip(own)
                elif indent >= 4:
                    at.skip(4)
                elif not blank:
                    return k
                else:
                    at.skip(indent)
            elif kind == "html":
                if blank and b.info["close"] is None:
                    return k
            elif kind == "note":
                if not blank:
                    if indent < 4:
                        return k
                    at.skip(4)
            elif blank:  # a table
                return k
            k += 1
        return k

    def begin(self, at: _Line, indent: int, j: int, block: Block, k: int) -> bool | None:
        """Begin a block: None if none begins here, True when the line is used up, False when it may hold more."""
        s, c = at.s, at.s[j]
        para = block if block.kind == "paragraph" else None
        if c == ">":
            self.close(k)
            at.skip(indent)
            at.take(1)
            at.skip(1)
            self.add(Block("quote", self.number))
            return False
        if c == "#":
            n = 1
            while n < 7 and s[j + n : j + n + 1] == "#":
                n += 1
            if n <= 6 and s[j + n : j + n + 1] in ("", " ", "\t"):
                text = s[j + n :].strip(" \t")
                bare = text.rstrip("#")
                text = "" if not bare else bare.rstrip(" \t") if bare[-1] in " \t" else text
                self.close(k)
                self.add(Block("heading", self.number, level=n)).text = text
                self.close(len(self.open) - 1)
                return True
        elif c in "`~":
            m = _FENCE.match(s, j)
            if m and not (c == "`" and "`" in m[2]):
                self.close(k)
                self.add(Block("code", self.number, fence=(c, len(m[1]), indent), lang=_plain(m[2].strip())))
                return True
        elif c == "<":
            kind = next((n for n, (start, _) in enumerate(_HTML_STARTS) if start.match(s, j)), None)
            # the last kind ends no paragraph, nor one that the line would go on lazily
            if kind is not None and not (kind == 6 and (para is not None or self.open[-1].kind == "paragraph")):
                self.close(k)
                self.add(Block("html", self.number, close=_HTML_STARTS[kind][1]))
                return False
            return None
        if c in "=-" and para is not None and (m := _SETEXT.match(s, j)):
            self.paragraph(para)
            if para.text:
                para.kind, para.info, para.end = "heading", {"level": 1 if c == "=" else 2}, self.number
                self.open.pop()
                return True
            para.kind = "reference"
            self.open.pop()
            block, para, k = self.open[-1], None, k - 1
        if c in "*-_" and at.is_rule(j):
            self.close(k)
            self.add(Block("rule", self.number))
            self.close(len(self.open) - 1)
            return True
        if (c in "*+-" and (m := _BULLET.match(s, j))) or (c.isdigit() and (m := _ORDERED.match(s, j))):
            ordered = m.re is _ORDERED
            if para is None or (s[m.end() :].strip(" \t") and (not ordered or int(m[1]) == 1)):
                self.item(at, indent, m, ordered, k)
                return False
        if self.o.footnotes and c == "[" and para is None and (m := _FOOT_DEF.match(s, j)):
            self.close(k)
            at.skip(indent)
            at.take(m.end() - j)
            note = Block("note", self.number)
            self.notes.setdefault(_label(m[1]), note)
            self.room(False)
            self.open.append(note)
            return False
        if self.o.tables and c in "|:-" and para is not None and k == len(self.open) and (m := _DELIM_ROW.match(s, j)) and "|" in para.lines[-1] + s[j:]:
            head, marks = _cells(para.lines[-1]), _cells(s[j:])
            if len(head) == len(marks):
                self.table(para, head, marks)
                return True
        return None

    def item(self, at: _Line, indent: int, m: re.Match, ordered: bool, k: int) -> None:
        mark = m[2] if ordered else m[0]
        at.skip(indent)
        at.take(m.end() - m.start())
        gap, j = at.look()
        empty = j >= len(at.s)
        size = 1 if empty or gap >= 5 else gap
        at.skip(size)
        self.close(k)
        self.room(True)
        top = self.open[-1]
        if top.kind != "list" or top.info["mark"] != mark:
            self.add(Block("list", self.number, ordered=ordered, mark=mark, start=int(m[1]) if ordered else 0, tight=True))
        self.add(Block("item", self.number, width=indent + m.end() - m.start() + size))

    def table(self, para: Block, head: list[str], marks: list[str]) -> None:
        align = ["center" if c[0] == c[-1] == ":" and len(c) > 1 else "left" if c[0] == ":" else "right" if c[-1] == ":" else "" for c in marks]
        para.lines.pop()
        if para.lines:
            para.end -= 1
            self.close(len(self.open) - 1)
            self.add(Block("table", self.number - 1, align=align, rows=[head]))
        else:
            para.kind, para.info = "table", {"align": align, "rows": [head]}
        self.open[-1].end = self.number

    def content(self, at: _Line, k: int, began: bool, lazy_para: Block | None) -> None:
        """Add what is left of the line behind its containers' marks."""
        indent, j = at.look()
        blank = j >= len(at.s)
        if not began and not blank and lazy_para is not None:
            lazy_para.lines.append(at.s[j:])
            lazy_para.end = self.number
            return
        if not began:
            self.close(k)
        b = self.open[-1]
        if b.kind in ("code", "html"):
            b.lines.append(at.rest())
            if b.kind == "html" and b.info["close"] is not None and b.info["close"].search(at.s, at.i):
                b.end = self.number
                self.close(len(self.open) - 1)
            elif not blank or b.kind == "code" and b.info["fence"]:
                b.end = self.number
        elif blank:
            return
        elif b.kind == "table":
            row = _cells(at.s[j:])
            n = len(b.info["align"])
            b.info["rows"].append((row + [""] * n)[:n])
            b.end = self.number
        elif b.kind == "paragraph":
            b.lines.append(at.s[j:])
            b.end = self.number
        else:
            self.add(Block("paragraph", self.number)).lines.append(at.s[j:])

    def add(self, b: Block) -> Block:
        """Make b the last child of the innermost open block that can hold it."""
        self.room(b.kind == "item")
        self.open[-1].children.append(b)
        self.open.append(b)
        return b

    def room(self, item: bool) -> None:
        """Close leaves, and lists unless for an item, until the innermost open block can hold another."""
        while (kind := self.open[-1].kind) not in _CONTAINERS or (kind == "list" and not item):
            self.close(len(self.open) - 1)

    def close(self, k: int) -> None:
        """Close the open blocks from the k-th on, the innermost first."""
        while len(self.open) > k:
            b = self.open.pop()
            if b.kind == "paragraph":
                self.paragraph(b)
                if not b.text:
                    b.kind = "reference"
                elif self.o.gfm and self.open[-1].kind == "item" and self.open[-1].children[0] is b and (m := _TASK.match(b.text)):
                    self.open[-1].info["task"] = m[1] != " "
                    b.text = b.text[m.end() :]
            elif b.kind == "code":
                if not b.info["fence"]:
                    while b.lines and not b.lines[-1].strip(" \t"):
                        b.lines.pop()
                b.text = "".join(line + "\n" for line in b.lines)
            elif b.kind == "html":
                while b.lines and not b.lines[-1].strip(" \t"):
                    b.lines.pop()
                b.text = "".join(line + "\n" for line in b.lines)
            elif b.kind in _CONTAINERS and b.children:
                b.end = max(b.end, b.children[-1].end)
                if b.kind == "list":
                    apart = lambda x: any(one.end < other.start - 1 for one, other in zip(x, x[1:]))
                    b.info["tight"] = not (apart(b.children) or any(apart(item.children) for item in b.children))
            b.lines = []

    def paragraph(self, para: Block) -> None:
        """The text of a paragraph, link reference definitions at its beginning taken off."""
        text, at = "\n".join(para.lines).rstrip(" \t"), 0
        while text.startswith("[", at):
            m = _REF.match(text, at)
            if not m or not m[1].strip() or (self.o.footnotes and m[1].startswith("^")):
                break
            end, title = m.end(), ""
            t = _REF_TITLE.match(text, end)
            if t and "\n\n" not in t[1]:
                title, end = t[1][1:-1], t.end()
            elif e := _REST_OF_LINE.match(text, end):
                end = e.end()
            else:
                break
            dest = m[2][1:-1] if m[2].startswith("<") else m[2]
            self.refs.setdefault(_label(m[1]), (_plain(dest), _plain(title)))
            at = end
        para.text = text[at:]
        para.lines = [para.text] if para.text else []


_REF = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*+>|[^\s<]\S*+)")
_REF_TITLE = re.compile(r"(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|\((?:[^()\\]|\\.)*+\))[ \t]*(?:\n|$)")
_REST_OF_LINE = re.compile(r"[ \t]*(?:\n|$)")


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def _cells(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    parts = re.split(r"(?<!\\)\|", s)
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


# -- inlines

_TICKS = re.compile("`+")
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*+)>")
_MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]++@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
_FULL_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_HTML_TAG = re.compile(rf"{_OPEN}|{_CLOSE}")
_DASHES = re.compile("-{2,}")
_MAIL_NAME = re.compile(r"[A-Za-z0-9._+-]+$")
#: HTML that ends where a string does: its beginning, the least size of that, and its end.
_UP_TO = (("<!--", 4, "-->"), ("<?", 2, "?>"), ("<![CDATA[", 9, "]]>"), ("<!", 2, ">"))
_UNSAFE = re.compile(r"\s*(?:javascript|vbscript|file|data(?!:image/(?:png|gif|jpeg|webp))):", re.I)


_PAREN = re.compile(r"\([ \t\n]*+")
_ANGLED = re.compile(r"<((?:[^<>\n\\]|\\.)*+)>")
_TITLE = re.compile(r"[ \t\n]+(\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|\((?:[^()\\]|\\.)*+\))", re.S)
_CLOSING = re.compile(r"[ \t\n]*+\)")
_AT = re.compile(r"@([A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++)")
_BARE = re.compile(r"(?:(?:https?|ftp)://|www\.)[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+[^\s<]*+", re.I)


class Delim:
    """A run of delimiters: what it closes, what is left of it, and what it opens."""

    __slots__ = ("c", "n", "whole", "open", "close", "closed", "opened", "quote")

    def __init__(self, c: str, n: int, opens: bool, closes: bool):
        self.c, self.n, self.whole, self.open, self.close = c, n, n, opens, closes
        self.closed: list[str] = []
        self.opened: list[str] = []
        self.quote = ""

    def __str__(self) -> str:
        if self.quote:
            return self.quote
        if self.c == "'":
            return "‘" if self.open and not self.close else "’"
        if self.c == '"':
            return "“" if self.open else "”"
        return "".join(self.closed) + self.c * self.n + "".join(reversed(self.opened))


class Inline:
    """Inline content of one block, by the delimiter stack algorithm."""

    def __init__(self, parser: Parser, used: list[str]):
        self.p, self.o, self.used = parser, parser.o, used
        special = "\\\\`&<\\n*_!\\[\\]" + ("~" if self.o.gfm else "") + ("\"'" if self.o.smart else "")
        self.special = re.compile(f"[{special}@]|(?:https?|ftp)://|www\\." if self.o.gfm else f"[{special}]", re.I)

    def text(self, s: str) -> str:
        if self.o.smart:
            s = _DASHES.sub(_dashes, s.replace("...", "…"))
        return esc(s)

    def render(self, s: str) -> str:
        s = s.strip(" \t\n")
        found = self.special.search(s)
        if found is None:
            return self.text(s)
        self.ticks: dict[int, list[int]] | None = None
        self.gone: set[str] = set()
        out: list = []
        self.delims: list[Delim] = []
        self.brackets: list[tuple[int, bool, int, int]] = []
        self.shut = 0  # brackets below this place open no link: a link stands in them
        i = 0
        plain: list[str] = []
        while found is not None:
            k = found.start()
            if k > i:
                plain.append(s[i:k])
            i = self.at(s, k, out, plain)
            found = self.special.search(s, i)
        plain.append(s[i:])
        self.flush(out, plain)
        self.emphasis(0)
        return "".join(map(str, out))

    def flush(self, out: list, plain: list[str]) -> None:
        if plain:
            text = "".join(plain)
            plain.clear()
            if text:
                out.append(self.text(text))

    def at(self, s: str, i: int, out: list, plain: list[str]) -> int:
        """Deal with the special character at i; the place behind what was taken."""
        c = s[i]
        if c == "\\":
            after = s[i + 1 : i + 2]
            if after == "\n":
                self.flush(out, plain)
                out.append("<br />\n")
                return _behind_blanks(s, i + 2)
            if after and after in _PUNCT:
                self.flush(out, plain)
                out.append(esc(after))
                return i + 2
        elif c == "`":
            return self.code(s, i, out, plain)
        elif c == "&":
            if (m := _ENTITY.match(s, i)) and (value := _entity(m)) != m[0]:
                self.flush(out, plain)
                out.append(esc(value))
                return m.end()
        elif c == "<":
            if (end := self.angle(s, i, out, plain)) > i:
                return end
        elif c == "\n":
            text = "".join(plain)
            bare = text.rstrip(" ")
            plain[:] = [bare]
            self.flush(out, plain)
            out.append("<br />\n" if len(text) - len(bare) >= 2 else "\n")
            return _behind_blanks(s, i + 1)
        elif c in "*_~\"'":
            n = 1
            while c not in "\"'" and s[i + n : i + n + 1] == c:
                n += 1
            self.flush(out, plain)
            d = self.delimiter(s, i, c, n)
            out.append(d)
            self.delims.append(d)
            return i + n
        elif c == "!":
            if s[i + 1 : i + 2] == "[" and not (self.o.footnotes and s[i + 2 : i + 3] == "^"):
                return self.bracket_open(s, i, True, out, plain)
        elif c == "[":
            return self.bracket_open(s, i, False, out, plain)
        elif c == "]":
            self.flush(out, plain)
            return self.bracket_close(s, i, out)
        else:
            # an address's name may lie in several pieces; no more of the text than its greatest length is looked at
            text = plain.pop() if plain else ""
            while plain and len(text) < 320:
                text = plain.pop() + text
            if len(text) > 4096:
                plain.append(text[:-1024])
                text = text[-1024:]
            plain.append(text)
            if m := self.autolink(s, i, text):
                size, back, html = m
                if back:
                    plain[-1] = text[: len(text) - back]
                self.flush(out, plain)
                out.append(html)
                return i + size
        plain.append(c)
        return i + 1

    def code(self, s: str, i: int, out: list, plain: list[str]) -> int:
        if self.ticks is None:
            self.ticks = {}
            for m in _TICKS.finditer(s):
                self.ticks.setdefault(len(m[0]), []).append(m.start())
        n = _TICKS.match(s, i).end() - i
        same = self.ticks.get(n, [])
        k = bisect_left(same, i + n)
        if k == len(same):
            plain.append("`" * n)
            return i + n
        self.flush(out, plain)
        code = s[i + n : same[k]].replace("\n", " ")
        if len(code) > 1 and code[0] == code[-1] == " " and code.strip(" "):
            code = code[1:-1]
        out.append(f"<code>{esc(code)}</code>")
        return same[k] + n

    def angle(self, s: str, i: int, out: list, plain: list[str]) -> int:
        if ">" in self.gone or s.find(">", i) < 0:
            self.gone.add(">")
            return i
        if m := _URI.match(s, i):
            html = f'<a href="{_url(m[1])}">{esc(m[1])}</a>'
        elif m := _MAIL.match(s, i):
            html = f'<a href="mailto:{_url(m[1])}">{esc(m[1])}</a>'
        elif m := _HTML_TAG.match(s, i):
            html = self.raw(m[0])
        else:
            if s.startswith(("<!-->", "<!--->"), i):
                end = s.index(">", i) + 1
            else:
                end = i
                for start, n, last in _UP_TO:
                    if s.startswith(start, i) and last not in self.gone and (start != "<!" or s[i + 2 : i + 3].isalpha()):
                        k = s.find(last, i + n)
                        if k >= 0:
                            end = k + len(last)
                        else:
                            self.gone.add(last)
                        break
            if end > i:
                self.flush(out, plain)
                out.append(self.raw(s[i:end]))
            return end
        self.flush(out, plain)
        out.append(html)
        return m.end()

    def raw(self, html: str) -> str:
        if not self.o.unsafe:
            return esc(html)
        return _FILTERED.sub("&lt;", html) if self.o.gfm else html

    def delimiter(self, s: str, i: int, c: str, n: int) -> Delim:
        before, after = s[i - 1] if i else "\n", s[i + n] if i + n < len(s) else "\n"
        punct = lambda x: x in _PUNCT or _is_punct(x)
        left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
        right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
        if c == "_":
            return Delim(c, n, left and (not right or punct(before)), right and (not left or punct(after)))
        if c in "\"'":
            return Delim(c, n, left and not right, right)
        return Delim(c, n, left and not (c == "~" and n > 2), right and not (c == "~" and n > 2))

    def emphasis(self, bottom: int) -> None:
        """Match the delimiters of the stack from ``bottom`` on, and take them off it.

        Openers that a kind of closer has not found are not looked at again for closers of that kind.
        """
        ds = self.delims[bottom:]
        del self.delims[bottom:]
        before, after = list(range(-1, len(ds) - 1)), list(range(1, len(ds) + 1))
        least: dict[tuple, int] = {}

        def out_of_list(k: int) -> None:
            if before[k] >= 0:
                after[before[k]] = after[k]
            if after[k] < len(ds):
                before[after[k]] = before[k]

        k = 0
        while k < len(ds):
            d = ds[k]
            if not d.close:
                k = after[k]
                continue
            key = (d.c, d.n) if d.c == "~" else (d.c, d.open, d.whole % 3)
            j = before[k]
            while j > least.get(key, -1):
                o = ds[j]
                if o.c == d.c and o.open:
                    if d.c == "~":
                        if o.n == d.n:
                            break
                    elif d.c in "\"'" or not ((o.close or d.open) and (o.whole + d.whole) % 3 == 0 and (o.whole % 3 or d.whole % 3)):
                        break
                j = before[j]
            else:
                least[key] = before[k]
                if not d.open:
                    out_of_list(k)
                k = after[k]
                continue
            # what lies between the two stays text
            after[j], before[k] = k, j
            o = ds[j]
            if d.c in "\"'":
                o.quote, d.quote = ("“", "”") if d.c == '"' else ("‘", "’")
                o.n = d.n = 0
            else:
                use = o.n if d.c == "~" else 2 if o.n >= 2 and d.n >= 2 else 1
                tag = "del" if d.c == "~" else "strong" if use == 2 else "em"
                o.n, d.n = o.n - use, d.n - use
                o.opened.append(f"<{tag}>")
                d.closed.append(f"</{tag}>")
            if not o.n:
                out_of_list(j)
            if not d.n:
                out_of_list(k)
                k = after[k]

    def bracket_open(self, s: str, i: int, image: bool, out: list, plain: list[str]) -> int:
        self.flush(out, plain)
        self.shut = min(self.shut, len(self.brackets))
        self.brackets.append((len(out), image, i + 1 + image, len(self.delims)))
        out.append("![" if image else "[")
        return i + 1 + image

    def bracket_close(self, s: str, i: int, out: list) -> int:
        if not self.brackets:
            out.append("]")
            return i + 1
        at, image, begin, bottom = self.brackets.pop()
        if not image and len(self.brackets) < self.shut:
            out.append("]")
            return i + 1
        label = s[begin:i] if i - begin < 1000 else ""
        if self.o.footnotes and not image and label.startswith("^") and (name := _label(label[1:])) in self.p.notes:
            if name not in self.used:
                self.used.append(name)
            n = self.used.index(name) + 1
            del out[at:], self.delims[bottom:]
            key = _url(label[1:])
            out.append(f'<sup class="footnote-ref"><a href="#fn-{key}" id="fnref-{key}" data-footnote-ref>{n}</a></sup>')
            return i + 1
        target = self.target(s, i + 1)
        if target is not None:
            dest, title, end = target
        else:
            m = _FULL_LABEL.match(s, i + 1)
            label = m[1] if m and m[1].strip() else label
            ref = self.p.refs.get(_label(label)) if self.p.refs and "[" not in re.sub(r"\\.", "", label) else None
            if ref is None:
                out.append("]")
                return i + 1
            dest, title = ref
            end = m.end() if m else i + 1
        self.emphasis(bottom)
        content = "".join(map(str, out[at + 1 :]))
        del out[at:]
        if not self.o.unsafe and _UNSAFE.match(dest):
            dest = ""
        t = f' title="{esc(title)}"' if title else ""
        if image:
            alt = re.sub(r'<img[^>]*? alt="([^"]*)"[^>]*>', r"\1", content)
            out.append(f'<img src="{_url(dest)}" alt="{re.sub(r"<[^>]*>", "", alt)}"{t} />')
        else:
            out.append(f'<a href="{_url(dest)}"{t}>{content}</a>')
            self.shut = len(self.brackets)
        return end

    @staticmethod
    def target(s: str, i: int) -> tuple[str, str, int] | None:
        """(destination, title, end) of an inline link's brackets."""
        if s[i : i + 1] != "(":
            return None
        m = _PAREN.match(s, i)
        i = m.end()
        if s[i : i + 1] == "<":
            m = _ANGLED.match(s, i)
            if not m:
                return None
            dest, i = m[1], m.end()
        else:
            start, depth = i, 0
            while i < len(s) and s[i] not in " \t\n" and s[i] >= " ":
                if s[i] == "\\" and s[i + 1 : i + 2] and s[i + 1] in _PUNCT:
                    i += 2
                    continue
                if s[i] == "(":
                    depth += 1
                    if depth > 32:
                        return None
                elif s[i] == ")":
                    if not depth:
                        break
                    depth -= 1
                i += 1
            if depth:
                return None
            dest = s[start:i]
        title = ""
        m = _TITLE.match(s, i)
        if m:
            title, i = m[1][1:-1], m.end()
        m = _CLOSING.match(s, i)
        return (_plain(dest), _plain(title), m.end()) if m else None

    def autolink(self, s: str, i: int, plain: str) -> tuple[int, int, str] | None:
        """A bare address at i: (size, characters of the text before that belong to it, HTML)."""
        if s[i] == "@":
            m = _AT.match(s, i)
            name = _MAIL_NAME.search(plain, max(0, len(plain) - 320))
            if not name or not m or m[1][-1] in "-_":
                return None
            mail = name[0] + m[0]
            return m.end() - i, len(name[0]), f'<a href="mailto:{_url(mail)}">{esc(mail)}</a>'
        if plain and not (plain[-1].isspace() or plain[-1] in "*_~("):
            return None
        m = _BARE.match(s, i)
        if not m or (m[0].lower().startswith("www.") and "." not in m[0][4:]):
            return None
        link = m[0]
        while True:
            short = link.rstrip("?!.,:*_~'\"")
            if short.endswith(")") and short.count(")") > short.count("("):
                short = short[:-1]
            if short.endswith(";") and (e := re.search(r"&[A-Za-z0-9]+;$", short)):
                short = short[: e.start()]
            if short == link:
                break
            link = short
        href = link if re.match(r"(?:https?|ftp)://", link, re.I) else "http://" + link
        return len(link), 0, f'<a href="{_url(href)}">{esc(link)}</a>'


def _behind_blanks(s: str, i: int) -> int:
    while s[i : i + 1] == " ":
        i += 1
    return i


@lru_cache(maxsize=4096)
def _is_punct(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def _dashes(m: re.Match) -> str:
    n = len(m[0])
    em, en = (n // 3, 0) if n % 3 == 0 else (0, n // 2) if n % 2 == 0 else ((n - 2) // 3, 1) if n % 3 == 2 else ((n - 4) // 3, 2)
    return "—" * em + "–" * en


# -- rendering


class Renderer:
    def __init__(self, parser: Parser):
        self.p, self.o, self.used = parser, parser.o, []
        self.inline = Inline(parser, self.used)

    def document(self, root: Block) -> str:
        out: list[str] = []
        for b in root.children:
            self.block(b, out, False)
        if self.used:
            self.notes(out)
        return "".join(out)

    def notes(self, out: list[str]) -> None:
        out.append('<section class="footnotes" data-footnotes>\n<ol>\n')
        k = 0
        while k < len(self.used):
            name = self.used[k]
            k += 1
            inner: list[str] = []
            for b in self.p.notes[name].children:
                self.block(b, inner, False)
            key = _url(name)
            back = f' <a href="#fnref-{key}" class="footnote-backref" data-footnote-backref data-footnote-backref-idx="{k}" aria-label="Back to reference {k}">↩</a>'
            body = "".join(inner)
            body = body[: -len("</p>\n")] + back + "</p>\n" if body.endswith("</p>\n") else body + back + "\n"
            out.append(f'<li id="fn-{key}">\n{body}</li>\n')
        out.append("</ol>\n</section>\n")

    def block(self, b: Block, out: list[str], tight: bool) -> None:
        """Write a block: a stack of blocks, of strings, and of a mark for the line break that out may lack."""
        todo: list = [(b, tight)]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if x or (out and not out[-1].endswith("\n")):
                    out.append(x or "\n")
                continue
            b, tight = x
            kind = b.kind
            if kind == "paragraph":
                text = self.inline.render(b.text)
                out.append(text if tight else f"<p>{text}</p>\n")
            elif kind == "heading":
                out.append(f"<h{b.info['level']}>{self.inline.render(b.text)}</h{b.info['level']}>\n")
            elif kind == "rule":
                out.append("<hr />\n")
            elif kind == "code":
                lang = (b.info.get("lang") or "").split()[:1]
                out.append(f'<pre><code class="language-{esc(lang[0])}">' if lang else "<pre><code>")
                out.append(f"{esc(b.text)}</code></pre>\n")
            elif kind == "html":
                text = b.text if self.o.unsafe else esc(b.text)
                out.append(_FILTERED.sub("&lt;", text) if self.o.unsafe and self.o.gfm else text)
            elif kind == "quote":
                out.append("<blockquote>\n")
                todo.append("</blockquote>\n")
                todo += [(c, False) for c in reversed(b.children)]
            elif kind == "list":
                tag = "ol" if b.info["ordered"] else "ul"
                start = f' start="{b.info["start"]}"' if b.info["ordered"] and b.info["start"] != 1 else ""
                out.append(f"<{tag}{start}>\n")
                todo.append(f"</{tag}>\n")
                todo += [(item, b.info["tight"]) for item in reversed(b.children)]
            elif kind == "item":
                out.append("<li>")
                if "task" in b.info:
                    out.append(f'<input type="checkbox"{" checked=\"\"" if b.info["task"] else ""} disabled="" /> ')
                todo.append("</li>\n")
                children = [c for c in b.children if c.kind != "reference"]
                for k, c in reversed(list(enumerate(children))):
                    todo.append((c, tight))
                    if not (tight and c.kind == "paragraph") or k:
                        todo.append("")
            elif kind == "table":
                self.table(b, out)

    def table(self, b: Block, out: list[str]) -> None:
        def cells(row: list[str], tag: str) -> None:
            out.append("<tr>\n")
            for text, align in zip(row, b.info["align"]):
                out.append(f"<{tag}{f' align=\"{align}\"' if align else ''}>{self.inline.render(text)}</{tag}>\n")
            out.append("</tr>\n")

        head, *rows = b.info["rows"]
        out.append("<table>\n<thead>\n")
        cells(head, "th")
        out.append("</thead>\n")
        if rows:
            out.append("<tbody>\n")
            for row in rows:
                cells(row, "td")
            out.append("</tbody>\n")
        out.append("</table>\n")


def markdown_to_html(gfm: bool | None = None, tables: bool | None = None, footnotes: bool | None = None, smart_punct: bool | None = None, unsafe: bool | None = None) -> Kernel:
    """gfm is on and brings tables; footnotes, smart punctuation and raw HTML are off, raw HTML is escaped then."""
    gfm = True if gfm is None else gfm
    options = Options(gfm, gfm if tables is None else tables, bool(footnotes), bool(smart_punct), bool(unsafe))

    def run(s: str) -> str:
        parser = Parser(options)
        return Renderer(parser).document(parser.parse(s))

    return Kernel("markdownToHtml", STR, "string", run)



