"""JSON on raw text: strict validation, and a dotted path language whose results keep the text they were read from."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from ..errors import Fault, InvalidArg
from .kernel import ANY, Kernel, as_text

_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[Ee][-+]?\d+)?")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SPACE = re.compile(rb"[ \t\n\r]*")
_WORDS = {0x74: b"true", 0x66: b"false", 0x6E: b"null"}


def valid(data: bytes) -> bool:
    """RFC 8259, at any depth; the bytes must be UTF-8."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    at, n, stack = _SPACE.match(data).end(), len(data), []
    while True:
        # a value begins here
        c = data[at] if at < n else 0
        if c == 0x7B or c == 0x5B:
            at = _SPACE.match(data, at + 1).end()
            if at < n and data[at] == c + 2:
                at += 1
            else:
                stack.append(c)
                if c == 0x7B and (at := _key(data, at)) < 0:
                    return False
                continue
        elif c == 0x22:
            m = _STRING.match(data, at)
            if not m:
                return False
            at = m.end()
        elif word := _WORDS.get(c):
            if not data.startswith(word, at):
                return False
            at += len(word)
        else:
            m = _NUMBER.match(data, at)
            if not m:
                return False
            at = m.end()
        # a value has ended
        while True:
            at = _SPACE.match(data, at).end()
            if not stack:
                return at == n
            if at >= n:
                return False
            if data[at] == stack[-1] + 2:
                stack.pop()
                at += 1
                continue
            if data[at] != 0x2C:
                return False
            at = _SPACE.match(data, at + 1).end()
            if stack[-1] == 0x7B and (at := _key(data, at)) < 0:
                return False
            break


def _key(data: bytes, at: int) -> int:
    m = _STRING.match(data, at)
    if not m:
        return -1
    at = _SPACE.match(data, m.end()).end()
    return _SPACE.match(data, at + 1).end() if data[at : at + 1] == b":" else -1


def validate() -> Kernel:
    return Kernel("jsonValidate", ANY, "boolean", lambda v: valid(v if isinstance(v, bytes) else _utf8(v)))


def _utf8(s: str) -> bytes:
    return s.encode("utf-8", "replace")


# -- paths


@dataclass(frozen=True)
class Part:
    """One step of a path: a key or index; a key pattern; or # (all elements)."""

    text: str
    wild: bool = False
    many: bool = False


@dataclass(frozen=True)
class Expression:
    """A path with queries, modifiers, pipes, literals or several paths in one, which is read as it is evaluated."""

    text: str


def parse_path(path: str) -> tuple[Part, ...] | Expression:
    """Dotted keys and indexes; backslash escapes; * and ? in keys; # for the elements of an array; or an expression."""
    if not path:
        raise InvalidArg("path must not be empty")
    if path.startswith(".."):
        return Expression(path)
    out, now, wild, i, begin = [], "", False, 0, True
    while i < len(path):
        c = path[i]
        if c == "|" or (begin and (c in "@{[!" or path.startswith("#(", i))):
            return Expression(path)
        begin = False
        if c == "\\" and i + 1 < len(path):
            i += 1
            now += re.escape(path[i]) if wild else path[i]
        elif c == ".":
            out.append(_part(now, wild))
            now, wild, begin = "", False, True
        elif c in "*?":
            if not wild:
                now, wild = re.escape(now), True
            now += ".*" if c == "*" else "."
        else:
            now += re.escape(c) if wild else c
        i += 1
    out.append(_part(now, wild))
    return tuple(out)


def _part(text: str, wild: bool) -> Part:
    return Part(text, wild, text == "#" and not wild)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^\s"{}\[\],:]+', re.S)
_BLANK = " \t\n\r"


def _skip(s: str, i: int, what: str = _BLANK) -> int:
    while i < len(s) and s[i] in what:
        i += 1
    return i


def _end(s: str, i: int) -> int:
    """Place behind the value that begins at i."""
    if i >= len(s):
        return i
    if s[i] not in "{[":
        m = _TOKEN.match(s, i)
        return m.end() if m else i + 1
    depth = 0
    for m in _TOKEN.finditer(s, i):
        c = s[m.start()]
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return m.end()
    return len(s)


_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unquote(raw: str) -> str:
    """The text of a JSON string literal; lone surrogates become U+FFFD."""
    s = raw[1:-1] if raw.endswith('"') and len(raw) > 1 else raw[1:]
    if "\\" not in s:
        return s
    s = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _SHORT.get(m[2], m[2]), s)
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def get(s: str, parts: tuple[Part, ...] | Expression) -> str | None:
    """Raw JSON text of the value at a path; None where there is none."""
    if isinstance(parts, Expression):
        return evaluate(s, parts.text)
    i = _skip(s, 0)
    for n, part in enumerate(parts):
        if i >= len(s) or s[i] not in "{[":
            return None
        found = None
        if s[i] == "{":
            j = _skip(s, i + 1, _BLANK + ",")
            while j < len(s) and s[j] == '"':
                e = _end(s, j)
                key = unquote(s[j:e])
                v = _skip(s, e, _BLANK + ":")
                if re.fullmatch(part.text, key, re.S) if part.wild else key == part.text:
                    found = v
                    break
                j = _skip(s, _end(s, v), _BLANK + ",")
        else:
            if not part.many and not part.text.isdigit():
                return None
            elements, j = [], _skip(s, i + 1, _BLANK + ",")
            while j < len(s) and s[j] != "]":
                e = _end(s, j)
                elements.append((j, e))
                if not part.many and len(elements) > int(part.text):
                    break
                j = _skip(s, e, _BLANK + ",")
            if part.many:
                if n == len(parts) - 1:
                    return str(len(elements))
                some = [get(s[a:b], parts[n + 1 :]) for a, b in elements]
                return "[" + ",".join(v for v in some if v is not None) + "]"
            if int(part.text) < len(elements):
                found = elements[int(part.text)][0]
        if found is None:
            return None
        i = found
    return s[i : _end(s, i)] or None


# -- expressions


def _items(s: str) -> list[str]:
    """Raw elements of an array; any other value is the only one."""
    i = _skip(s, 0)
    if s[i : i + 1] != "[":
        return [s]
    out, j = [], _skip(s, i + 1, _BLANK + ",")
    while j < len(s) and s[j] != "]":
        e = _end(s, j)
        out.append(s[j:e])
        j = _skip(s, e, _BLANK + ",")
    return out


def _members(s: str) -> list[tuple[str, str]]:
    """Raw keys and values of an object."""
    i = _skip(s, 0)
    out, j = [], _skip(s, i + 1, _BLANK + ",")
    while s[i : i + 1] == "{" and j < len(s) and s[j] == '"':
        e = _end(s, j)
        v = _skip(s, e, _BLANK + ":")
        z = _end(s, v)
        out.append((s[j:e], s[v:z]))
        j = _skip(s, z, _BLANK + ",")
    return out


def _array(items: Iterable[str]) -> str:
    return "[" + ",".join(items) + "]"


def _object(members: Iterable[tuple[str, str]]) -> str:
    return "{" + ",".join(f"{k}:{v}" for k, v in members) + "}"


def _kind(s: str) -> str:
    i = _skip(s, 0)
    return s[i : i + 1]


def _closing(path: str, i: int) -> int:
    """Place behind the bracket that closes the one at i; strings and escapes are skipped. The path's end where none does."""
    depth, n = 0, len(path)
    while i < n:
        c = path[i]
        if c == "\\":
            i += 1
        elif c == '"':
            i += 1
            while i < n and path[i] != '"':
                i += 2 if path[i] == "\\" else 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return n


def _until(path: str, i: int, stops: str) -> int:
    """Place of the first of the stops from i on that lies in no bracket and no string."""
    while i < len(path) and path[i] not in stops:
        if path[i] == "\\":
            i += 2
        elif path[i] in "([{":
            i = _closing(path, i)
        elif path[i] == '"':
            i = min(_end(path, i), len(path))
        else:
            i += 1
    return min(i, len(path))


def _then(raw: str | None, path: str, i: int) -> str | None:
    """What the rest of a path, which begins with a dot or a pipe, finds in a value."""
    return raw if raw is None or i >= len(path) else evaluate(raw, path[i + 1 :])


def _each(items: list[str], path: str, i: int) -> str | None:
    """The rest of a path in every item up to the next pipe, and what is behind that in the list of them."""
    if i < len(path) and path[i] == ".":
        stop = _until(path, i + 1, "|")
        found = (evaluate(x, path[i + 1 : stop]) for x in items)
        return _then(_array(v for v in found if v is not None), path, stop)
    return _then(_array(items), path, i)


def evaluate(s: str, path: str) -> str | None:
    """Raw JSON text of what an expression finds in a value; None where it finds nothing."""
    if path.startswith(".."):
        lines, i = [], _skip(s, 0)
        while i < len(s):
            e = _end(s, i)
            lines.append(s[i:e])
            i = _skip(s, e)
        return evaluate(_array(lines), path[2:] or "@this")
    if not path:
        return None
    c = path[0]
    if c == "@":
        return _modified(s, path)
    if c in "[{":
        return _several(s, path)
    if c == "!":
        stop = _until(path, 1, ".|")
        return _then(path[1:stop] or None, path, stop)
    stop = _until(path, 0, ".|")
    if path.startswith("#("):
        stop = _closing(path, 1)
        every = path[stop : stop + 1] == "#"
        if _kind(s) != "[":
            return None
        test = _query(path[2 : stop - 1])
        if every:
            return _each([x for x in _items(s) if test(x)], path, stop + 1)
        return _then(next((x for x in _items(s) if test(x)), None), path, stop)
    if path[:stop] == "#":
        if _kind(s) != "[":
            return None
        items = _items(s)
        return _each(items, path, stop) if path[stop : stop + 1] == "." else _then(str(len(items)), path, stop)
    return _then(get(s, (_component(path[:stop]),)), path, stop)


@lru_cache(maxsize=1024)
def _component(text: str) -> Part:
    found = parse_path(text) if text else ()
    return found[0] if isinstance(found, tuple) and found else Part(text)


_OPERATOR = re.compile(r"==|!=|<=|>=|!%|[=<>%]")


@lru_cache(maxsize=256)
def _query(text: str) -> Callable[[str], bool]:
    """A test of an element: a path in it (or itself) against a value; without an operator, whether it is there."""
    at = 0
    while at < len(text) and not (m := _OPERATOR.match(text, at)):
        at = _closing(text, at) if text[at] in "([{" else at + (2 if text[at] == "\\" else 1)
    path = text[:at].strip()
    find = (lambda x: evaluate(x, path)) if path else (lambda x: x)
    if at >= len(text):
        return lambda x: find(x) is not None
    op, want = m[0].replace("==", "="), text[m.end() :].strip()
    if want.startswith("~"):
        truth = {"~true": lambda v: v is not None and text_of(v) not in ("", "false", "0"), "~false": lambda v: v is None or text_of(v) in ("", "false", "0"), "~null": lambda v: v is None or v == "null", "~*": lambda v: v is not None}
        holds = truth.get(want, lambda v: False)
        return (lambda x: not holds(find(x))) if op == "!=" else (lambda x: holds(find(x)))
    want = unquote(want) if want.startswith('"') else want
    like = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in want), re.S)

    def holds_for(v: str | None) -> bool:
        if v is None or v == "null" or v[0] in "{[":
            return False
        if v in ("true", "false"):
            a, b = v == "true", {"true": True, "false": False}.get(want)
            return {"=": a is b, "!=": a is not b, "<": b is not None and a < b, "<=": not a or b is True, ">": b is not None and a > b, ">=": a or b is False}.get(op, False)
        if v[0] == '"':
            a, b = unquote(v), want
            if op in ("%", "!%"):
                return (like.fullmatch(a) is not None) == (op == "%")
        else:
            a, b = number_of(v), number_of(want or "0")
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}.get(op, False)

    return lambda x: holds_for(find(x))


def _several(s: str, path: str) -> str | None:
    """Several paths in brackets: an array or an object of what they find."""
    stop = _closing(path, 0)
    out, i = [], 1
    while i < stop - 1:
        end = min(_until(path, i, ","), stop - 1)
        one, name = path[i:end].strip(), None
        if path[0] == "{" and one.startswith('"') and one[(e := _end(one, 0)) : e + 1] == ":":
            name, one = one[:e], one[e + 1 :]
        if (v := evaluate(s, one)) is not None:
            out.append((name or json.dumps(_name(one), ensure_ascii=False), v))
        i = end + 1
    return _then(_object(out) if path[0] == "{" else _array(v for _, v in out), path, stop)


def _name(path: str) -> str:
    """The last key of a path, or "_" where it is no plain one."""
    i = 0
    while (j := _until(path, i, ".|")) < len(path):
        i = j + 1
    last = path[i:]
    return last.replace("\\", "") if last and not re.search(r"[@#!{}\[\]()*?]", last) else "_"


def _modified(s: str, path: str) -> str | None:
    """A modifier, its argument behind a colon, and the rest of the path."""
    stop = _until(path, 1, ".|:")
    name, arg = path[1:stop], ""
    if path[stop : stop + 1] == ":":
        begin, stop = stop + 1, _until(path, stop + 1, ".|")
        arg = path[begin:stop]
    change = _MODIFIERS.get(name)
    return None if change is None else _then(change(s[_skip(s, 0) :].rstrip(_BLANK), arg), path, stop)


def _flatten(s: str, arg: str) -> str:
    if _kind(s) != "[":
        return s
    deep = evaluate(arg, "deep") == "true" if arg else False
    return _array(y for x in _items(s) for y in ((_items(_flatten(x, arg)) if deep else _items(x)) if _kind(x) == "[" else [x]))


def _join(s: str, arg: str) -> str:
    if _kind(s) != "[":
        return s
    members = [m for x in _items(s) if _kind(x) == "{" for m in _members(x)]
    return _object(members if arg and evaluate(arg, "preserve") == "true" else dict(members).items())


def _group(s: str, arg: str) -> str | None:
    if _kind(s) != "{":
        return None
    columns = [(k, _items(v)) for k, v in _members(s) if _kind(v) == "["]
    return _array(_object((k, v[i]) for k, v in columns if i < len(v)) for i in range(max((len(v) for _, v in columns), default=0)))


def _reversed(s: str, arg: str) -> str:
    return _array(reversed(_items(s))) if _kind(s) == "[" else _object(reversed(_members(s))) if _kind(s) == "{" else s


def _ugly(s: str, arg: str) -> str:
    return _array(_ugly(x, arg) for x in _items(s)) if _kind(s) == "[" else _object((k, _ugly(v, arg)) for k, v in _members(s)) if _kind(s) == "{" else s


def _pretty(s: str, arg: str, depth: int = 0) -> str:
    pad, end = "  " * (depth + 1), "\n" if not depth else ""
    rows = [_pretty(x, arg, depth + 1) for x in _items(s)] if _kind(s) == "[" else [f"{k}: {_pretty(v, arg, depth + 1)}" for k, v in _members(s)] if _kind(s) == "{" else None
    if rows is None:
        return s + end
    a, z = "[]" if _kind(s) == "[" else "{}"
    return (a + "\n" + ",\n".join(pad + r for r in rows) + "\n" + "  " * depth + z if rows else a + z) + end


_MODIFIERS: dict[str, Callable[[str, str], str | None]] = {
    "this": lambda s, arg: s, "valid": lambda s, arg: s if valid(_utf8(s)) else None, "reverse": _reversed, "ugly": _ugly, "pretty": _pretty, "flatten": _flatten, "join": _join, "group": _group,
    "keys": lambda s, arg: _array(k for k, _ in _members(s)) if _kind(s) == "{" else _array("null" for _ in _items(s)) if _kind(s) == "[" else "[]",
    "values": lambda s, arg: _array(v for _, v in _members(s)) if _kind(s) == "{" else s if _kind(s) == "[" else _array([s]),
    "tostr": lambda s, arg: json.dumps(s, ensure_ascii=False), "fromstr": lambda s, arg: (lambda t: t if valid(_utf8(t)) else None)(unquote(s) if s.startswith('"') else s),
}


def text_of(raw: str | None) -> str:
    """Strings unquoted, other values as their JSON text; null and nothing as ''."""
    if raw is None or raw == "null":
        return ""
    return unquote(raw) if raw[0] == '"' else raw


_NUMERIC = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")


def number_of(raw: str | None) -> float:
    """true is 1; numbers and numeric strings are themselves; the rest is 0."""
    if raw is None:
        return 0.0
    t = unquote(raw) if raw[0] == '"' else raw
    return 1.0 if raw == "true" else float(t) if _NUMERIC.match(t) else 0.0


def pluck(path: str) -> Kernel:
    """The stage: a missing path is an error."""
    if not path:
        raise InvalidArg("jsonPluck: path must not be empty")
    parts = parse_path(path)

    def run(v: bytes | str) -> str:
        raw = get(as_text(v), parts)
        if raw is None:
            raise Fault(f"path not found: {path}")
        return "null" if raw == "null" else text_of(raw)

    return Kernel("jsonPluck", ANY, "string", run)


def pluck_or_null(path: str) -> Kernel:
    """The batch function: a missing path, or bytes that are no UTF-8, give null."""
    inner = pluck(path).item

    def run(v: bytes | str) -> str | None:
        try:
            return inner(v)
        except Fault:
            return None

    return Kernel("jsonPluck", ANY, "string", run)
