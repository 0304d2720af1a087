"""CSV text to JSON lines, and filtering and projecting of JSON lines; one item is one text."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from ..errors import Fault, InvalidArg
from . import jsonpath
from .kernel import ANY, Kernel, as_bytes, as_text

_ESCAPED = re.compile(r'["\\\x00-\x1f]')
_NAMED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(s: str) -> str:
    """A JSON string literal; characters beyond ASCII stand as they are."""
    return '"' + _ESCAPED.sub(lambda m: _NAMED.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


# -- CSV


def records(s: str, delimiter: str, quote: str):
    """Records of a CSV text: doubled quotes inside quoted fields, any line end, blank lines skipped."""
    i, n = 0, len(s)
    plain = re.compile(f"[^{re.escape(delimiter)}\r\n]*")
    closing = re.compile(f"[^{re.escape(quote)}]*")
    while i < n:
        if s[i] in "\r\n":
            i += 1
            continue
        row: list[str] = []
        while True:
            if i < n and s[i] == quote:
                parts, i = [], i + 1
                while True:
                    m = closing.match(s, i)
                    parts.append(m[0])
                    i = m.end()
                    if s[i : i + 2] == quote * 2:
                        parts.append(quote)
                        i += 2
                        continue
                    i += 1
                    break
                m = plain.match(s, min(i, n))  # what follows the closing quote is taken as it is
                parts.append(m[0])
                i = max(i, m.end()) if i <= n else n
                row.append("".join(parts))
            else:
                m = plain.match(s, i)
                row.append(m[0])
                i = m.end()
            if i < n and s[i] == delimiter:
                i += 1
                continue
            break
        yield row
        if i < n and s[i] == "\r":
            i += 1
        if i < n and s[i] == "\n":
            i += 1


def _single(s: str, what: str) -> str:
    if len(s) != 1 or not s.isascii():
        raise InvalidArg(f'csvToNdjson: {what} must be a single ASCII character, got "{s}"')
    return s


def csv_to_ndjson(delimiter: str | None = None, quote: str | None = None, has_header: bool | None = None, select: Sequence[str] | None = None) -> Kernel:
    delimiter = _single("," if delimiter is None else delimiter, "delimiter")
    quote = _single('"' if quote is None else quote, "quote")
    if select is not None and not len(select):
        raise InvalidArg("csvToNdjson: select must not be empty")
    with_header = True if has_header is None else has_header

    def run(v: bytes | str) -> str:
        text = as_text(v)
        text = text[1:] if text.startswith("﻿") else text
        rows, out, picked = records(text, delimiter, quote), [], None
        header = next(rows, []) if with_header else []
        width = len(header) or None

        def pick() -> list[int]:
            for name in select:
                if name not in header:
                    raise Fault(f"unknown column in select: '{name}'")
            return [header.index(name) for name in select]

        if header and select is not None:
            picked = pick()
        for number, row in enumerate(rows, 1 + with_header):
            if width is not None and len(row) != width:
                raise Fault(f"record {number}: found {len(row)} fields, but the first has {width} fields")
            if width is None:
                width = len(row)
                header = [f"col{i}" for i in range(width)]
                picked = pick() if select is not None else None
            at = range(len(row)) if picked is None else picked
            out.append("{" + ",".join(f"{quoted(header[i])}:{quoted(row[i])}" for i in at) + "}")
        return "\n".join(out)

    return Kernel("csvToNdjson", ANY, "string", run)


# -- JSON lines

_OPS = ("eq", "ne", "gt", "lt", "exists")


def _number_text(n: float) -> str:
    """Shortest text without an exponent, and without a fraction for whole numbers."""
    if isinstance(n, float) and (math.isnan(n) or math.isinf(n)):
        return "NaN" if n != n else "inf" if n > 0 else "-inf"
    if n == int(n):
        return "-0" if n == 0 and math.copysign(1, n) < 0 else str(int(n))
    from decimal import Decimal

    return format(Decimal(repr(float(n))), "f")


def _filter(i: int, f: dict):
    where = f"ndjsonTransform: filter[{i}]"
    op, path, value = f.get("op"), f.get("path", ""), f.get("value")
    if op not in _OPS:
        raise InvalidArg(f"{where}: unknown op '{op}' (expected {'|'.join(_OPS)})")
    if not path:
        raise InvalidArg(f"{where}: path must not be empty")
    parts = jsonpath.parse_path(path)
    if op == "exists":
        return lambda line: jsonpath.get(line, parts) is not None
    if value is None:
        raise InvalidArg(f"{where}: op '{op}' requires a value")
    if op in ("eq", "ne"):
        text = value if isinstance(value, str) else _number_text(value)
        return lambda line: (jsonpath.text_of(jsonpath.get(line, parts)) == text) == (op == "eq")
    try:
        number = float(value)
        if isinstance(value, str) and value != value.strip():
            raise ValueError
    except ValueError:
        raise InvalidArg(f"{where}: op '{op}' requires a numeric value, got '{value}'") from None

    def compare(line: str) -> bool:
        raw = jsonpath.get(line, parts)
        return raw is not None and (jsonpath.number_of(raw) > number if op == "gt" else jsonpath.number_of(raw) < number)

    return compare


def ndjson_transform(filter: Sequence[dict] | None = None, project: Sequence[str] | None = None) -> Kernel:  # noqa: A002
    """Lines that pass every filter, whole or rebuilt from the projected paths (missing ones as null)."""
    if not filter and not project:
        raise InvalidArg("ndjsonTransform: config must set filter and/or project")
    filters = [_filter(i, f) for i, f in enumerate(filter or ())]
    fields = []
    for i, path in enumerate(project or ()):
        where = f"ndjsonTransform: project[{i}]"
        if not path:
            raise InvalidArg(f"{where}: path must not be empty")
        fields.append((quoted(path.rpartition(".")[2]), jsonpath.parse_path(path)))

    def run(v: bytes | str) -> str:
        out = []
        for number, line in enumerate(as_text(v).split("\n"), 1):
            line = line[:-1] if line.endswith("\r") else line
            if not line.strip():
                continue
            if not jsonpath.valid(as_bytes(line)):
                raise Fault(f"line {number}: invalid JSON")
            if all(f(line) for f in filters):
                out.append("{" + ",".join(f"{key}:{jsonpath.get(line, parts) or 'null'}" for key, parts in fields) + "}" if fields else line)
        return "\n".join(out)

    return Kernel("ndjsonTransform", ANY, "string", run)
