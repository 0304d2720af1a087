"""Many literal patterns at once, leftmost-longest; and regular expressions without lookaround or backreferences."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Fault, InvalidArg
from .kernel import STR, Kernel

# -- literal patterns

_FOLD = {c: c + 32 for c in range(65, 91)}


class Finder:
    """Leftmost-longest, non-overlapping matches; of equal patterns the first counts."""

    def __init__(self, patterns: Sequence[str], fold: bool):
        self.patterns, self.fold, self._built = list(patterns), fold, None

    def __getstate__(self):
        return self.patterns, self.fold

    def __setstate__(self, state):
        (self.patterns, self.fold), self._built = state, None

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern, start, end) in characters."""
        if self._built is None:
            self._built = ahocorasick.Automaton()
            for i, p in reversed(list(enumerate(self.patterns))):
                self._built.add_word(p.translate(_FOLD) if self.fold else p, (i, len(p)))
            self._built.make_automaton()
        longest: dict[int, tuple[int, int]] = {}
        for last, (i, size) in self._built.iter(text.translate(_FOLD) if self.fold else text):
            start = last + 1 - size
            if start not in longest or longest[start][1] < size:
                longest[start] = i, size
        done = 0
        for start in sorted(longest):
            if start >= done:
                i, size = longest[start]
                done = start + size
                yield i, start, done


def _checked(op: str, patterns: Sequence[str]) -> None:
    if isinstance(patterns, str) or not isinstance(patterns, Sequence):
        raise InvalidArg(f"{op}: patterns must be an array")
    if not patterns:
        raise InvalidArg(f"{op}: patterns must not be empty")
    for i, p in enumerate(patterns):
        if not p:
            raise InvalidArg(f"{op}: pattern {i} is empty: every pattern needs a character")


#: Lists up to this long become one native alternation when all matches share a replacement.
NATIVE_PATTERNS = 64


def multi_replace(patterns: Sequence[str], replacements: Sequence[str] | str, case_insensitive: bool | None = None) -> Kernel:
    if not isinstance(replacements, str) and len(replacements) != len(patterns):
        raise InvalidArg(f"multiReplace: replacements length {len(replacements)} != patterns length {len(patterns)}")
    _checked("multiReplace", patterns)
    finder, one = Finder(patterns, bool(case_insensitive)), isinstance(replacements, str)

    def run(s: str) -> str:
        out, last = [], 0
        for i, a, b in finder.matches(s):
            out += (s[last:a], replacements if one else replacements[i])
            last = b
        return "".join(out) + s[last:]

    native = None
    if one and len(patterns) <= NATIVE_PATTERNS and not any("\\E" in p for p in patterns):
        java = ("(?i)" if case_insensitive else "") + "|".join(f"\\Q{p}\\E" for p in sorted(patterns, key=len, reverse=True))
        plain = replacements.replace("\\", "\\\\").replace("$", "\\$")
        native = lambda c: (F.regexp_replace(c, F.lit(java), F.lit(plain)), None)
    return Kernel("multiReplace", STR, "string", run, native)


def multi_find(patterns: Sequence[str], case_insensitive: bool | None = None, limit: int | None = None) -> Kernel:
    """JSON text of pattern index and byte range of each match."""
    if limit is not None and limit < 1:
        raise InvalidArg("multiFind: limit must be >= 1")
    _checked("multiFind", patterns)
    finder = Finder(patterns, bool(case_insensitive))

    def run(s: str) -> str:
        out, at, place = [], 0, 0
        for i, a, b in finder.matches(s):
            if limit is not None and len(out) == limit:
                break
            start = place + len(s[at:a].encode("utf-8", "surrogatepass"))
            place = start + len(s[a:b].encode("utf-8", "surrogatepass"))
            at = b
            out.append(f'{{"p":{i},"s":{start},"e":{place}}}')
        return "[" + ",".join(out) + "]"

    return Kernel("multiFind", STR, "string", run)


# -- regular expressions

#: Constructs that other engines know and this dialect does not.
_FOREIGN = re.compile(r"""\\. | \[(?:\\.|[^\]\\])*\] | (?P<bad>\(\?(?:[=!>|(&R+\-0-9]|<[=!]|P[=>]) | [*+?}]\+)""", re.X | re.S)
_BACKREF = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<|g<|G|K|R|X|Z)")
#: Patterns that mean the same to the JVM's engine: literals, ASCII sets, groups, alternatives and greedy or lazy repeats.
_SAFE = re.compile(r"(?:[A-Za-z0-9 _@%#&=,:;<>/'\"~!-]|\\[.*+?()|\[\]{}^$\\/@-]|\[\^?(?:[A-Za-z0-9_.%+@ ](?:-[A-Za-z0-9])?)+-?\]|\((?!\?)|\(\?:|\)|\||[*+?]\??|\{[0-9]+(?:,[0-9]*)?\}\??)*\Z")


def compiled(pattern: str, where: str = "") -> regex.Pattern:
    """The pattern, in the dialect of linear-time engines: Unicode classes, no lookaround, no backreferences."""
    for m in _FOREIGN.finditer(pattern):
        if m["bad"]:
            raise InvalidArg(f"{where}invalid regex: '{m['bad']}' is not supported in '{pattern}'")
    if _BACKREF.search(pattern):
        raise InvalidArg(f"{where}invalid regex: backreferences are not supported in '{pattern}'")
    try:
        return regex.compile(pattern.replace("\\z", "\\Z"), regex.V0)
    except regex.error as e:
        raise InvalidArg(f"{where}invalid regex: {e}") from None


def java_pattern(pattern: str) -> str | None:
    """The pattern for Spark's native functions, where both engines are sure to agree."""
    return pattern if _SAFE.match(pattern) and "&&" not in pattern and not re.search(r"\{,", pattern) else None


_TEMPLATE = re.compile(r"\$(?:\$|\{([^}]*)\}|([0-9A-Za-z_]+))")


def template(replacement: str, found: regex.Pattern) -> list[str | int]:
    """Texts and group numbers of a replacement: $1, ${1}, $name, ${name}, $$; unknown groups are empty."""
    out: list[str | int] = []
    last = 0
    for m in _TEMPLATE.finditer(replacement):
        out.append(replacement[last : m.start()])
        last = m.end()
        name = m[1] if m[1] is not None else m[2]
        if name is None:
            out.append("$")
        elif name.isascii() and name.isdigit():
            if int(name) <= found.groups:
                out.append(int(name))
        elif name in found.groupindex:
            out.append(found.groupindex[name])
        elif m[1] is not None and not re.match(r"[0-9A-Za-z_]+\Z", name):
            out.append(m[0])
    return [*out, replacement[last:]]


def regex_test(pattern: str) -> Kernel:
    found, java = compiled(pattern), java_pattern(pattern)
    return Kernel("regexTest", STR, "boolean", lambda s: found.search(s) is not None, (lambda c: (c.rlike(java), None)) if java else None)


def regex_count(pattern: str) -> Kernel:
    found, java = compiled(pattern), java_pattern(pattern)
    return Kernel("regexCount", STR, "int", lambda s: sum(1 for _ in found.finditer(s)), (lambda c: (F.regexp_count(c, F.lit(java)), None)) if java else None)


def regex_replace(pattern: str, replacement: str) -> Kernel:
    found, java = compiled(pattern, "regexReplace: "), java_pattern(pattern)
    parts = template(replacement, found)

    def fill(m: regex.Match) -> str:
        return "".join(p if isinstance(p, str) else m.group(p) or "" for p in parts)

    native = None
    if java and "?" not in pattern and "|" not in pattern:  # else a group may take no part, which Java writes as nothing too, but not in all versions
        out = "".join(p.replace("\\", "\\\\").replace("$", "\\$") if isinstance(p, str) else f"${p}" for p in _joined(parts))
        if not re.search(r"\$[0-9]+[0-9]", re.sub(r"\$[0-9]", "$", out, count=0)) and not any(isinstance(a, int) and isinstance(b, str) and b[:1].isdigit() for a, b in zip(parts, parts[1:])):
            native = lambda c: (F.regexp_replace(c, F.lit(java), F.lit(out)), None)
    return Kernel("regexReplace", STR, "string", lambda s: found.sub(fill, s), native)


def _joined(parts: list[str | int]) -> list[str | int]:
    return [p for p in parts if p != ""]


def _group(found: regex.Pattern, group: int | None, where: str = "") -> int:
    group = 0 if group is None else group
    if isinstance(group, bool) or not isinstance(group, int):
        raise InvalidArg(f"{where}group must be an integer, got {group}")
    if not 0 <= group <= found.groups:
        raise InvalidArg(f"{where}group {group} out of range (pattern has {found.groups} capture groups)")
    return group


def regex_extract(pattern: str, group: int | None = None) -> Kernel:
    """The stage: no match, or a group that took no part, is an error."""
    inner = regex_extract_or_null(pattern, group, "regexExtract: ")

    def run(s: str) -> str:
        out = inner.item(s)
        if out is None:
            raise Fault("no match")
        return out

    def native(c: Column) -> tuple[Column, Column]:
        value, _ = inner.native(c)
        return value, F.when(c.isNotNull() & value.isNull(), F.lit("regexExtract: no match"))

    return Kernel("regexExtract", STR, "string", run, native if inner.native else None)


def regex_extract_or_null(pattern: str, group: int | None = None, where: str = "") -> Kernel:
    """The batch function: no match gives null."""
    found, java = compiled(pattern, where), java_pattern(pattern)
    group = _group(found, group, where)

    def run(s: str) -> str | None:
        m = found.search(s)
        return m.group(group) if m else None

    native = (lambda c: (F.when(c.rlike(java), F.regexp_extract(c, java, 0)), None)) if java and group == 0 else None
    return Kernel("regexExtract", STR, "string", run, native)
