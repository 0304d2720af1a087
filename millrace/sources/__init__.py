"""Where items come from: Python lists, DataFrames, explicit files and glob patterns."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArg
from ..functions.kernel import BYTES, STR

_META = re.compile(r"[*?\[{]")


@dataclass(frozen=True)
class Files:
    """Paths, glob patterns that are expanded when a terminal runs, or a frame of (item_index, path)."""

    paths: tuple[str, ...] = ()
    globs: tuple[str, ...] | None = None
    frame: DataFrame | None = None

    def resolve(self) -> list[str]:
        return list(self.paths) if self.globs is None else expand_glob(self.globs)


def files(source: Sequence[str] | dict | DataFrame) -> Files:
    """A file source: a list of paths, ``{"glob": pattern or list of patterns}``, or a DataFrame of (item_index, path) for more than the driver can list."""
    if isinstance(source, DataFrame):
        if dict(source.dtypes).get("path") != "string" or dict(source.dtypes).get("item_index") != "bigint":
            raise InvalidArg("files: a DataFrame needs item_index bigint and path string")
        return Files(frame=source)
    if isinstance(source, dict):
        globs = source.get("glob")
        globs = [globs] if isinstance(globs, str) else globs
        if not isinstance(globs, (list, tuple)) or not all(isinstance(g, str) for g in globs):
            raise InvalidArg("files: glob must be a string or a list of strings")
        return Files(globs=tuple(globs))
    if isinstance(source, str) or not isinstance(source, (list, tuple)) or not all(isinstance(p, str) for p in source):
        raise InvalidArg("files: expected a list of paths or {glob}")
    return Files(paths=tuple(source))


def _translate(pattern: str) -> re.Pattern:
    """Regular expression of a glob: * and ? stay within a component, ** recurses, [...] and {a,b} as usual."""

    def bad(why: str) -> InvalidArg:
        return InvalidArg(f"expandGlob: invalid pattern '{pattern}': {why}")

    out, i, depth, n = "", 0, 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 2] == "**" and (i == 0 or pattern[i - 1] == "/") and (i + 2 == n or pattern[i + 2] == "/"):
                if i + 2 == n:
                    out += ".*" if i == 0 else ".+"
                    i += 2
                else:
                    out += "(?:.*/)?"
                    i += 3
                continue
            while pattern[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] in ("!", "^")
            j += negated
            k = pattern.find("]", j + 1)
            if k < 0:
                raise bad("unclosed character class")
            body = pattern[j:k].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("~", "\\~").replace("|", "\\|").replace("^", "\\^")
            for m in re.finditer(r"(.)-(.)", pattern[j:k]):
                if m[1] > m[2]:
                    raise bad(f"invalid range '{m[0]}'")
            out += f"(?!/)[{'^' if negated else ''}{body}]"
            i = k
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "}":
            raise bad("unopened alternate group")
        elif c == "\\":
            if i + 1 == n:
                raise bad("dangling '\\'")
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise bad("unclosed alternate group")
    return re.compile(out + r"\Z", re.S)


def _base(pattern: str) -> str:
    """Leading components without glob characters: where the walk begins."""
    parts = []
    for part in pattern.split("/"):
        if _META.search(part):
            break
        parts.append(part)
    return "/".join(parts) or ("/" if pattern.startswith("/") else "")


def expand_glob(patterns: Iterable[str]) -> list[str]:
    """Sorted, distinct files that match; a pattern without glob characters is a path and stays, there or not.

    Files alone match, symbolic links to files too; linked folders are not entered and unreadable ones are skipped.
    """
    patterns = list(patterns)
    out = {p for p in patterns if not _META.search(p)}
    globs = [(p, _translate(p)) for p in patterns if _META.search(p)]
    for base in sorted({_base(p) for p, _ in globs}):
        tests = [t for _, t in globs]
        todo = [(base or ".", base)]
        while todo:
            folder, shown = todo.pop()
            try:
                entries = list(os.scandir(folder))
            except OSError:
                continue
            for e in entries:
                name = e.name if not shown else f"/{e.name}" if shown == "/" else f"{shown}/{e.name}"
                if e.is_dir(follow_symlinks=False):
                    todo.append((e.path, name))
                elif e.is_file() and any(t.match(name) for t in tests):
                    out.add(name)
    return sorted(out, key=lambda s: s.encode("utf-8", "surrogateescape"))


def item_kind(items: Sequence[bytes | str]) -> str | None:
    """Bytes or Str, as the first item; None for no items. Every item must be of that kind."""
    kind = None
    for i, v in enumerate(items):
        own = BYTES if isinstance(v, (bytes, bytearray, memoryview)) else STR if isinstance(v, str) else None
        if own is None:
            raise InvalidArg(f"item {i}: expected bytes or a string")
        if kind is not None and own != kind:
            raise InvalidArg(f"item {i}: mixed items: expected {kind} like item 0, got {own}")
        kind = kind or own
    return kind


def items_frame(spark: SparkSession, items: Sequence[bytes | str], kind: str) -> DataFrame:
    """(item_index, value) of a list, spread over the cluster."""
    rows = [(i, bytes(v) if kind == BYTES else v) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, f"item_index bigint, value {'binary' if kind == BYTES else 'string'}")
    return df.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism))) if len(rows) > 1 else df


def paths_frame(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(item_index, path) of a list of paths; the files are read where tasks run."""
    df = spark.createDataFrame(list(enumerate(paths)), "item_index bigint, path string")
    return df.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))) if len(paths) > 1 else df


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
