"""Comparison of two texts: distances, similarities in [0, 1], and unified diffs."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ..errors import InvalidArg
from .kernel import STR, Kernel


def distance(a: str, b: str) -> int:
    """Edit distance over code points."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def levenshtein() -> Kernel:
    return Kernel("levenshtein", STR, "int", distance, lambda a, b: (F.levenshtein(a, b), None), arity=2)


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """A common beginning of up to four characters counts where the Jaro similarity is above 0.7."""
    sim = jaro(a, b)
    if sim <= 0.7:
        return sim
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return sim + 0.1 * same * (1 - sim)


def sorensen_dice(a: str, b: str) -> float:
    """Shared bigrams, counted as often as they come, white space left out."""
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * (x & y).total() / (len(a) + len(b) - 2)


def _bare(a: str, b: str) -> tuple[str, str]:
    """The texts without their common beginning and end, which cost nothing."""
    if a == b:
        return "", ""
    n, i, j = min(len(a), len(b)), 0, 0
    while i < n and a[i] == b[i]:
        i += 1
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j]


def damerau(a: str, b: str) -> int:
    """Edit distance with transpositions, where a substring may be edited more than once.

    Of a shortest script's transpositions one side is adjacent, so two rows, and what each column and the row keep of their
    last match, are enough. Lists begin with column -1.
    """
    a, b = _bare(a, b)
    far, seen = len(a) + len(b) + 1, {}
    row, above, first = [far, *range(len(b) + 1)], [far] * (len(b) + 2), [far] * (len(b) + 2)
    for i, x in enumerate(a, 1):
        row, above = above, row  # row is written over what was two rows up
        last, kept, corner = -1, far, row[1]
        row[1] = i
        for j, y in enumerate(b, 1):
            best = min(above[j] + (x != y), row[j] + 1, above[j + 1] + 1)
            if x == y:
                last, first[j], kept = j, above[j - 1], corner
            else:
                k = seen.get(y, -1)
                if j - last == 1:
                    best = min(best, first[j] + i - k)
                elif i - k == 1:
                    best = min(best, kept + j - last)
            corner, row[j + 1] = row[j + 1], best
        seen[x] = i
    return row[len(b) + 1]


#: Pairs compared side by side at most, and cells of a row of all of them.
_SIDE_BY_SIDE, _CELLS = 4096, 1 << 20
#: Nanoseconds of a cell: by itself, and side by side, of all pairs together and of each.
_ALONE_NS, _ALL_NS, _EACH_NS = 400, 25_000, 12


def damerau_many(a: list[str], b: list[str]) -> list[int]:
    """:func:`damerau` of each pair; pairs of about the same lengths cell by cell side by side, where that is faster."""
    pairs = [_bare(x, y) for x, y in zip(a, b)]
    out = [max(len(x), len(y)) for x, y in pairs]  # where one is empty
    order = sorted((i for i, (x, y) in enumerate(pairs) if x and y), key=lambda i: (max(map(len, pairs[i])), len(pairs[i][0])))
    while order:
        n = min(len(order), _SIDE_BY_SIDE)
        while n > 1 and n * len(max(pairs[order[n - 1]], key=len)) > _CELLS:
            n //= 2
        some, order = order[:n], order[n:]
        x, y = [pairs[i][0] for i in some], [pairs[i][1] for i in some]
        padded = max(map(len, x)) * max(map(len, y))
        if sum(len(p) * len(q) for p, q in zip(x, y)) * _ALONE_NS <= padded * (_ALL_NS + n * _EACH_NS):
            found = map(damerau, x, y)
        else:
            found = _side_by_side(x, y)
        for i, d in zip(some, found):
            out[i] = d
    return out


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (place, text), and lengths."""
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return np.ascontiguousarray(flat.reshape(len(texts), width).T), sizes


def _side_by_side(a: list[str], b: list[str]) -> list[int]:
    """The recurrence of :func:`damerau` with a vector over the pairs in each cell; cells beyond a text touch none within."""
    (x, rows), (y, columns) = _letters(a), _letters(b)
    width, n = y.shape
    far = len(x) + width + 1
    row = np.repeat(np.array([far, *range(width + 1)], np.int32)[:, None], n, 1)
    above, first, seen = np.full_like(row, far), np.full_like(row, far), np.full_like(row, -1)
    out = np.zeros(n, np.int32)
    for i in range(1, len(x) + 1):
        row, above = above, row
        last, kept, corner = np.full(n, -1, np.int32), np.full(n, far, np.int32), row[1].copy()
        row[1] = i
        for j in range(1, width + 1):
            same = x[i - 1] == y[j - 1]
            best = above[j] + ~same
            best = np.minimum(best, np.minimum(row[j], above[j + 1]) + 1)
            np.minimum(best, first[j] + (i - seen[j]), out=best, where=last == j - 1)
            np.minimum(best, kept + (j - last), out=best, where=seen[j] == i - 1)
            np.copyto(first[j], above[j - 1], where=same)
            np.copyto(kept, corner, where=same)
            last[same] = j
            seen[j][same] = i
            corner = row[j + 1].copy()
            row[j + 1] = best
        done = np.flatnonzero(rows == i)
        out[done] = row[columns[done] + 1, done]
    return out.tolist()


def _normal(measure):
    return lambda a, b: 1.0 - measure(a, b) / max(len(a), len(b)) if a or b else 1.0


def _normal_many(a: list[str], b: list[str]) -> list[float]:
    return [1.0 - d / max(len(x), len(y)) if x or y else 1.0 for d, x, y in zip(damerau_many(a, b), a, b)]


_MEASURES = {
    "jaro": jaro,
    "jaroWinkler": jaro_winkler,
    "sorensenDice": sorensen_dice,
    "normalizedLevenshtein": _normal(distance),
    "normalizedDamerau": _normal(damerau),
}
METRICS = tuple(_MEASURES)


def similarity(metric: str) -> Kernel:
    if metric not in _MEASURES:
        raise InvalidArg(f"unknown metric '{metric}' (expected {'|'.join(METRICS)})")
    native = None
    if metric == "normalizedLevenshtein":
        native = lambda a, b: (F.coalesce(1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.char_length(a), F.char_length(b)), F.lit(0)), F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0))), None)
    return Kernel("similarity", STR, "double", _MEASURES[metric], native, arity=2, batch=_normal_many if metric == "normalizedDamerau" else None)


# -- unified diff


def _snake_edits(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Equal runs (start in a, start in b, length) of a shortest edit script (the greedy O(ND) search)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x0, y0, n, m = head, head, len(a) - head - tail, len(b) - head - tail
    v, trace = {1: 0}, []
    found = False
    for d in range(n + m + 1):
        trace.append(dict(v))
        for k in range(-d, d + 1, 2):
            x = v[k + 1] if k == -d or (k != d and v[k - 1] < v[k + 1]) else v[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x0 + x] == b[y0 + y]:
                x, y = x + 1, y + 1
            v[k] = x
            if x >= n and y >= m:
                found = True
                break
        if found:
            break
    same, x, y = [], n, m
    for d in range(len(trace) - 1, -1, -1):
        v, k = trace[d], x - y
        pk = k + 1 if k == -d or (k != d and v[k - 1] < v[k + 1]) else k - 1
        px = v[pk] if d else 0
        py = px - pk if d else 0
        while x > px and y > py and x > 0 and y > 0 and a[x0 + x - 1] == b[y0 + y - 1]:
            x, y = x - 1, y - 1
            same.append((x0 + x, y0 + y))
        if d:
            x, y = px, py
    runs: list[list[int]] = [[0, 0, head]] if head else []
    for i, j in reversed(same):
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    if tail:
        i, j = len(a) - tail, len(b) - tail
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += tail
        else:
            runs.append([i, j, tail])
    return [tuple(r) for r in runs]


def _range(start: int, size: int) -> str:
    first = start + 1 if size else start
    return f"{first}" if size == 1 else f"{first},{size}"


def unified(a: str, b: str, context: int = 3) -> str:
    """Hunks without a file header; '' for equal texts."""
    if a == b:
        return ""
    x, y = _lines(a), _lines(b)
    changes, i, j = [], 0, 0
    for p, q, n in [*_snake_edits(x, y), (len(x), len(y), 0)]:
        if p > i or q > j:
            changes.append((i, p, j, q))
        i, j = p + n, q + n
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []

    def line(mark: str, text: str) -> None:
        out.append(mark + text if text.endswith("\n") else f"{mark}{text}\n\\ No newline at end of file\n")

    for g in groups:
        a0, b0 = max(0, g[0][0] - context), max(0, g[0][2] - context)
        a1, b1 = min(len(x), g[-1][1] + context), min(len(y), g[-1][3] + context)
        out.append(f"@@ -{_range(a0, a1 - a0)} +{_range(b0, b1 - b0)} @@\n")
        at = a0
        for i1, i2, j1, j2 in g:
            for t in x[at:i1]:
                line(" ", t)
            for t in x[i1:i2]:
                line("-", t)
            for t in y[j1:j2]:
                line("+", t)
            at = i2
        for t in x[at:a1]:
            line(" ", t)
    return "".join(out)


def _lines(s: str) -> list[str]:
    """Lines with their ends; only line feeds end a line."""
    parts = s.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def diff(context: int | None = None) -> Kernel:
    context = 3 if context is None else context
    if isinstance(context, bool) or not isinstance(context, int) or not 0 <= context <= 100:
        raise InvalidArg(f"context must be 0-100, got {context}")
    return Kernel("diff", STR, "string", lambda a, b: unified(a, b, context), arity=2)
