"""DuckDB expressions for what SQL has no function for: checksums, hashes, Unicode forms and matches, spelt out from their definitions.

They share no code with the functions that they are held against.
"""

from __future__ import annotations

import unicodedata


def crc(text: str, polynomial: int) -> str:
    """CRC of 32 bits, reflected, by a table of 256 states: lower-case hex."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (polynomial if n & 1 else 0)
        table.append(n)
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = f"lambda c, b: xor(c >> 8, list_extract({table}::BIGINT[], CAST(xor(c, b) & 255 AS INTEGER) + 1))"
    return f"lower(lpad(hex(xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)), 8, '0'))"


# -- XXH64 with seed 0, in integers of 128 bits that are cut back to 64

_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _n(value: int) -> str:
    return f"{value % (1 << 64)}::UHUGEINT"


_WRAP = f"{1 << 64}::UHUGEINT"
_P1, _P2, _P3, _P4, _P5 = map(_n, _P)


def _mul(a: str, b: str) -> str:
    return f"(({a}) * ({b}) % {_WRAP})"


def _add(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_WRAP})"


def _rotl(a: str, r: int) -> str:
    """Turned left by r bits; a is named once, as it may be long."""
    return f"list_transform([{a}], lambda q: (q % {_n(1 << (64 - r))}) * {_n(1 << r)} + q // {_n(1 << (64 - r))})[1]"


def _shifted(a: str, r: int) -> str:
    return f"xor({a}, {a} // {_n(1 << r)})"


def _round(acc: str, word: str) -> str:
    return _mul(_rotl(_add(acc, _mul(word, _P2)), 31), _P1)


def _little(n: int) -> str:
    return "'0x' || " + " || ".join(f"x[{i}:{i + 1}]" for i in range(2 * n - 1, 0, -2))


def xxh64(table: str, key: str, text: str) -> str:
    """A whole statement (key, value)."""
    seeds = (_P[0] + _P[1], _P[1], 0, -_P[0])
    lanes = ", ".join(f"list_reduce(list_prepend({_n(s)}, list_select(w, range({k + 1}, 4 * (n // 32) + 1, 4))), lambda a, x: {_round('a', 'x')}) AS v{k + 1}" for k, s in enumerate(seeds))
    start = _add(_add(_rotl("v1", 1), _rotl("v2", 7)), _add(_rotl("v3", 12), _rotl("v4", 18)))
    merge = lambda h, v: _add(_mul(f"xor({h}, {_round(_n(0), v)})", _P1), _P4)
    eight = _add(_mul(_rotl(f"xor(a, {_round(_n(0), 'x')})", 27), _P1), _P4)
    four = _add(_mul(_rotl(f"xor(a, {_mul('x', _P1)})", 23), _P2), _P3)
    one = _mul(_rotl(f"xor(a, {_mul('x', _P5)})", 11), _P1)
    return f"""
WITH t AS (SELECT {key}, hex(encode({text})) AS h, CAST(strlen({text}) AS BIGINT) AS n FROM {table}),
p AS (SELECT {key}, n, list_transform(regexp_extract_all(h, '.{{16}}'), lambda x: CAST({_little(8)} AS UBIGINT)::UHUGEINT) AS w,
  list_transform(regexp_extract_all(h[(n // 8) * 16 + 1:(n // 8) * 16 + (n % 8 // 4) * 8], '.{{8}}'), lambda x: CAST({_little(4)} AS UBIGINT)::UHUGEINT) AS w4,
  list_transform(regexp_extract_all(h[(n // 4) * 8 + 1:], '..'), lambda x: CAST('0x' || x AS UBIGINT)::UHUGEINT) AS b FROM t),
l AS (SELECT *, {lanes} FROM p), m0 AS (SELECT *, {start} AS a0 FROM l), m1 AS (SELECT *, {merge("a0", "v1")} AS a1 FROM m0),
m2 AS (SELECT *, {merge("a1", "v2")} AS a2 FROM m1), m3 AS (SELECT *, {merge("a2", "v3")} AS a3 FROM m2), m4 AS (SELECT *, {merge("a3", "v4")} AS a4 FROM m3),
s AS (SELECT {key}, w, w4, b, n, {_add(f"CASE WHEN n >= 32 THEN a4 ELSE {_P5} END", "n::UHUGEINT")} AS h0 FROM m4),
r8 AS (SELECT *, list_reduce(list_prepend(h0, w[4 * (n // 32) + 1:]), lambda a, x: {eight}) AS h1 FROM s),
r4 AS (SELECT *, list_reduce(list_prepend(h1, w4), lambda a, x: {four}) AS h2 FROM r8),
r1 AS (SELECT *, list_reduce(list_prepend(h2, b), lambda a, x: {one}) AS h3 FROM r4),
f1 AS (SELECT {key}, {_mul(_shifted("h3", 33), _P2)} AS h FROM r1), f2 AS (SELECT {key}, {_mul(_shifted("h", 29), _P3)} AS h FROM f1)
SELECT {key}, lower(lpad(hex({_shifted("h", 32)}), 16, '0')) AS value FROM f2"""


# -- text


def decomposed(text: str, compatible: bool = False) -> str:
    """Latin letters, and with ``compatible`` ligatures, fractions and the like, replaced by their decompositions."""
    ranges = [(0xC0, 0x250), (0x1E00, 0x1F00)] + ([(0xA0, 0xC0), (0x2000, 0x2050), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07)] if compatible else [])
    form = "NFKD" if compatible else "NFD"
    out = f"nfc_normalize({text})"
    for a, z in ranges:
        for c in map(chr, range(a, z)):
            if (d := unicodedata.normalize(form, c)) != c:
                out = f"replace({out}, '{c}', '{d}')"
    return out


def matches(text: str, words: list[str], any_case: bool = False) -> str:
    """JSON text of (index of the word, first byte, last byte) of each match, the longest at the leftmost place."""
    pattern = ("(?i)" if any_case else "") + "|".join(sorted(words, key=len, reverse=True))
    low = "lower(m[i])" if any_case else "m[i]"
    upto = "CAST(coalesce(list_sum(list_transform(g[1:i], lambda y: strlen(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: strlen(y))), 0) AS BIGINT)"
    one = f"""'{{"p":' || (list_position({words}, {low}) - 1) || ',"s":' || {upto} || ',"e":' || ({upto} + strlen(m[i])) || '}}'"""
    inner = f"(SELECT '[' || array_to_string(list_transform(range(1, len(m) + 1), lambda i: {one}), ',') || ']' FROM (SELECT regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g))"
    return inner


def dice(a: str, b: str) -> str:
    """Sorensen-Dice coefficient of the bigrams of two texts, blanks left out."""
    bare = lambda s: f"replace({s}, ' ', '')"
    grams = lambda s: f"list_transform(range(1, length({bare(s)})), lambda i: substr({bare(s)}, i, 2))"
    both = "list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda v: v = g)), len(list_filter(y, lambda v: v = g)))))"
    return f"(SELECT CASE WHEN p = q THEN 1.0::DOUBLE WHEN length(p) < 2 OR length(q) < 2 THEN 0.0 ELSE CAST(2 * coalesce({both}, 0) AS DOUBLE) / (length(p) + length(q) - 2) END FROM (SELECT {bare(a)} AS p, {bare(b)} AS q, {grams(a)} AS x, {grams(b)} AS y))"


def values(rows: list[tuple], *names: str) -> str:
    """A statement of fixed rows."""
    form = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    kinds = [next(("INTEGER" if isinstance(r[i], int) else "VARCHAR" for r in rows if r[i] is not None), "VARCHAR") for i in range(len(names))]
    columns = ", ".join(f"CAST(c{i} AS {k}) AS {n}" for i, (k, n) in enumerate(zip(kinds, names)))
    return f"SELECT {columns} FROM (VALUES {', '.join('(' + ', '.join(map(form, r)) + ')' for r in rows)}) t({', '.join(f'c{i}' for i in range(len(names)))})"
