"""Strings, pairs and sorts."""

import difflib
import math
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import InvalidArg, batch, levenshtein_each
from millrace.functions import KERNELS, pairs


def test_case_and_trim_are_those_of_unicode(spark):
    words = ["straße", "İstanbul", "ὈΔΥΣΣΕΎΣ", "   x\t\n", "", "ŉ"]
    assert batch("uppercase", words, spark=spark) == [w.upper() for w in words]
    assert batch("lowercase", words, spark=spark) == [w.lower() for w in words]
    assert batch("trim", words, spark=spark)[3] == "x"


def test_trim_takes_every_white_space_and_nothing_else(spark):
    white = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace() and not 0x1C <= c <= 0x1F]
    assert batch("trim", ["".join(white) + "a" + "".join(white), "\x1ca", "​a"], spark=spark) == ["a", "\x1ca", "​a"]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms(spark, form):
    words = ["é", "é", "ﬁ", "Å", "ḍ̇"]
    assert batch("normalize", words, form, spark=spark) == [unicodedata.normalize(form, w) for w in words]


def test_unknown_form():
    with pytest.raises(InvalidArg, match="NFC|NFD|NFKC|NFKD"):
        KERNELS["normalize"]("nfc")


def test_byte_length_of_both_kinds(spark):
    assert batch("byteLen", ["é", "", "🚀", b"\xff\xff"], spark=spark) == [2, 0, 4, 2]


def test_levenshtein_counts_code_points(spark):
    a, b = ["kitten", "flaw", "", "héllo", "same"], ["sitting", "lawn", "abc", "hello", "same"]
    assert batch("levenshtein", a, b, spark=spark) == [3, 2, 3, 1, 0]
    assert [f.result(60) for f in levenshtein_each(a, b, spark=spark)] == [3, 2, 3, 1, 0]
    with pytest.raises(InvalidArg, match="equal length"):
        batch("levenshtein", ["a"], [], spark=spark)


@settings(max_examples=100, deadline=None)
@given(st.text("abcé🚀", max_size=12), st.text("abcé🚀", max_size=12))
def test_distances_agree_with_plain_recursion(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def plain(i, j):
        if not i or not j:
            return i + j
        return min(plain(i - 1, j) + 1, plain(i, j - 1) + 1, plain(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    assert pairs.distance(a, b) == plain(len(a), len(b))
    assert pairs.damerau(a, b) <= pairs.distance(a, b)
    for m in pairs.METRICS:
        s = pairs.similarity(m).item
        assert 0 <= s(a, b) <= 1 and math.isclose(s(a, b), s(b, a)) and s(a, a) == 1


@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [("jaroWinkler", "MARTHA", "MARHTA", 0.961111111), ("jaro", "MARTHA", "MARHTA", 0.944444444), ("jaro", "abc", "xyz", 0), ("sorensenDice", "night", "nacht", 0.25), ("normalizedLevenshtein", "kitten", "sitting", 4 / 7), ("normalizedDamerau", "ca", "ac", 0.5), ("normalizedDamerau", "ca", "abc", 1 / 3), ("normalizedLevenshtein", "", "", 1)],
)
def test_similarities(spark, metric, a, b, want):
    assert batch("similarity", [a], [b], metric, spark=spark)[0] == pytest.approx(want, abs=1e-8)


def test_unknown_metric():
    with pytest.raises(InvalidArg, match="unknown metric 'cosine'"):
        KERNELS["similarity"]("cosine")


def apply_hunks(a: str, patch: str) -> str:
    """The new text, from the old one and the hunks."""
    old, out, at = pairs._lines(a), [], 0
    lines = patch.split("\n")[:-1]
    for k, line in enumerate(lines):
        if line.startswith("@@"):
            start, _, size = line.split()[1][1:].partition(",")
            begin = int(start) - (size != "0")
            out += old[at:begin]
            at = begin
        elif line.startswith("\\"):
            continue
        else:
            text = line[1:] + ("" if k + 1 < len(lines) and lines[k + 1].startswith("\\") else "\n")
            if line[0] != "+":
                assert old[at] == text
                at += 1
            if line[0] != "-":
                out.append(text)
    return "".join(out + old[at:])


@settings(max_examples=150, deadline=None)
@given(st.text("ab\n", max_size=30), st.text("ab\n", max_size=30), st.integers(0, 3))
def test_diffs_apply_and_are_shortest(a, b, context):
    patch = pairs.unified(a, b, context)
    assert apply_hunks(a, patch) == b
    x, y = pairs._lines(a), pairs._lines(b)
    common = sum(n for _, _, n in pairs._snake_edits(x, y))
    assert common >= sum(m.size for m in difflib.SequenceMatcher(None, x, y, False).get_matching_blocks())


def test_hunks(spark):
    a = "one\ntwo\nthree\nfour\nfive\n"
    b = a.replace("three", "3")
    assert batch("diff", [a, a, "x", ""], [b, a, "y", "new\n"], 1, spark=spark) == [
        "@@ -2,3 +2,3 @@\n two\n-three\n+3\n four\n",
        "",
        "@@ -1 +1 @@\n-x\n\\ No newline at end of file\n+y\n\\ No newline at end of file\n",
        "@@ -0,0 +1 @@\n+new\n",
    ]
    for bad in (-1, 101):
        with pytest.raises(InvalidArg, match="context must be 0-100"):
            KERNELS["diff"](bad)


def test_numbers_in_total_order(spark):
    values = [3.5, float("nan"), -0.0, 0.0, float("inf"), -float("inf"), -2.0, 1e-310, -np.nan]
    got = batch("sortNumbers", values, spark=spark)
    assert [math.copysign(1, v) for v in got if v == 0] == [-1, 1]
    numbers = [v for v in got if v == v]
    assert numbers == sorted(numbers) and math.isnan(got[-1])


def test_strings_in_scalar_order(spark):
    words = ["b", "｡", "\U00010000", "Z", "ä", "a", ""]
    assert batch("sortStrings", words, spark=spark) == sorted(words)


def plain_damerau(a, b):
    """The recurrence over a whole table, each transposition from the last row and column that match."""
    d = {(i, j): max(i, j) if i >= 0 and j >= 0 else len(a) + len(b) for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            k = max((k for k in range(1, i) if a[k - 1] == b[j - 1]), default=0)
            m = max((m for m in range(1, j) if b[m - 1] == a[i - 1]), default=0)
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[k - 1, m - 1] + i - k + j - m - 1)
    return d[len(a), len(b)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcé🚀\0", max_size=9), st.text("abcé🚀\0", max_size=9)), max_size=12))
def test_transpositions_side_by_side(some):
    want = [plain_damerau(a, b) for a, b in some]
    a, b = [p[0] for p in some], [p[1] for p in some]
    assert [pairs.damerau(x, y) for x, y in some] == want and pairs.damerau_many(a, b) == want
    full = [i for i, p in enumerate(some) if all(p)]
    if full:
        assert pairs._side_by_side([a[i] for i in full], [b[i] for i in full]) == [want[i] for i in full]
    assert pairs.similarity("normalizedDamerau").batch(a, b) == [pairs.similarity("normalizedDamerau").item(x, y) for x, y in some]


def test_transpositions_of_many_and_of_long_texts():
    """Ten thousand pairs of names, and two long texts, in little time and memory."""
    import random
    import time
    import tracemalloc

    r = random.Random(8)
    names = [" ".join(r.choice(["large", "ring", "hot", "bolt", "steel", "washer", "small"]) for _ in range(4)) for _ in range(10_001)]
    start = time.perf_counter()
    got = pairs.damerau_many(names[:-1], names[1:])
    assert time.perf_counter() - start < 3
    assert got[:50] == [plain_damerau(a, b) for a, b in zip(names[:50], names[1:51])]
    tracemalloc.start()
    assert pairs.damerau("ab" * 300, "ba" * 300) == 2
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
