"""Literal patterns and regular expressions: native forms against Python forms, and both against plain readings."""

import json

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import InvalidArg, ItemError, batch
from millrace.functions import KERNELS, search


def plain_matches(patterns, text):
    out, at = [], 0
    while at < len(text):
        here = [(len(p), -i) for i, p in enumerate(patterns) if text.startswith(p, at)]
        if here:
            size, i = max(here)
            out.append((-i, at, at + size))
            at += size
        else:
            at += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=4), min_size=1, max_size=5), st.text("abé ", max_size=20))
def test_matches_are_leftmost_longest(patterns, text):
    assert list(search.Finder(patterns, False).matches(text)) == plain_matches(patterns, text)
    found = json.loads(KERNELS["multiFind"](patterns).item(text))
    raw = text.encode()
    assert [raw[m["s"] : m["e"]].decode() for m in found] == [text[a:b] for _, a, b in plain_matches(patterns, text)]


def test_replacing(spark):
    assert batch("multiReplace", ["xhello he", "a$1\\b"], ["he", "xhe", "hello", "$1", "\\b"], "$0\\", spark=spark) == ["$0\\llo $0\\", "a$0\\$0\\"]
    assert batch("multiReplace", ["one two one"], ["one", "two"], ["1", "2"], spark=spark) == ["1 2 1"]
    assert batch("multiReplace", ["Ünd UND und"], ["und"], "&", case_insensitive=True, spark=spark) == ["Ünd & &"]
    assert KERNELS["multiReplace"](["und"], "&", True).item("Ünd UND und") == "Ünd & &"


def test_finding_with_limit(spark):
    assert batch("multiFind", ["écat cat"], ["cat", "é"], limit=2, spark=spark) == ['[{"p":1,"s":0,"e":2},{"p":0,"s":2,"e":5}]']
    assert [m["s"] for m in json.loads(KERNELS["multiFind"](["aa"]).item("aaaaa"))] == [0, 2]


@pytest.mark.parametrize(("op", "args"), [("multiFind", ([],)), ("multiFind", (["a", ""],)), ("multiFind", (["a"], None, 0)), ("multiReplace", (["a", "b"], ["x"])), ("multiReplace", ("ab", "x"))])
def test_pattern_lists_are_checked(op, args):
    with pytest.raises(InvalidArg, match=op):
        KERNELS[op](*args)


PATTERNS = ["[0-9]+", "a(b|c)d", "[a-c]{2,3}", "x?y*z+?", "(?:ab)+", "\\.", "[^a-z]+", "foo|bar|foobar", "a\\+b"]
TEXTS = ["", "a1b22", "abd acd", "abcabcab", "xyz yyz z", "ababab", "a.b.c", "ABC é 🚀 \n", "foobar barfoo", "a+b aab"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_native_forms_agree_with_python_forms(spark, pattern):
    assert search.java_pattern(pattern)
    for op, args in (("regexTest", ()), ("regexCount", ()), ("regexReplace", ("<$0>",)), ("regexExtract", ())):
        k = KERNELS[op](pattern, *args)
        assert batch(op, TEXTS, pattern, *args, spark=spark) == [k.item(t) for t in TEXTS], op


def test_unicode_classes_go_through_python(spark):
    assert search.java_pattern(r"\w+") is None
    assert batch("regexCount", ["mañana déjà 東京", "a_1"], r"\w+", spark=spark) == [3, 1]
    assert batch("regexTest", ["é", "1"], r"^\p{L}$", spark=spark) == [True, False]


@pytest.mark.parametrize(("template", "want"), [("$2/$1", "b/a!"), ("${1}x", "ax!"), ("$1x", "!"), ("$0$0", "abab!"), ("$$1", "$1!"), ("[$&]", "[$&]!"), ("${second}$first", "ba!"), ("$9", "!")])
def test_templates(spark, template, want):
    assert batch("regexReplace", ["ab!"], "(?P<first>a)(?<second>b)", template, spark=spark) == [want]


def test_extraction(spark):
    assert batch("regexExtract", ["a1b2", "none"], "[a-z]([0-9])", 1, spark=spark) == ["1", None]
    assert batch("regexExtract", ["b"], "(a)?b", 1, spark=spark) == [None]
    with pytest.raises(InvalidArg, match="group 2 out of range .pattern has 1 capture groups."):
        KERNELS["regexExtract"]("(a)", 2)


@pytest.mark.parametrize("bad", ["(?=a)b", "(?!a)", "(?<=a)b", "(?<!a)b", "(a)\\1", "a++", "(?>a)", "(", "[a", "(?P=x)"])
def test_foreign_constructs_are_refused(bad):
    with pytest.raises(InvalidArg, match="invalid regex"):
        search.compiled(bad)


@pytest.mark.parametrize("good", ["[(?=]", "\\(\\?=", "(?i)a", "(?:a)", "[+*]+", "a+?", "(?x: a )"])
def test_lookalikes_are_not(good):
    assert isinstance(search.compiled(good), regex.Pattern)


def test_native_alternation_and_automaton_agree(spark):
    """Lists of 64 and of 65 patterns take different ways: the same matches come out, the longest at the leftmost place."""
    import random

    from millrace.functions import search

    r = random.Random(6)
    patterns = sorted({"".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(400)})
    r.shuffle(patterns)
    texts = ["".join(r.choices("abcd ", k=200)) for _ in range(30)] + [""]
    for n in (64, 65):
        kernel = search.multi_replace(patterns[:n], "#")
        assert (kernel.native is not None) == (n <= search.NATIVE_PATTERNS)
        ordered = sorted(patterns[:n], key=len, reverse=True)
        import re

        want = [re.sub("|".join(ordered), "#", t) for t in texts]
        assert [kernel.item(t) for t in texts] == want == batch("multiReplace", texts, patterns[:n], "#", spark=spark)


def test_a_batch_is_worked_on_in_slices(monkeypatch):
    """An Arrow batch may be large: the Python values of a few megabytes of it are held at a time, whatever its rows."""
    import pyarrow as pa

    from millrace.functions import kernel

    sizes = []
    given = kernel.run_items
    monkeypatch.setattr(kernel, "run_items", lambda kernels, *columns: (sizes.append(sum(len(v or "") for v in columns[0])), given(kernels, *columns))[1])
    monkeypatch.setattr(kernel, "_typed", lambda function, arity, returns: type("Udf", (), {"asNondeterministic": lambda self: function, "__call__": lambda self, *a: function(*a)})())
    texts = ["the end " * 20_000, None, "", "x"] * 100 + ["over " * 2_000_000] + ["the"]
    want = [None if t is None else t.replace("the", "#").replace("over", "#") for t in texts]
    replace = KERNELS["multiReplace"](["the", "over"], ["#", "#"])
    out = kernel.settled_udf([replace])(pa.array(texts))
    assert out.field("value").to_pylist() == kernel.strict_udf(replace)(pa.array(texts)).to_pylist() == want and out.field("error").null_count == len(texts)
    assert len(sizes) >= 10 and sorted(sizes)[-3] <= kernel.AT_ONCE and max(sizes) == 10_000_000
    assert list(kernel.slices(pa.array([], pa.string()))) == [] and kernel.strict_udf(replace)(pa.array([], pa.string())).to_pylist() == []
