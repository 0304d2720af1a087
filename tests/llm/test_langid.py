import functools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import CLASHES, crowded, frame

from millrace.llm import langid

WORDS = {
    "aa": ["tolo", "meka", "salu", "tomi", "kela", "lumo", "sata", "mole"],
    "bb": ["grund", "wecht", "strab", "knorz", "drecht", "schun", "borg", "walt"],
    "cc": ["ïxé", "zéix", "éïna", "xizé", "naïx", "ézan", "xanï", "izéa"],
}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def models():
    return langid.LanguageModels({lang: [text(lang, 40, i) for i in range(40)] for lang in WORDS})


def plain_probability(texts, gram, order, alphabet):
    """Interpolated Kneser-Ney from its definition, over dictionaries."""
    padded = [" " * (order - 1) + " " + "".join(c for c in t) for t in texts]
    counts = {order: {}}
    for p in padded:
        for i in range(order - 1, len(p)):
            g = p[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discount = {n: (lambda one, two: one / (one + 2 * two) if one and two else 0.5)(sum(c == 1 for c in cs.values()), sum(c == 2 for c in cs.values())) for n, cs in counts.items()}

    def p(g):
        n, cs, d = len(g), counts[len(g)], discount[len(g)]
        if n == 1:
            total = sum(cs.values())
            return max(cs.get(g, 0) - d, 0) / total + d * len(cs) / total / alphabet
        seen = {k: c for k, c in cs.items() if k[:-1] == g[:-1]}
        if not seen:
            return p(g[1:])
        total = sum(seen.values())
        return max(cs.get(g, 0) - d, 0) / total + d * len(seen) / total * p(g[1:])

    return p(gram)


def plain_model(texts, order, alphabet):
    """The same over texts that are led by a space, as a function of grams that remembers."""
    counts = {order: Counter(g for t in texts for g in plain_grams(t, order))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    once = {n: Counter(c.values()) for n, c in counts.items()}
    discount = {n: c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5 for n, c in once.items()}
    total, fan = {n: Counter() for n in counts}, {n: Counter() for n in counts}
    for n, cs in counts.items():
        for g, c in cs.items():
            total[n][g[:-1]] += c
            fan[n][g[:-1]] += 1
    alphabet = max(alphabet, len(counts[1])) + 1

    @functools.cache
    def p(g):
        n, d = len(g), discount[len(g)]
        if n == 1:
            return max(counts[1][g] - d, 0) / total[1][""] + d * len(counts[1]) / total[1][""] / alphabet
        if not fan[n][g[:-1]]:
            return p(g[1:])
        return (max(counts[n][g] - d, 0) + d * fan[n][g[:-1]] * p(g[1:])) / total[n][g[:-1]]

    return p


def plain_symbols(t):
    return re.sub(" +", " ", " " + "".join(c.lower() if c.isalpha() else " " for c in t))


def plain_grams(t, order):
    padded = " " * (order - 1) + plain_symbols(t)
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def plain_decisions(labelled, texts):
    """{text: (language, bits, accepted)} by loops: labelled rows (id, text, language) that are all fitted on."""
    own = {lang: [t for _, t, k in sorted((r for r in labelled if r[1] and r[2] == lang), key=lambda r: (r[0] is None, r[0], r[1]))] for lang in sorted({r[2] for r in labelled})}
    held = {k: v[::5] if len(v) >= 10 else v for k, v in own.items()}
    fit = {k: [t for i, t in enumerate(v) if i % 5] if len(v) >= 10 else v for k, v in own.items()}
    order = langid.ORDER
    alphabet = len({c for v in fit.values() for t in v for c in plain_symbols(t)})
    models = {k: plain_model(v, order, alphabet) for k, v in fit.items()}
    letters = lambda t: sum(c != " " for c in plain_symbols(t))
    bits = lambda t, k: -sum(math.log2(models[k](g)) for g in plain_grams(t, order)) / len(plain_symbols(t))
    limit, spread = {}, {}
    for k in own:
        h, n = np.array([bits(t, k) for t in held[k]]), np.array([letters(t) for t in held[k]])
        mean = sum(h * np.sqrt(n)) / sum(np.sqrt(n))
        spread[k] = math.sqrt(np.mean((h - mean) ** 2 * n))
        most = max(np.quantile(h - 3 * spread[k] / np.sqrt(n), 1 - langid.FALSE_REJECTION), mean)
        others = [bits(t, k) for j in own if j != k for t in held[j]]
        least = np.quantile(others, langid.FALSE_REJECTION) if others else 0.0
        limit[k] = (most + least) / 2 if least > most else 1.5 * most
    out = {}
    for t in texts:
        if not t or not letters(t):
            out[t] = (None, None, False)
            continue
        k = min(own, key=lambda k: (bits(t, k), k))
        out[t] = (k, bits(t, k), bits(t, k) <= limit[k] + 3 * spread[k] / math.sqrt(letters(t)))
    return out


def test_the_whole_result_is_that_of_plain_loops(spark):
    """Fitting, limits, entropies, languages and decisions of a small table."""
    labelled = [(i, text(lang, 4 + i % 9, i), lang) for i, lang in enumerate([*WORDS] * 14)] + [(100 + i, text("aa", 6, 500 + i), "dd") for i in range(4)]
    others = [(200 + i, t, None) for i, t in enumerate(["tolo wecht", "zzqj qjzz", "", "12 %", "XIZÉ, ïxé!", "mekx salq tomi", text("bb", 300, 1)])]
    want = plain_decisions(labelled, {t for _, t, _ in labelled + others})
    got = langid.identify(frame(spark, labelled + others)).collect()
    assert len(got) == len(labelled) + len(others)
    for r, (_, t, _) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(labelled + others)):
        k, bits, ok = want[t]
        assert r["predicted_lang"] == k and (bits is None) == (r["cross_entropy"] is None) and r["accepted"] == ok, t
        assert bits is None or r["cross_entropy"] == pytest.approx(bits, rel=1e-4)


def test_stray_labels_do_not_grow_the_sample(spark):
    rows = [(i, text("aa", 9, i), "aa") for i in range(30)] + [(100 + i, text("bb", 9, i), f"stray{i}") for i in range(60)]
    sample = langid.bounded_rows(frame(spark, rows), "doc_id", "lang", 50, classes=3).groupBy("lang").count().collect()
    assert {(r["lang"], r["count"]) for r in sample} == {("aa", 30), ("stray0", 1), ("stray1", 1)}


def test_probabilities_are_those_of_the_definition():
    texts = [text("aa", 12, i) for i in range(4)]
    model = langid.KneserNey(langid.grams(*langid.symbols(texts), 3), 3)
    for gram in ("tol", "olo", "ola", " to", "zzz", "o t", "az "):
        key = np.array([ord(gram[0]) << 32 | ord(gram[1]) << 16 | ord(gram[2])], np.uint64)
        assert model.probability(key)[0] == pytest.approx(plain_probability(texts, gram, 3, model.alphabet), rel=1e-9), gram


def test_probabilities_sum_to_one():
    model = langid.KneserNey(langid.grams(*langid.symbols([text("bb", 50, 0)]), 4), 4)
    letters = [int(k) for k in np.unique(langid.grams(*langid.symbols([text("bb", 50, 0)]), 4) & np.uint64(0xFFFF))]
    for context in ("gru", "xyz", " st"):
        base = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        total = model.probability(np.array([base | c for c in letters], np.uint64)).sum()
        assert total + (model.alphabet - len(letters)) * model.probability(np.array([base | 0x2603], np.uint64))[0] == pytest.approx(1)


def test_hashes_are_sorted_and_found():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 500).astype(np.uint64))
    a = langid.HashArray.of(keys, np.arange(len(keys)))
    assert (np.diff(a.hashes.astype(object)) > 0).all()
    at, there = a.find(keys)
    assert there.all() and (a.values[at] == np.arange(len(keys))).all() and not a.find(keys + np.uint64(1 << 63))[1].any()


def test_held_out_texts_are_named_and_strange_ones_rejected(models):
    some = [(lang, text(lang, n, 1000 + i)) for lang in WORDS for i, n in enumerate((3, 8, 30, 400) * 5)]
    names, h, ok = models.decide([t for _, t in some])
    assert names == [lang for lang, _ in some] and ok.all()
    r = random.Random(1)
    strange = ["".join(r.choices("qwyjvpfhð ", k=300)), "12345 %%% ---", "", "   "]
    names, h, ok = models.decide(strange)
    assert not ok.any() and names[1:] == [None] * 3 and np.isnan(h[1:]).all()


def test_slices_do_not_matter(models):
    texts = [text(lang, n, n) for n in (1, 5, 200) for lang in WORDS]
    together = models.decide(texts)
    apart = [models.decide([t]) for t in texts]
    assert together[0] == [a[0][0] for a in apart] and np.allclose(together[1], [a[1][0] for a in apart])


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(lang, 40, i), lang) for i, lang in enumerate([*WORDS] * 30)]
    return [*out, (0, out[0][1], "aa"), (None, text("aa", 20, 7), None), (901, None, "aa"), (902, "", "bb"), (903, "zzqj qjzz " * 30, None), (904, text("cc", 30_000, 9), None)]


def test_on_a_table(spark, rows):
    got = {(r["doc_id"], r["lang"]): r for r in langid.identify(crowded(frame(spark, rows))).collect()}
    assert len(langid.identify(frame(spark, rows)).collect()) == len(rows)
    for doc_id, t, lang in rows[:90]:
        assert got[doc_id, lang]["predicted_lang"] == lang and got[doc_id, lang]["accepted"]
    assert got[None, None]["predicted_lang"] == "aa" and got[904, None]["predicted_lang"] == "cc" and got[904, None]["accepted"]
    assert (got[901, "aa"]["predicted_lang"], got[901, "aa"]["cross_entropy"], got[901, "aa"]["accepted"]) == (None, None, False)
    assert not got[902, "bb"]["accepted"] and not got[903, None]["accepted"]


def test_filter_keeps_columns(spark, rows):
    docs = crowded(frame(spark, rows))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    assert kept.count() == len(rows) - 3


def test_without_rows_or_labels(spark):
    assert langid.identify(frame(spark, [])).collect() == []
    (r,) = langid.identify(frame(spark, [(1, "some text", None)])).collect()
    assert (r["predicted_lang"], r["accepted"]) == (None, False)


def test_rows_without_ids_are_sampled_one_by_one(spark):
    rows = [(None if lang == "aa" else 7, text(lang, 40, i), lang) for lang in ("aa", "bb") for i in range(400)]
    sample = langid.bounded_rows(frame(spark, rows).withColumnsRenamed({"doc_id": "k", "text": "t", "lang": "l"}), ("k", "t"), "l", 50).groupBy("l").count().collect()
    assert {r["l"] for r in sample} == {"aa", "bb"} and all(30 <= r["count"] <= 100 for r in sample)
    assert set(langid.fit(frame(spark, rows), per_language=50).names) == {"aa", "bb"}


def test_marks_and_astral_letters_are_letters(spark):
    """Hindi and Thai with their vowel signs, and two scripts beyond the basic plane."""
    assert langid.symbols(["हिन्दी भाषा, ไทยที่"])[0].tolist() == [32, *map(ord, "हिन्दी"), 32, *map(ord, "भाषा"), 32, *map(ord, "ไทยที่")]
    gothic, deseret = "𐌰𐌱𐌲", "𐐀𐐨𐐩"
    a, b = langid.symbols([gothic])[0], langid.symbols([deseret])[0]
    assert len(set(a[1:].tolist())) == 3 and all(0xD800 <= c < 0xE000 for c in a[1:].tolist())
    assert b[1] == b[2] and b[2] != b[3]  # lower case
    r = random.Random(1)
    words = {
        "hi": ["हिन्दी", "भाषा", "में", "लिखा", "हुआ", "पाठ", "यह", "एक", "कि", "नहीं"],
        "mr": ["मराठी", "भाषेत", "लिहिलेला", "मजकूर", "हा", "एक", "आहे", "नाही", "आणि", "होते"],
        "th": ["ภาษาไทย", "ที่", "เขียน", "ไว้", "เป็น", "ข้อความ", "หนึ่ง", "และ", "ไม่", "ได้"],
        "got": ["𐌰𐌱𐌲", "𐌳𐌴", "𐌵𐌶𐌰"],
        "en-dsrt": ["𐐨𐐩", "𐐪𐐫𐐬", "𐐭𐐮"],
    }
    rows = [(i, " ".join(r.choices(words[k], k=30)), k) for i, k in enumerate(k for k in words for _ in range(30))]
    got = langid.identify(frame(spark, rows)).collect()
    assert all(g["predicted_lang"] == g["lang"] and g["accepted"] for g in got)
