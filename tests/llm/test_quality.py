import random

import numpy as np
import pytest
from helpers import crowded, frame

from millrace.llm import quality


def good(seed, n=60):
    r = random.Random(seed)
    w = ["".join(r.choices("abdelmnorstu", k=r.randint(2, 8))) for _ in range(n)]
    return " ".join(x.capitalize() if i % 12 == 0 else x for i, x in enumerate(w)) + "."


def bad(seed, n=60):
    r = random.Random(seed)
    kind = seed % 3
    words = good(seed, n).split()
    if kind == 0:
        return " ".join(w + r.choice(["%%%", "$$$", "###"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for w in words[: n // 6] for _ in range(6))


@pytest.fixture(scope="module")
def rows():
    return [(i, good(i) if i % 2 else bad(i), "en", "s") for i in range(400)]


def test_held_out_accuracy(rows):
    model = quality.QualityModel([r[1] for r in rows[:300]], np.array([bool(r[0] % 2) for r in rows[:300]]))
    p = model.probabilities([good(1000 + i, n) for i, n in enumerate((5, 20, 60, 500) * 15)] + [bad(1000 + i) for i in range(60)])
    assert (p[:60] >= quality.KEEP_FROM).mean() >= 0.97 and (p[60:] < quality.KEEP_FROM).mean() >= 0.97
    assert 0.25 <= model.temperature <= 16 and model.held_accuracy > 0.95


def test_pooling_is_the_plain_mean(rows):
    model = quality.QualityModel([r[1] for r in rows[:100]], np.array([bool(r[0] % 2) for r in rows[:100]]))
    texts = ["", rows[0][1], "one", "a a a b", rows[1][1] * 50]
    ids = quality._Ids(model.words, model.shapes)
    for t, row in zip(texts, model.pooled(texts)):
        words = t.split()
        want = np.mean([model.table[ids[w]].astype(np.float64) for w in words], axis=0) if words else np.zeros(2 * quality.DIM)
        assert row[0] == len(words) and np.allclose(row[1:-1], want, rtol=1e-4, atol=1e-4)
        assert row[-1] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)))


def test_index_vectors_are_sparse_and_fixed():
    v = quality._index_vector("wtree")
    assert (v == quality._index_vector("wtree")).all() and np.count_nonzero(v) == quality.NONZERO and v.sum() == 0


def test_shapes():
    assert [quality.shape(w) for w in ("tree", "Tree", "TREE!!", "a%%%", "3.14", "MacOS", "|")] == ["l", "Ul", "U!", "l%", "0.0", "UlU", "|"]

    # whole words, however long: nothing is cut off, and many runs go by their number
    assert quality.shape("a" * 64 + "1") == "l0" and quality.shape("a" * 10**6 + "%%") == "l%"
    assert quality.shape("a1" * 6) == "l0" * 6 and quality.shape("a1" * 8) == "~5" != quality.shape("a1" * 1000) == "~11"


def test_long_words_are_not_remembered(rows):
    model = quality.QualityModel([r[1] for r in rows[:100]], np.array([bool(r[0] % 2) for r in rows[:100]]))
    ids = quality._Ids(model.words, model.shapes)
    before = len(ids)
    assert ids["x" * 65] == model.shapes["l"] and len(ids) == before and ids["xyz0"] == model.shapes.get("l0", 0) and len(ids) == before + 1


def test_string_ids_and_repeated_ids(spark, rows):
    """One id holds a third of the rows: a single text of it is fitted on."""
    from pyspark.sql import functions as F

    docs = frame(spark, [*rows, *[(1, good(5000 + i)) for i in range(200)]])
    lab = labels(spark, rows)
    assert len(quality.classify(docs, lab).collect()) == 600
    text = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = quality.classify(text, lab.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert np.mean([r["accepted"] == bool(int(r["doc_id"][1:]) % 2) for r in got]) > 0.98


def brute_probability(model, text):
    """The whole model by plain loops: words' vectors, pooling, shrinking, both layers, temperature."""
    import math

    words = text.split()
    vector = lambda w: [float(v) for v in model.table[model.words.get(w, model.shapes.get(quality.shape(w), 0))]]
    pooled = [sum(c) / len(words) for c in zip(*map(vector, words))] + [sum(a == b for a, b in zip(words, words[1:])) / len(words)]
    shrink = len(words) / (len(words) + quality.SHRINK)
    x = [(p - c) / s * shrink for p, c, s in zip(pooled, model.centre, model.scale)]
    w1, b1, w2, b2 = model.layers
    hidden = [math.tanh(sum(v * w1[i, j] for i, v in enumerate(x)) + b1[j]) for j in range(quality.HIDDEN)]
    z = (sum(h * w for h, w in zip(hidden, w2)) + float(b2[0])) / model.temperature
    return 1 / (1 + math.exp(-z))


def test_the_whole_result_is_that_of_plain_loops(spark, rows):
    docs, lab = frame(spark, rows), labels(spark, rows)
    model = quality.fit(docs, lab)
    got = {r["doc_id"]: r for r in quality.classify(docs, lab).collect()}
    for i, t, *_ in rows:
        p = brute_probability(model, t)
        assert got[i]["good_probability"] == pytest.approx(p, rel=1e-4, abs=1e-6) and (got[i]["accepted"] == (p >= quality.KEEP_FROM) or abs(p - quality.KEEP_FROM) < 1e-6)


def test_temperature_is_the_one_of_least_loss_on_held_out_texts(rows):
    import math

    texts, y = [r[1] for r in rows[:200]], np.array([bool(r[0] % 2) for r in rows[:200]])
    y[::7] = ~y[::7]  # else every temperature would do
    model = quality.QualityModel(texts, y)
    logit = lambda t: (lambda p: math.log(p / (1 - p)) * model.temperature)(brute_probability(model, t))
    held = [(logit(t), k) for i, (t, k) in enumerate(zip(texts, y)) if i % 5 == 0]
    loss = lambda at: sum(math.log(1 + math.exp(-z / at if k else z / at)) for z, k in held)
    assert loss(model.temperature) <= min(loss(model.temperature * f) for f in (0.9, 1.1)) + 1e-6


def labels(spark, rows, extra=()):
    return spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows] + list(extra), "doc_id bigint, quality int, toxic int")


def test_on_a_table(spark, rows):
    more = [*rows, rows[0], (900, None), (901, ""), (902, " \n"), (None, good(7)), (903, good(8) + " " + good(9, 20_000))]
    docs = crowded(frame(spark, more))
    lab = labels(spark, rows, [(1, 0, 0), (None, 1, 0), (5, None, 0), (12345, 1, 0)])
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(more)
    by = {r["doc_id"]: r for r in got}
    assert all(not by[i]["accepted"] and by[i]["good_probability"] == 0 for i in (900, 901, 902))
    assert by[None]["accepted"] and by[903]["accepted"]
    assert np.mean([by[i]["accepted"] == bool(i % 2) for i in range(400)]) > 0.98
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in got)


def test_without_rows_or_labels(spark, rows):
    none = labels(spark, [])
    assert quality.classify(frame(spark, []), none).collect() == []
    assert quality.classify(frame(spark, []), labels(spark, rows)).collect() == []
    got = {r["doc_id"]: r["accepted"] for r in quality.classify(frame(spark, [(1, "a b"), (2, None)]), none).collect()}
    assert got == {1: True, 2: False}
