import random
from itertools import combinations

import numpy as np
import pytest
from helpers import crowded, frame
from pyspark.sql import functions as F

from millrace.llm import neardup
from millrace.llm.common import Scratch, shared_dir


def prose(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=5)) for _ in range(n)]


def edited(words, share, seed):
    r = random.Random(seed)
    return [f"new{r.randrange(10**6)}" if r.random() < share else w for w in words]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0


def test_signatures_estimate_jaccard_without_bias():
    pairs = []
    for seed in range(60):
        a = prose(seed, 200)
        pairs.append((" ".join(a), " ".join(edited(a, 0.02 * (seed % 6), seed))))
    a, _ = neardup.signatures([p[0] for p in pairs])
    b, _ = neardup.signatures([p[1] for p in pairs])
    off = (a == b).mean(1) - [jaccard(*p) for p in pairs]
    assert abs(off.mean()) < 0.015 and np.abs(off).max() < 0.2


def test_both_ends_of_each_permutation_are_kept():
    sig, some = neardup.signatures(["a b c d e f g", "", "one two", "ONE  two"])
    assert list(some) == [True, False, True, True] and (sig[0, 0::2] < sig[0, 1::2]).all() and (sig[2] == sig[3]).all()
    assert (sig[2, 0::2] == sig[2, 1::2]).all()


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(prose(i, 120))) for i in range(60)]
    base = prose(999, 150)
    out += [(100 + i, " ".join(edited(base, 0.02, i))) for i in range(25)]
    out += [(200 + i, " ".join(base)) for i in range(40)]
    out += [(300 + i, f"Short note {i // 2}") for i in range(6)]
    chain = prose(5000, 200)
    for i in range(5):
        out.append((400 + i, " ".join(chain)))
        chain = edited(chain, 0.08, 60 + i)
    out += [(500, None), (501, ""), (502, "  "), (503, None), (None, " ".join(base)), (0, out[0][1]), (7, " ".join(prose(8, 120)) + " x")]
    random.Random(3).shuffle(out)
    return out


def brute_groups(rows, least):
    """Groups of row numbers by union of all pairs of at least that similarity."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    texts = [r[1] or "" for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        if shingles(texts[i]) and jaccard(texts[i], texts[j]) >= least:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(rows))]


def test_groups_are_those_of_all_pairs(spark, rows):
    docs = crowded(frame(spark, rows))
    got = {(r["doc_a"], r["doc_b"]) for r in neardup.near_duplicates(docs).collect()}
    groups = {}
    for root, r in zip(brute_groups(rows, 0.5), rows):
        groups.setdefault(root, []).append(r)
    want = set()
    for members in groups.values():
        ids = sorted((m[0] for m in members), key=lambda d: (d is None, d))
        want |= {(d, ids[0]) for d in ids if d != ids[0]}
    # 7 has two texts; the second is a near copy of 8
    assert got == want, (got - want, want - got)


def test_one_row_of_each_group_stays(spark, rows):
    docs = crowded(frame(spark, rows))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == len(set(brute_groups(rows, 0.5)))
    assert {500, 501, 502, 503} <= {d for d, _ in left} and 100 in {d for d, _ in left} and None not in {d for d, _ in left}
    assert left.count((0, next(t for d, t in rows if d == 0))) == 1


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch()).collect()}
    assert got == {x: find(x) for x in parent}
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint"), Scratch()).collect() == []


def test_a_band_whose_smallest_node_differs_is_compared_in_full(spark, monkeypatch):
    """Every text in one band: the star sees one node only, the rest must come from the pairs across components."""
    rows = [(i, " ".join(prose(i // 4, 80) if i % 4 == 0 else edited(prose(i // 4, 80), 0.05, i))) for i in range(40)]
    monkeypatch.setattr(neardup, "_bands_column", lambda sig: F.array(F.lit(1).cast("bigint")))
    want = {(i, i - i % 4) for i in range(40) if i % 4}
    docs = frame(spark, rows)
    assert {(r["doc_a"], r["doc_b"]) for r in neardup.near_duplicates(docs).collect()} == want
    # the same by rare values, and by tiles, whose groups and blocks are as small as can be
    for most in ({"pairs_up_to": 3}, {"pairs_up_to": 1, "tile": 2}, {"pairs_up_to": 0, "tile": 1}):
        by_root = {}
        for r in neardup.groups(docs, **most).collect():
            by_root.setdefault(r["root"], set()).add(r["doc_id"])
        assert {(i, min(g)) for g in by_root.values() for i in g if i != min(g)} == want


def test_a_band_of_fifty_thousand_nodes(spark, monkeypatch):
    """One band that all texts share: without a similar pair but two planted ones, and never in one row or task."""
    words = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**7)).cast("string")) for k in range(12)]).alias("text"))
    twin = words.where("doc_id in (7, 40000)").select(F.col("doc_id") + 100_000, F.concat("text", F.lit(" end")))
    monkeypatch.setattr(neardup, "_bands_column", lambda sig: F.array(F.lit(1).cast("bigint")))
    got = {(r["doc_a"], r["doc_b"]) for r in neardup.near_duplicates(words.union(twin)).collect()}
    assert got == {(100_007, 7), (140_000, 40_000)}


def test_tables_on_the_way_are_removed(spark):
    import os

    at = f"{shared_dir(spark)}/millrace"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    neardup.keep_one(frame(spark, [(i, "a b c d e") for i in range(4)])).collect()
    assert {n.partition("-")[0] for n in set(os.listdir(at)) - before} == {"members", "fate"}


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == [] and neardup.keep_one(frame(spark, [])).collect() == []
    assert neardup.near_duplicates(frame(spark, [(1, None), (2, "")])).collect() == [] and neardup.keep_one(frame(spark, [(1, None), (1, None)])).count() == 2
