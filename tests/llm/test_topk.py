import numpy as np
import pyarrow as pa
import pytest
from helpers import dicts, duck, same_rows
from pyspark.sql import functions as F

from millrace.llm import topk

DDL = "vec_id bigint, embedding array<float>, label int"


def vectors(n, dim, seed, clusters=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim)) * 2
    return (centres[r.integers(0, clusters, n)] + r.normal(size=(n, dim)) * 0.3).astype(np.float32)


def brute(ids, x, k):
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, topk.DECIMALS)
    out = {}
    for i, q in enumerate(ids):
        some = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out[q] = [(v, -d) for d, v in some]
    return out


@pytest.mark.parametrize(("n", "dim", "shard"), [(900, 8, 200), (300, 3, 10_000), (400, 32, 50)])
def test_every_row_against_brute_force(spark, n, dim, shard, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    x = vectors(n, dim, n)
    x[10:20] = x[0]
    x[30] = 0
    got = {}
    for r in topk.top_k(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], DDL), 7, shard, 1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbor_id"], r["score"]))
    assert got == brute(list(range(n)), x, 7)


def test_branches_are_cut():
    x = vectors(4000, 8, 1, 40).astype(np.float64)
    tree = topk.BallTree(np.arange(4000), x, 32)
    best, ids = np.full((100, 5), -np.inf), np.zeros((100, 5), np.int64)
    made = tree.search(np.arange(100), x[tree.ids.argsort()][:100], best, ids)
    assert made < 0.5 * 100 * 4000
    cold = made
    again, ids2 = np.repeat(best[:, -1:], 5, 1), np.full((100, 5), np.iinfo(np.int64).max)
    assert tree.search(np.arange(100), x[tree.ids.argsort()][:100], again, ids2) <= cold


def test_bounds_hold():
    x = vectors(500, 6, 2).astype(np.float64)
    tree = topk.BallTree(np.arange(500), x, 8)
    q = vectors(50, 6, 3).astype(np.float64)
    for node, (a, b) in enumerate(tree.span):
        bound = q @ tree.centre[node] + np.linalg.norm(q, axis=1) * tree.radius[node]
        assert ((q @ tree.x[a:b].T).max(1) <= bound + 1e-9).all()


def test_awkward_rows_and_sql(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors(40, 4, 9))]
    rows += [(100, None, 1), (101, [], 1), (None, [1.0] * 4, 1), (5, [9.0] * 4, 2), (6, rows[6][1], 1), (103, [1.0, 2.0], 1), (104, [2.0, 1.0], None), (105, [0.5], 1)]
    table = pa.table([[r[0] for r in rows], [r[1] for r in rows]], schema=pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))]))
    broken = rows + [(102, [1.0, nan, 0.0, 0.0], 1), (106, [inf, 1.0, 1.0, 1.0], 1), (107, [None, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(broken, DDL).withColumns({c: F.lit(1) for c in ("dim", "shard", "score", "floor", "block")})
    got = dicts(topk.top_k(df, topk.K, 10, 1))
    assert same_rows(got, duck(topk.sql(1), embeddings=table))
    assert same_rows(dicts(topk.top_k(df)), duck(topk.SQL, embeddings=table))
    assert {r["query_id"] for r in got}.isdisjoint({100, 101, 102, 105, 106, 107, None})


def test_few_rows(spark):
    assert topk.top_k(spark.createDataFrame([], DDL)).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0)], DDL)).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0), (2, [3.0], 0)], DDL)).collect() == []
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(1, [1.0], 0), (2, [3.0], 0)], DDL), every=1).orderBy("query_id").collect()] == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]


def test_hot_copies_string_ids_and_blocks(spark, monkeypatch):
    """A third of the rows are copies of one vector; shards and blocks are so small that there are many of each."""
    monkeypatch.setattr(topk, "TREE_VALUES", 160)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 400)
    x = vectors(300, 8, 4)
    x[:100] = x[0]
    ids = [f"id{i:03d}é" for i in range(300)]
    got = {}
    for r in topk.top_k(spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id string, embedding array<float>, label int"), 5, 40, 1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbor_id"], r["score"]))
    assert got == brute(ids, x, 5)


def test_queries_are_sent_where_bounds_reach_only(spark):
    """Of far clusters a query opens few cells, so that far fewer rows move than queries times cells."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 16)) * 20
    x = (centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 16))).astype(np.float64)
    cells = topk.Cells([v.tolist() for v in x[::3]], 3000, 50)
    cell, dist = cells.assign(16, x)
    cells.radius[16] = np.array([dist[cell == c].max(initial=-np.inf) for c in range(len(cells.centres[16]))])
    own = np.round(x @ x.T, topk.DECIMALS)
    np.fill_diagonal(own, -np.inf)
    kth = -np.partition(-own, 9, axis=1)[:, 9]
    bounds = cells.bounds(16, x)
    assert (bounds >= kth[:, None]).mean() < 0.3
    # and none is shut that holds one of the ten best
    for i in range(0, 3000, 37):
        assert (bounds[i, cell[np.argsort(-own[i])[:10]]] >= kth[i]).all()


def test_vectors_of_a_length_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 0)
    x = vectors(60, 4, 5)
    got = {}
    for r in topk.top_k(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], DDL), 3, 20, 1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbor_id"], r["score"]))
    assert got == brute(list(range(60)), x, 3)
