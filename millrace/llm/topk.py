"""Operator 8: exact top-k search by inner product, with ball trees per shard.

A bounded sample of the vectors is cut into cells by a ball tree of its own; every vector goes to the cell of
the nearest centre, and cells of many vectors are split into shards by a hash. Each shard's ball tree is built
once. The queries (rows whose id is divisible by QUERY_EVERY) search the trees by branch and bound: the inner
product with any vector of a ball is at most q.c + |q| r, leaves are visited in descending order of that
bound, and the search stops at the first that cannot reach the current k-th score.

The k-th score is shared between shards in three rounds: the shard a query lies in, then the cells of the highest
bounds, then whatever cell's bound still reaches the k-th score of the rounds before. A query is sent to no
other cell, so what moves is the queries that are open and the trees that they open.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, unit_hash, written

K = 10
#: Rows whose id is divisible by this are the queries; ids that are no integers count by their hash.
QUERY_EVERY = 50
#: About as many vectors lie in a cell, while there are fewer than MOST_CELLS; at most as many in a leaf.
SHARD, LEAF = 4096, 256
MOST_CELLS = 1024
#: Bounds of the sample that the cells are fitted on: rows, and numbers in them.
SAMPLE_ROWS, SAMPLE_VALUES = 16384, 1 << 22
#: Numbers in a shard's tree, and in a block of queries that meets it in one task, at most about this many.
TREE_VALUES, BLOCK_VALUES = 1 << 21, 1 << 19
#: Cells of the highest bounds that are searched in the second round.
NEAR = 4
#: Scores are rounded to this many decimals, so that equal vectors tie whatever the order of sums.
DECIMALS = 6
_SLACK = 2e-6


class BallTree:
    """A binary ball tree; leaves are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        centre, radius, child, span = [], [], [], []

        def build(a: int, b: int) -> int:
            node = len(centre)
            own = x[order[a:b]]
            c = own.mean(0)
            centre.append(c)
            radius.append(float(np.sqrt(((own - c) ** 2).sum(1).max())))
            child.append((-1, -1))
            span.append((a, b))
            if b - a > leaf:
                far = own[((own - c) ** 2).sum(1).argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                side, mid = own @ (other - far), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(side, mid)]
                child[node] = build(a, a + mid), build(a + mid, b)
            return node

        build(0, len(x))
        self.ids, self.x = ids[order], x[order]
        self.centre, self.radius, self.child, self.span = np.array(centre), np.array(radius), child, span

    def search(self, qid: np.ndarray, queries: np.ndarray, best: np.ndarray, best_id: np.ndarray) -> int:
        """Better neighbours of the queries into best and best_id (descending scores, -inf where none); returns products made."""
        norm = np.sqrt((queries**2).sum(1))
        bound = queries @ self.centre.T + norm[:, None] * self.radius[None, :] + _SLACK
        made = 0
        # down from the root: a node is open to a query while no node above it is shut
        open_to, leaves = {0: np.ones(len(queries), bool)}, []
        stack = [0]
        while stack:
            node = stack.pop()
            alive = open_to[node] & (bound[:, node] >= best[:, -1])
            bound[~alive, node] = -np.inf
            if self.child[node][0] < 0:
                leaves.append(node)
                continue
            for below in self.child[node]:
                open_to[below] = alive
                stack.append(below)
        leaves = np.array(leaves)
        upper = bound[:, leaves]
        visit = np.argsort(-upper, axis=1)
        for turn in range(len(leaves)):
            at = visit[:, turn]
            going = np.flatnonzero(upper[np.arange(len(at)), at] >= best[:, -1])
            going = going[upper[going, at[going]] > -np.inf]
            if not len(going):
                break
            for which in np.unique(at[going]):
                rows = going[at[going] == which]
                a, b = self.span[leaves[which]]
                score = np.round(queries[rows] @ self.x[a:b].T, DECIMALS)
                made += score.size
                ids = self.ids[a:b]
                score[qid[rows][:, None] == ids[None, :]] = -np.inf
                hit = np.flatnonzero(score.max(1) >= best[rows, -1])
                if not len(hit):
                    continue
                r = rows[hit]
                s = np.concatenate([best[r], score[hit]], 1)
                i = np.concatenate([best_id[r], np.broadcast_to(ids, (len(r), len(ids)))], 1)
                if s.shape[1] > 4 * best.shape[1]:
                    kth = -np.partition(-s, best.shape[1] - 1, axis=1)[:, best.shape[1] - 1]
                    wide = int((s >= kth[:, None]).sum(1).max())
                    some = np.argpartition(-s, min(wide, s.shape[1] - 1), axis=1)[:, :wide]
                    s, i = np.take_along_axis(s, some, 1), np.take_along_axis(i, some, 1)
                o = np.lexsort((i, -s), axis=1)[:, : best.shape[1]]
                best[r], best_id[r] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
        return made


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each length of the lists."""
    offsets = lists.offsets.to_numpy()
    flat, start, size = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), offsets[:-1], np.diff(offsets)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[start[rows][:, None] + np.arange(dim)]


class Cells:
    """Centres of the cells by length of vector, and later the cells' radii."""

    def __init__(self, sample: list[list[float]], total: int, shard: int):
        self.centres: dict[int, np.ndarray] = {}
        self.radius: dict[int, np.ndarray] = {}
        lists = pa.array(sample, pa.list_(pa.float64()))
        for dim, rows, x in _by_length(lists) if sample else ():
            share = len(rows) / len(sample)
            want = int(min(MOST_CELLS * share, total * share / shard, len(rows) / 4))
            tree = BallTree(np.arange(len(x)), x, max(1, -(-len(x) // max(1, want))))
            self.centres[dim] = tree.centre[[i for i, c in enumerate(tree.child) if c[0] < 0]]

    def assign(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cell of each vector, and its distance; infinite for a length that the sample lacks."""
        c = self.centres.get(dim)
        if c is None:
            return np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        cell = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1).astype(np.int32)
        return cell, np.sqrt(((x - c[cell]) ** 2).sum(1))

    def bounds(self, dim: int, x: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products with the vectors of each cell; -inf for a cell without vectors."""
        c = self.centres.get(dim)
        if c is None:
            return np.full((len(x), 1), np.inf)
        r = self.radius.get(dim, np.full(len(c), -np.inf))
        norm = np.sqrt((x * x).sum(1))
        return np.where(r >= 0, x @ c.T + norm[:, None] * (r * (1 + 1e-9)) + _SLACK, -np.inf)


def _assigned(sent, vector: Column) -> Column:
    """vector -> struct(cell, distance to its centre)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            cell, dist = np.zeros(len(lists), np.int32), np.zeros(len(lists))
            for dim, rows, x in _by_length(lists):
                cell[rows], dist[rows] = sent.value.assign(dim, x)
            yield pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], ["cell", "dist"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<cell int, dist double>")(vector)


def _nearest(sent, vector: Column, home: Column) -> Column:
    """vector, its cell -> that cell and the NEAR others of the highest bounds."""

    def run(lists: pa.Array, homes: pa.Array) -> pa.Array:
        own, out = homes.to_numpy(), [None] * len(lists)
        for dim, rows, x in _by_length(lists):
            b = sent.value.bounds(dim, x)
            b[np.arange(len(rows)), own[rows]] = np.inf
            most = min(NEAR + 1, b.shape[1])
            for row, some in zip(rows, np.argpartition(-b, most - 1, axis=1)[:, :most].tolist()):
                out[row] = some
        return pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"lists": pa.Array, "homes": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(vector, home)


def _open(sent, vector: Column, floor: Column) -> Column:
    """vector, k-th score so far -> the cells whose bound reaches it."""

    def run(lists: pa.Array, floors: pa.Array) -> pa.Array:
        least, out = floors.to_numpy(), [None] * len(lists)
        for dim, rows, x in _by_length(lists):
            for row, may in zip(rows, sent.value.bounds(dim, x) >= least[rows][:, None]):
                out[row] = np.flatnonzero(may).tolist()
        return pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"lists": pa.Array, "floors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(vector, floor)


def _planted(pdf: pd.DataFrame) -> bytes:
    """The tree of a shard's vectors as bytes; inside it ids are their places in the shard's order of ids."""
    ids = pdf["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    tree = BallTree(np.arange(len(ids)), _matrix(pdf["embedding"].iloc[order]))
    return pickle.dumps((ids[order], tree), protocol=5)


def _search(queries: pd.DataFrame, packed: bytes, k: int) -> pd.DataFrame:
    """(query_id, neighbor_id, score) of a shard's vectors among a query's k best that reach its floor."""
    ids, tree = pickle.loads(packed)
    qid, floor, none = queries["vec_id"].to_numpy(), queries["floor"].to_numpy(), np.iinfo(np.int64).max
    at = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
    own = np.where(ids[at] == qid, at, -1)
    out = []
    for a in range(0, len(qid), 1024):
        x = _matrix(queries["embedding"].iloc[a : a + 1024])
        # the k-th score known so far stands in all places: what is below it cannot count
        best, best_id = np.repeat(floor[a : a + 1024, None], k, 1), np.full((len(x), k), none)
        tree.search(own[a : a + 1024], x, best, best_id)
        there = (best_id != none) & (best > -np.inf)
        out.append(pd.DataFrame({"query_id": np.repeat(qid[a : a + 1024], there.sum(1)), "neighbor_id": ids[best_id[there]], "score": best[there]}))
    return pd.concat(out)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that can be searched; of a repeated vec_id the smallest embedding."""
    v = vectors.select("vec_id", "embedding")
    if v.schema["embedding"].dataType.simpleString() != "array<float>":
        v = v.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def is_query(v: DataFrame, every: int) -> Column:
    """Whether a row is a query: its id is divisible by every, or its id's hash where ids are no integers."""
    whole = v.schema["vec_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.pmod(F.col("vec_id") if whole else F.xxhash64("vec_id"), F.lit(every)) == 0


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, shard: int = SHARD, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, neighbor_id, score): the k best neighbours, among all rows, of every query, exactly.

    Queries are the rows whose vec_id is divisible by ``every`` (1: all rows); ids may be of any type that can be
    ordered, and those that are no integers count by their hash. score is the inner product, rounded to six
    decimals; ties go to the smaller neighbor_id. A vector is no neighbour of itself. Vectors are compared
    with those of their own length only. Rows with a null vec_id, a null or empty embedding, or one with a
    null, NaN or infinite element are neither queries nor neighbours. Of rows with one vec_id the one
    with the smallest embedding counts; equal embeddings under different ids are neighbours of each
    other. Fewer than k others give fewer rows. Other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    scratch = Scratch()  # tables that the result does not read
    v = scratch.written(usable(vectors), "vectors")
    n, values = v.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    share = min(1.0, SAMPLE_ROWS / max(1, n), SAMPLE_VALUES / max(1, values))
    cells = Cells([r[0] for r in v.where(unit_hash(F.col("vec_id"), seed=8) < share).select("embedding").collect()], n, shard)
    v = scratch.written(v.select("*", _assigned(spark.sparkContext.broadcast(cells), F.col("embedding")).alias("c")).select("vec_id", "embedding", "dim", "c.*"), "cells")
    # a cell of many vectors, such as thousands of copies, is spread over shards by a hash
    salts = F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") / TREE_VALUES)).cast("int")
    sizes = scratch.written(v.groupBy("dim", "cell").agg(salts.alias("salts"), F.max("dist").alias("radius")), "sizes")
    for r in sizes.where(F.col("radius") < float("inf")).collect():  # as many rows as cells were fitted at most
        cells.radius.setdefault(r["dim"], np.full(len(cells.centres[r["dim"]]), -np.inf))[r["cell"]] = r["radius"]
    sent = spark.sparkContext.broadcast(cells)
    placed = v.join(sizes.drop("radius"), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("salts")).cast("int"))

    def plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "salt": [key[2]], "tree": [_planted(pdf)]})

    trees = placed.select("dim", "cell", "salt", "vec_id", "embedding").groupBy("dim", "cell", "salt").applyInPandas(plant, "dim int, cell int, salt int, tree binary")
    trees = written(trees, "trees")
    blocks = max(1, -(-(values // every) // BLOCK_VALUES))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    near = _nearest(sent, F.col("embedding"), F.col("cell"))
    asks = scratch.written(placed.where(is_query(v, every)).select("vec_id", "embedding", "dim", "cell", "salt", block.alias("block"), near.alias("near")), "queries")
    tile = ["dim", "cell", "salt", "block"]

    def meet(key: tuple, queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(tree):
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "score": []})
        return _search(queries, tree["tree"].iloc[0], k)

    def search(asked: DataFrame, keep=scratch.written) -> DataFrame:
        """What the shards that are asked know; only their trees move, once for each block of queries."""
        asked = keep(asked.select(*tile, "vec_id", "embedding", "floor"), "asked")
        own = asked.select(*tile).distinct().join(trees, ["dim", "cell", "salt"]).toDF("d", "c", "s", "b", "tree")
        return asked.groupBy(*tile).cogroup(own.groupBy("d", "c", "s", "b")).applyInPandas(meet, f"query_id {kind}, neighbor_id {kind}, score double")

    def opened(which: Column, known: DataFrame) -> DataFrame:
        """A row for each query and shard of the cells that ``which`` names and whose bounds reach the query's k-th score."""
        kth = known.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("s"))
        rows = asks.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("s", F.lit(float("-inf"))))
        rows = rows.withColumn("may", _open(sent, F.col("embedding"), F.col("floor")))
        rows = rows.select("dim", F.col("cell").alias("home"), F.col("salt").alias("home_salt"), "block", "vec_id", "embedding", "floor", F.explode(which).alias("cell"))
        rows = rows.join(sizes.drop("radius"), ["dim", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return rows.where("cell <> home or salt <> home_salt")

    first = scratch.written(_best(search(asks.withColumn("floor", F.lit(float("-inf")))), k), "best")
    second = search(opened(F.array_intersect("near", "may"), first))
    second = written(_best(first.drop("rank").union(second), k), "best")
    third = search(opened(F.array_except("may", "near"), second), written)
    scratch.clear()
    return _best(second.drop("rank").union(third), k).select("query_id", "rank", "neighbor_id", "score")


def sql(every: int = QUERY_EVERY) -> str:
    """The same as DuckDB SQL over the table embeddings, for integer ids."""
    return f"""
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), {DECIMALS}) AS score
  FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, neighbor_id, score FROM r WHERE rank <= {K}
"""


SQL = sql()
