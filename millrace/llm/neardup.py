"""Operator 10: near-duplicate groups by min-max hashing.

A text is its set of runs of three lower-case words. Each of 64 permutations is evaluated once per
shingle and gives two signature values, the smallest and the largest, so 128 values cost 64
evaluations; the share of equal values is an unbiased estimate of the Jaccard similarity. The
values are banded by four; texts that share a band are candidates.

Texts of equal signatures are one node, so that copies by the thousand cost one row each. A band's
nodes are first compared with the band's smallest node only (a star). The connected components of
the similar ones are taken, and then the pairs of a band that still lie in different components
are compared; pairs inside a component need no comparison. Where a band has up to PAIRS_UP_TO nodes, these
pairs are made one by one. The nodes of larger bands are grouped by their rarest values instead: two signatures
that agree in ``need`` of 128 values share one of the 129 - need rarest of either, whatever the order of
rarity. What is still a large group then is compared by tiles, blocks of nodes against blocks of nodes.
So the groups are those of comparing all pairs of every band, no band is ever held in a row or a task, and
nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, q, released, slices, written

SHINGLE, PERMUTATIONS, ROWS = 3, 64, 4
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
#: Least share of equal signature values of a pair.
SIMILAR = 0.48
#: Nodes of a band whose pairs are made one by one.
PAIRS_UP_TO = 64
#: Nodes in a block of a tile, about.
TILE = 4096
SLICE_BYTES = 1 << 18
_CACHE = 150_000


class _Hashes(dict):
    """Words to 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < _CACHE:
            self[word] = h
        return h


_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts: list[str], known: _Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signature of 128 values (uint32) of each text, and whether it has a word at all."""
    known = _Hashes() if known is None else known
    words = [np.fromiter(map(known.__getitem__, t.lower().split()), np.uint64) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(texts), VALUES), np.uint32)
    some = n > 0
    if not some.any():
        return out, some
    # a text of fewer words than a shingle is one shingle, its end filled up with zeros
    words = [w if len(w) >= SHINGLE else np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)]) for w in words if len(w)]
    size = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words)
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    h = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = h * _STEP + flat[k : len(flat) - SHINGLE + 1 + k]
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        last = starts[1:] - k
        inside[last] = False
    h = _mixed(h[inside])
    at = np.concatenate(([0], np.cumsum(size - SHINGLE + 1)[:-1]))
    low, high = np.empty((len(words), PERMUTATIONS), np.uint32), np.empty((len(words), PERMUTATIONS), np.uint32)
    for p in range(PERMUTATIONS):
        v = ((h * _MUL[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32)
        low[:, p] = np.minimum.reduceat(v, at)
        high[:, p] = np.maximum.reduceat(v, at)
    out[some, 0::2], out[some, 1::2] = low, high
    return out, some


def _band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * _STEP
    for k in range(ROWS):
        h = _mixed(h * _STEP + rows[:, :, k])
    return h.view(np.int64)


def _node(sig: np.ndarray) -> np.ndarray:
    h = np.zeros(len(sig), np.uint64)
    for k in range(VALUES):
        h = _mixed(h * _STEP + sig[:, k])
    return h.view(np.int64)


def _signature_column(text):
    """text -> struct(node, the values of its signature); null for texts without words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Hashes()
        for texts in batches:
            for a, b in slices(texts, SLICE_BYTES):
                sig, some = signatures([t or "" for t in texts.slice(a, b - a).to_pylist()], known)
                yield pa.StructArray.from_arrays([pa.array(_node(sig), mask=~some), pa.array([v.tobytes() for v in sig], pa.binary(), mask=~some)], ["node", "sig"])

    return F.arrow_udf(released(run), "struct<node bigint, sig binary>")(text)


def _values(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(-1, VALUES)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))


def _bands_column(sig):
    """A hash for each band of a signature."""

    def run(sigs: pa.Array) -> pa.Array:
        return _lists(_band_hashes(_values(sigs)))

    run.__annotations__ = {"sigs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(sig)


def _placed_values(sig):
    """The values of a signature, each with its place in it."""

    def run(sigs: pa.Array) -> pa.Array:
        return _lists(_values(sigs).astype(np.int64) | np.arange(VALUES, dtype=np.int64)[None, :] << 32)

    run.__annotations__ = {"sigs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(sig)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal values of signatures, 0 where no band of theirs is equal throughout."""
    same = x == y
    return np.where(same.reshape(*same.shape[:-1], BANDS, ROWS).all(-1).any(-1), same.mean(-1), 0.0)


def _agreement_column(a, b):
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_agreement(_values(x), _values(y)))

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for edges (a, b).

    Large-star and small-star steps until the edges are stars. Neighbours are never collected: each step is a
    grouped minimum joined back, so that a hub is split like any skewed key. Every step is written, so
    that a lost executor costs one step at most.
    """
    now = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        sums = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(sums) == before or not sums[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = tuple(sums)
        # large-star: every larger neighbour is tied to the smallest of the node and its neighbours
        low = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a")).groupBy("u").agg(F.min("v").alias("m"))
        large = now.join(low, now["b"] == low["u"]).select("a", F.least("b", "m").alias("b")).distinct()
        # small-star: every smaller neighbour, and the node itself, is tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.written(tied.union(least).distinct(), "edges")


def _similar(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that share a band and whose signatures agree."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    return both.where(_agreement_column(F.col("x"), F.col("y")) >= least).select("a", "b")


def _across(member: DataFrame, key: str) -> DataFrame:
    """The pairs (a, b) of rows (key, node, root) of equal keys and different roots."""
    one, other = member.select(key, F.col("node").alias("a"), F.col("root").alias("ra")), member.select(key, F.col("node").alias("b"), F.col("root").alias("rb"))
    return one.join(other, key).where("a > b and ra <> rb").select("a", "b")


def _rare_groups(hot: DataFrame, nodes: DataFrame, least: float, scratch: Scratch, pairs_up_to: int) -> DataFrame:
    """(token, node, root, many): hot nodes (node, root) by the rarest values of their signatures; of ``many`` nodes each.

    A value's rarity is the number of hot nodes that have it, those of up to pairs_up_to in the order of a hash.
    """
    need = max(1, math.ceil(least * VALUES - 1e-9))
    rows = scratch.written(hot.distinct().join(nodes, "node").select("node", "root", F.explode(_placed_values(F.col("sig"))).alias("token")), "values")
    often = scratch.written(rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > pairs_up_to), "often")
    ranked = rows.join(often, "token", "left").groupBy("node", "root").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("token").alias("h"), "token"))).alias("all"))
    rare = scratch.written(ranked.select("node", "root", F.explode(F.slice("all", 1, VALUES + 1 - need)).alias("t")).select(F.col("t.token").alias("token"), "node", "root"), "rare")
    size = rare.groupBy("token").agg(F.count("*").alias("many"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    return scratch.written(rare.join(size.select("token", "many"), "token"), "tokens")


def _by_tiles(member: DataFrame, nodes: DataFrame, least: float, tile: int) -> DataFrame:
    """The similar pairs (a, b) of groups (token, node, root, many) by blocks of about ``tile`` nodes against each other."""
    rows = member.join(nodes, "node").withColumn("blocks", F.ceil(F.col("many") / tile).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = rows.select("token", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "node", "root", "sig")
    right = rows.select(F.col("token").alias("t"), F.explode(F.sequence(F.lit(0), "own")).alias("k"), F.col("own").alias("l"), "node", "root", "sig").toDF("t", "k", "l", "right", "side", "mark")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})]
        if len(a) and len(b):
            x, y = (np.frombuffer(b"".join(c), np.uint32).reshape(-1, VALUES) for c in (a["sig"], b["mark"]))
            na, ra, nb, rb = a["node"].to_numpy(), a["root"].to_numpy(), b["right"].to_numpy(), b["side"].to_numpy()
            step = max(1, (1 << 16) // len(y))
            for k in range(0, len(x), step):
                close = (_agreement(x[k : k + step, None], y[None]) >= least) & (ra[k : k + step, None] != rb[None])
                i, j = np.nonzero(close)
                found.append(pd.DataFrame({"a": np.maximum(na[k + i], nb[j]), "b": np.minimum(na[k + i], nb[j])}))
        return pd.concat(found)

    return left.groupBy("token", "i", "j").cogroup(right.groupBy("t", "k", "l")).applyInPandas(compare, "a bigint, b bigint")


def groups(docs: DataFrame, similar: float = SIMILAR, pairs_up_to: int = PAIRS_UP_TO, tile: int = TILE) -> DataFrame:
    """(doc_id, h, node, root) of every row of docs that has words; h is a hash of the text, equal roots are a group."""
    scratch = Scratch()
    key = docs.select("doc_id", F.xxhash64("text").alias("h"), _signature_column(F.col("text")).alias("s"))
    rows = scratch.written(key.select("doc_id", "h", "s.node", "s.sig"), "signatures").where("node is not null")
    nodes = scratch.written(rows.select("node", "sig").dropDuplicates(["node"]), "nodes")
    bands = nodes.select("node", F.explode(_bands_column(F.col("sig"))).alias("band"))
    full = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    member = scratch.written(bands.join(full.select("band", "low").hint("merge"), "band"), "members")
    # signatures of the nodes that share a band with another: the rest never moves again
    some = scratch.written(nodes.join(member.select("node").distinct().hint("merge"), "node", "left_semi"), "paired")
    first = scratch.written(_similar(member.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), some, similar), "alike")
    root = scratch.written(components(first, scratch), "roots")
    # what still lies in different components of a band; its smallest node has been compared with all
    named = member.where("node <> low").join(root, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    size = named.groupBy("band").agg(F.count("*").alias("many"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    mixed = scratch.written(named.join(size.select("band", "many"), "band"), "mixed")
    pairs = _across(mixed.where(F.col("many") <= pairs_up_to), "band")
    hot, tiled = mixed.where(F.col("many") > pairs_up_to).select("node", "root"), None
    if not hot.isEmpty():
        token = _rare_groups(hot, some, similar, scratch, pairs_up_to)
        pairs = pairs.union(_across(token.where(F.col("many") <= pairs_up_to), "token"))
        tiled = _by_tiles(token.where(F.col("many") > pairs_up_to), some, similar, tile)
    second = _similar(pairs.distinct(), some, similar)
    second = scratch.written(second if tiled is None else second.union(tiled), "alike")
    named = second.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
    upper = components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch)
    top = upper.toDF("root", "top")
    known = root.select("node", "root").union(second.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(root, "node", "left_anti").select("node", F.col("node").alias("root")))
    final = known.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    rows = rows.select("doc_id", "h", "node")
    member = rows.join(final, "node", "left").select("doc_id", "h", "node", F.coalesce("root", "node").alias("root"))
    member = written(member, "members")
    scratch.clear()
    return member


def _leaders(member: DataFrame) -> DataFrame:
    """Of each group of two rows or more the row that stays: the smallest doc_id (nulls last), then the smallest text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))).alias("f")
    return member.groupBy("root").agg(first, F.count("*").alias("size")).where("size > 1").select("root", "size", F.col("f.doc_id").alias("keep_id"), F.col("f.h").alias("keep_h"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_a, doc_b): each document of a group beside the one of it that stays, doc_b.

    Groups are the connected components of pairs of which at least ``similar`` of the signature
    values agree and that share a band. The document with the smallest doc_id stays. Null texts and
    texts without a word are in no group; texts under three words are alike only when equal but for
    case and spacing. Repeated rows are members of one group: a row equal to the one that stays gives
    no pair, since both have one doc_id. Rows with a null doc_id join groups, and are the last to
    stay. Equal doc_ids with different texts are different documents. Other columns of docs are
    ignored, whatever their names; an empty table gives an empty result.
    """
    member = groups(docs, similar)
    pairs = member.join(_leaders(member), "root").where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))))
    return pairs.select(F.col("doc_id").alias("doc_a"), F.col("keep_id").alias("doc_b")).distinct()


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each group of :func:`near_duplicates`, with all their columns unchanged.

    Of equal rows one stays, and of rows equal in doc_id and text but not in other columns any one.
    """
    member = groups(docs, similar)
    lead = member.join(_leaders(member), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))
    fate = lead.groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count("*").alias("copies")).where("not stays or copies > 1")
    h, did, fh, state = fresh(docs, "h", "doc", "fh", "state")
    fate = fate.select(F.col("doc_id").alias(did), F.col("h").alias(fh), F.when(F.col("stays"), 1).otherwise(2).alias(state))
    rows = docs.withColumn(h, F.xxhash64("text"))
    # as many decisions as duplicates: they grow with docs, and are never broadcast
    rows = rows.join(written(fate, "fate").hint("merge"), F.col(q("doc_id")).eqNullSafe(F.col(did)) & (F.col(h) == F.col(fh)), "left")
    one = rows.where(F.col(state) == 1).dropDuplicates([did, fh])
    return rows.where(F.col(state).isNull()).union(one).select(*[q(c) for c in docs.columns])
