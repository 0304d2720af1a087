"""Operator 3: quality classifier on random-indexing word vectors.

Fitting uses a bounded sample of labelled documents. Every word type has a sparse random index
vector; a word's vector is the sum of the index vectors of the words beside it in the sample. A
document is pooled to the mean and the mean square of its words' vectors, and to the mean inner
product of neighbouring words' normalised index vectors (taken as 1 for equal words, else 0). A two-layer network
in numpy gives a probability, whose temperature is calibrated on held-out documents. Words that
the sample has too rarely share the vector of their shape ("Ul*" for capital, small letters, stars).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, released, segment_sums, slices

DIM, NONZERO, WINDOW, HIDDEN = 32, 8, 2, 24
#: Labelled documents of each class that are fitted on, at most about this many.
TRAIN_PER_CLASS = 1500
#: Documents of the sample that a word must be in to have a vector of its own.
LEAST_COUNT = 3
#: Pooled values of a text of this many words are drawn half way to the average text's.
SHRINK = 10
#: A document is rejected when its calibrated probability of being good is below this.
KEEP_FROM = 0.3
SLICE_BYTES = 1 << 20
GATHERED = 50_000
MANY_RUNS = 12
_CACHE, _REMEMBERED_LENGTH = 100_000, 64


def shape(word: str) -> str:
    """Runs of capitals as U, of small letters as l, of digits as 0, of another character as itself.

    A word of more than MANY_RUNS runs goes by the binary length of their number.
    """
    if word.isalpha():
        if word.islower():
            return "l"
        if word[1:].islower() and word[0].isupper():
            return "Ul"
    out = []
    for c in word:
        k = "U" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= MANY_RUNS else f"~{len(out).bit_length()}"


def _index_vector(name: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(name))
    out = np.zeros(DIM, np.float32)
    out[rng.choice(DIM, NONZERO, replace=False)] = np.repeat([1.0, -1.0], NONZERO // 2)
    return out


class _Ids(dict):
    """Word to vector number; words not fitted go by their shape, and are remembered up to a bound."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]):
        super().__init__(words)
        self.shapes, self.most = shapes, len(words) + _CACHE

    def __missing__(self, word: str) -> int:
        found = self.shapes.get(shape(word), 0)
        if len(self) < self.most and len(word) <= _REMEMBERED_LENGTH:
            self[word] = found
        return found


class QualityModel:
    """Word vectors, network and temperature."""

    def __init__(self, texts: list[str], good: np.ndarray, seed: int = 0):
        held = np.arange(len(texts)) % 5 == 0
        fit = ~held if held.any() and len(set(good[~held])) == 2 else np.ones(len(texts), bool)
        held = held if (fit != True).any() else fit  # noqa: E712
        self._vectors([t for t, f in zip(texts, fit) if f])
        x = self.pooled(texts)
        self.centre, self.scale = x[fit, 1:].mean(0), x[fit, 1:].std(0) + 1e-6
        self._network(self._inputs(x), good.astype(np.float64), fit, seed)
        self.temperature = 1.0
        z, y = self._logit(x[held]), good[held]
        at = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
        loss = [np.mean(np.logaddexp(0, np.where(y, -z, z) / t)) for t in at]
        self.temperature = float(at[int(np.argmin(loss))])
        self.held_accuracy = float(np.mean((z > 0) == y))

    def _vectors(self, texts: list[str]) -> None:
        # by documents, not by times: else the repetitive texts of the sample would know their words, and no others
        count = Counter(w for t in texts for w in set(t.split()))
        known = sorted(w for w, n in count.items() if n >= LEAST_COUNT)
        shapes = sorted({s for s, n in Counter(shape(w) for w in count).items() if n >= LEAST_COUNT})
        self.words = {w: i + 1 for i, w in enumerate(known)}
        self.shapes = {s: i + 1 + len(known) for i, s in enumerate(shapes)}
        index = np.stack([np.zeros(DIM, np.float32), *map(_index_vector, [f"w{w}" for w in known] + [f"s{s}" for s in shapes])])
        # a known word lends its neighbours its shape's index vector too, a rare one has that alone
        for w, i in self.words.items():
            index[i] += index[self.shapes.get(shape(w), 0)]
        ids, context, seen = _Ids(self.words, self.shapes), np.zeros(index.shape, np.float64), np.zeros(len(index))
        for t in texts:
            ws = t.split()
            v = np.fromiter(map(ids.__getitem__, ws), np.int64, len(ws))
            around = np.zeros((len(v), DIM), np.float32)
            for d in range(1, WINDOW + 1):
                if len(v) > d:
                    around[d:] += index[v[:-d]]
                    around[:-d] += index[v[d:]]
            np.add.at(context, v, around + index[v])
            np.add.at(seen, v, 1)
        e = context / np.maximum(seen, 1)[:, None]
        self.table = np.concatenate([e, e * e], 1).astype(np.float32)

    def pooled(self, texts: list[str], ids: _Ids | None = None) -> np.ndarray:
        """Number of words, and pooled mean, mean square and share of words equal to the one before them."""
        ids = ids or _Ids(self.words, self.shapes)
        out, a = np.zeros((len(texts), 2 + 2 * DIM)), 0
        while a < len(texts):
            # some texts at a time: the rows gathered for them stay small
            flat, n, b = [], [], a
            while b < len(texts) and sum(n) < GATHERED:
                ws = texts[b].split()
                n.append(len(ws))
                out[b, 0] = len(ws)
                out[b, -1] = sum(map(eq, ws, islice(ws, 1, None)))
                flat.append(np.fromiter(map(ids.__getitem__, ws), np.int64, len(ws)))
                b += 1
            out[a:b, 1:-1] = segment_sums(self.table[np.concatenate(flat)], np.cumsum(n))
            a = b
        out[:, 1:] /= np.maximum(out[:, :1], 1)
        return out

    def _inputs(self, pooled: np.ndarray) -> np.ndarray:
        """Standardised, and drawn to the centre where few words were pooled."""
        return (pooled[:, 1:] - self.centre) / self.scale * (pooled[:, :1] / (pooled[:, :1] + SHRINK))

    def _network(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray, seed: int, epochs: int = 60) -> None:
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        weight = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6))
        rows = np.flatnonzero(fit)
        for _ in range(epochs):
            for b in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
                h = np.tanh(x[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) * weight[b] / len(b)
                dh = d[:, None] * p[2] * (1 - h * h)
                step += 1
                for i, g in enumerate((x[b].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = p

    def _logit(self, x: np.ndarray) -> np.ndarray:
        x = self._inputs(x)
        return np.tanh(x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def probabilities(self, texts: list[str], ids: _Ids | None = None) -> np.ndarray:
        """Calibrated probability of good quality."""
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._logit(self.pooled(texts, ids)) / self.temperature, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> QualityModel | None:
    """A model from a bounded sample of labelled documents, whole texts; None when a class has none.

    A doc_id with contradicting labels is left out; of several texts under one doc_id the one of the smallest hash
    is fitted on. The sample's ids, bounded by the parameter, are broadcast to one pass over the texts.
    """
    own = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    own = own.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y")
    some = bounded_rows(own, "k", "y", per_class).toPandas()
    if some["y"].nunique() < 2:
        return None
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(list(some.itertuples(index=False, name=None)), own.schema))
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).where("t is not null").join(picked, "k")
    # one text of an id, whatever their number: what reaches the driver stays bounded
    rows = rows.groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("o"), F.first("y").alias("y")).select("k", "y", "o.t").toPandas().sort_values("k")
    if rows["y"].nunique() < 2:
        return None
    return QualityModel(rows["t"].tolist(), rows["y"].to_numpy() == 1)


def good_probability(spark, model: QualityModel | None):
    """A column function text -> calibrated probability of good quality."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        ids = _Ids(model.words, model.shapes) if model else None
        for texts in batches:
            for a, b in slices(texts, SLICE_BYTES):
                some = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                yield pa.array(model.probabilities(some, ids) if model else np.ones(len(some)))

    blank = lambda text: text.isNull() | ~text.rlike("\\S")
    made = F.arrow_udf(released(run), "double")
    return lambda text: F.when(blank(text), F.lit(0.0)).otherwise(made(text))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, good_probability, accepted) for every row of docs.

    Null texts and texts without a word have probability 0. Equal texts get equal results, so
    repeated rows agree; a probability equal to keep_from is accepted. Rows without doc_id are
    scored, but never fitted on; ids may be of any type. Words are read whole, however long. Without labels of both classes nothing can be told apart and every
    text with words has probability 1. Other columns of docs are ignored, whatever their names; an
    empty table gives an empty result.
    """
    model = fit(docs, labels, per_class)
    got = docs.select("doc_id", good_probability(docs.sparkSession, model)(F.col("text")).alias("good_probability"))
    return got.select("doc_id", "good_probability", (F.col("good_probability") >= keep_from).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that :func:`classify` accepts, with all their columns unchanged."""
    model = fit(docs, labels, per_class)
    return docs.where(good_probability(docs.sparkSession, model)(F.col("text")) >= keep_from)
