"""Operator 1: language identification with interpolated Kneser-Ney character models.

Each language has one model of character n-grams (order 4 by default). The seen n-grams of every
order are kept as 64-bit hashes in a sorted array beside their fully interpolated probabilities
and the weight that their context gives to the next lower order. For scoring, the languages'
top-order arrays are merged into one sorted hash array with a probability per language, so that a
character costs one binary search; n-grams that no language has seen take the exact recursion.

A text gets the language of the lowest cross-entropy per character. It is rejected when that
cross-entropy is above the language's limit, which is calibrated on held-out texts: half way between
those of the language itself and those of the other languages, wider for short texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, code_points, released, segment_sums, slices

ORDER = 4
#: Labelled texts of each language that are fitted on, at most about this many.
TRAIN_PER_LANGUAGE = 400
#: Languages that have a model; of more, those of the most labelled rows.
MOST_LANGUAGES = 200
#: Share of held-out texts left out at either side when a limit is calibrated.
FALSE_REJECTION = 0.001
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Code point to symbol of 16 bits: lower case for letters and marks of all planes, a space for the rest.

    Unicode has more letters than 16 bits can number, but few that a language is told by: those of the basic plane
    stand for themselves. Those above it are folded into the surrogates' range, which no text holds, by a hash of their
    code point, so that the letters of one script stay apart but for chance.
    """
    out = np.full(0x110000, 32, np.uint16)
    for c in (*range(0x40000), *range(0xE0000, 0xE0200)):  # Unicode has no letters and marks elsewhere
        s = chr(c)
        if s.isalpha() or unicodedata.category(s)[0] == "M":
            low = s.lower()
            c = ord(low) if len(low) == 1 else c
            out[ord(s)] = c if c < 0x10000 else 0xD800 + (c * 0x9E3779B1 >> 7) % 0x800
    return out


_LETTERS: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each led by one space, runs of spaces as one; and the end of each."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    cp, ends = code_points([" " + t for t in texts])
    sym = _LETTERS[0][cp]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
    starts = np.concatenate(([0], ends[:-1]))
    keep[starts] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    return sym[keep], before[ends]


def grams(sym: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """For each position, the symbol and the order - 1 before it (spaces before a text's start), packed."""
    at = np.arange(len(sym)) - np.repeat(np.concatenate(([0], ends[:-1])), np.diff(np.concatenate(([0], ends))))
    key = sym.astype(np.uint64)
    for back in range(1, order):
        prev = np.full(len(sym), 32, np.uint64)
        prev[back:] = sym[: len(sym) - back]
        prev[at < back] = 32
        key |= prev << np.uint64(16 * back)
    return key


def hashed(key: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys, so that different n-grams never collide."""
    x = key * _MIX
    return x ^ (x >> np.uint64(32))


@dataclass
class HashArray:
    """Values by n-gram: hashes in ascending order, and a column of values for each."""

    hashes: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashArray:
        h = hashed(keys)
        o = np.argsort(h)
        return HashArray(h[o], values[o])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and whether they are there."""
        h = hashed(keys)
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == h


class KneserNey:
    """Interpolated Kneser-Ney over packed character n-grams."""

    def __init__(self, keys: np.ndarray, order: int = ORDER, alphabet: int = 0):
        self.order = order
        mask = lambda n: np.uint64((1 << (16 * n)) - 1)
        found, counts = np.unique(keys, return_counts=True)
        levels = {order: (found, counts.astype(np.float64))}
        for n in range(order - 1, 0, -1):
            found, counts = np.unique(levels[n + 1][0] & mask(n), return_counts=True)
            levels[n] = (found, counts.astype(np.float64))
        self.alphabet = max(alphabet, len(levels[1][0])) + 1
        self.prob: dict[int, HashArray] = {}
        self.back: dict[int, HashArray] = {}
        for n in range(1, order + 1):
            k, c = levels[n]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            if n == 1:
                total = c.sum()
                self.floor = d * len(k) / total / self.alphabet
                p = (c - d) / total + self.floor
            else:
                ctx, inv, fan = np.unique(k >> np.uint64(16), return_inverse=True, return_counts=True)
                total = np.bincount(inv, c)
                weight = d * fan / total
                p = (c - d) / total[inv] + weight[inv] * self.probability(k & mask(n - 1), n - 1)
                self.back[n] = HashArray.of(ctx, weight)
            self.prob[n] = HashArray.of(k, p)

    def probability(self, keys: np.ndarray, n: int | None = None) -> np.ndarray:
        """P(last symbol | those before it) of packed n-grams."""
        n = self.order if n is None else n
        at, there = self.prob[n].find(keys)
        out = np.where(there, self.prob[n].values[at], 0.0)
        if (miss := np.flatnonzero(~there)).size:
            if n == 1:
                out[miss] = self.floor
            else:
                left = keys[miss]
                at, there = self.back[n].find(left >> np.uint64(16))
                weight = np.where(there, self.back[n].values[at], 1.0)
                out[miss] = weight * self.probability(left & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
        return out


class LanguageModels:
    """The models of all languages, the merged array for scoring, and the calibration."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, false_rejection: float = FALSE_REJECTION):
        self.order = order
        self.names = sorted(k for k, v in texts.items() if any(v))
        fit, held = {}, {}
        for name in self.names:
            own = [t for t in texts[name] if t]
            held[name] = own[::5] if len(own) >= 10 else own
            fit[name] = [t for i, t in enumerate(own) if i % 5] if len(own) >= 10 else own
        keys = {name: grams(*symbols(fit[name]), order) for name in self.names}
        alphabet = len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k in keys.values()]))) if keys else 0
        self.models = [KneserNey(keys[name], order, alphabet) for name in self.names]
        union = np.unique(np.concatenate([np.unique(k) for k in keys.values()])) if keys else np.zeros(0, np.uint64)
        self.joint = HashArray.of(union, self._log(union).astype(np.float32))
        # limits: half way between what the language's own held-out texts need at most and what the
        # other languages' held-out texts need at least; short texts are allowed their larger spread
        self.limit = np.full(len(self.names), np.inf)
        self.spread = np.zeros(len(self.names))
        scored = [self.entropies(held[name]) for name in self.names]
        scored = [(h[n > 0], n[n > 0]) for h, n in scored]
        for i in range(len(self.names)):
            h, n = scored[i][0][:, i], scored[i][1]
            if not len(h):
                continue
            mean = np.average(h, weights=np.sqrt(n))
            self.spread[i] = np.sqrt(np.mean((h - mean) ** 2 * n))
            own = np.quantile(h - 3 * self.spread[i] / np.sqrt(n), 1 - false_rejection)
            others = [g[:, i] for j, (g, _) in enumerate(scored) if j != i and len(g)]
            other = np.quantile(np.concatenate(others), false_rejection) if others else 0.0
            self.limit[i] = (max(own, mean) + other) / 2 if other > max(own, mean) else 1.5 * max(own, mean)

    def _log(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.log2(m.probability(keys)) for m in self.models], 1) if self.models else np.zeros((len(keys), 0))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text in each language, and the number of symbols that are letters."""
        sym, ends = symbols(texts)
        keys = grams(sym, ends, self.order)
        at, there = self.joint.find(keys)
        lp = self.joint.values[at] if len(self.joint.values) else np.zeros((len(keys), len(self.names)), np.float32)
        if (miss := np.flatnonzero(~there)).size:
            some, inv = np.unique(keys[miss], return_inverse=True)
            lp[miss] = self._log(some)[inv]
        size = np.diff(np.concatenate(([0], ends)))
        letters = segment_sums((sym != 32).astype(np.int64), ends).astype(np.int64)
        return -segment_sums(lp, ends) / np.maximum(size, 1)[:, None], letters

    def decide(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cross-entropy and acceptance of each text."""
        if not self.names:
            return [None] * len(texts), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        limit = self.limit[best] + 3 * self.spread[best] / np.sqrt(np.maximum(n, 1))
        return [self.names[b] if k else None for b, k in zip(best, n)], np.where(n > 0, low, np.nan), (n > 0) & (low <= limit)


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, order: int = ORDER) -> LanguageModels:
    """Models from a bounded sample of the rows whose ``lang`` is known; whole texts."""
    known = docs.select(F.col("doc_id").alias("k"), F.col("lang").alias("l"), F.col("text").alias("t")).where("l is not null and t is not null")
    rows = bounded_rows(known, ("k", "t"), "l", per_language, classes=MOST_LANGUAGES).toPandas()
    texts = {name: part.sort_values(["k", "t"])["t"].tolist() for name, part in rows.groupby("l")}
    return LanguageModels(texts, order)


RESULT = "struct<predicted_lang string, cross_entropy double, accepted boolean>"


def language(models: LanguageModels):
    """A column function text -> struct(predicted_lang, cross_entropy, accepted)."""
    sent = None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for a, b in slices(texts, SLICE_BYTES):
                names, bits, ok = models_of().decide([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(bits, mask=np.isnan(bits)), pa.array(ok)], ["predicted_lang", "cross_entropy", "accepted"])

    def models_of() -> LanguageModels:
        return sent.value if sent is not None else models

    def column(text):
        nonlocal sent
        from pyspark import SparkContext

        if sent is None:
            sent = SparkContext._active_spark_context.broadcast(models)
        return F.arrow_udf(released(run), RESULT)(text)

    return column


def identify(docs: DataFrame, models: LanguageModels | None = None) -> DataFrame:
    """(doc_id, lang, predicted_lang, cross_entropy, accepted) for every row of docs.

    Null, empty and letterless texts have no language: predicted_lang and cross_entropy are null
    and accepted is false. Letters are those of all planes, with the marks that go with them. The same text always gets the same answer, so repeated rows agree; a tie
    between languages goes to the first name. Of more labels than MOST_LANGUAGES those of the most rows have
    models, and the texts of the others are judged by these. Without labelled rows every text is rejected. Other
    columns of docs are ignored, whatever their names; an empty table gives an empty result.
    """
    models = models or fit(docs)
    got = docs.select("doc_id", "lang", language(models)(F.col("text")).alias("r"))
    return got.select("doc_id", "lang", "r.predicted_lang", "r.cross_entropy", "r.accepted")


def keep_identified(docs: DataFrame, models: LanguageModels | None = None) -> DataFrame:
    """The rows of docs whose text is accepted, with all their columns unchanged."""
    models = models or fit(docs)
    return docs.where(language(models)(F.col("text")).getField("accepted"))
