"""Operator 9: URL filter, gradient-boosted trees on lexical features.

Features are lengths, depth, digit ratio, entropy, counts of parameters and punctuation, and
statistics of the host's suffix: its share of all URLs, counted over the whole table, and its smoothed
rate of bad URLs, counted over all labelled ones. Trees are grown on histograms in numpy, on a bounded
sample of the labelled URLs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, unit_hash, written

#: Labelled URLs of each class that are fitted on, at most about this many.
TRAIN_PER_CLASS = 3000
REJECT_FROM = 0.5
#: A suffix's rate of bad URLs is drawn to that of all by as many labels.
SMOOTHING = 20
#: Parts of the labelled URLs; the trees see a URL's suffix with the rate of the other parts. Were a URL's own label
#: alone left out, the rate itself would tell it: within a suffix it would be lower for the bad ones.
FOLDS = 8
#: Share of the hosts whose URLs the query labels; those of the others are told by their lexical signs alone.
LABELLED_HOSTS = 0.5
#: Registered names of known bad hosts, from which the query takes its labelled URLs.
BAD_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "params", "query_length", "hyphens", "host_hyphens", "labels", "longest_label", "vowel_ratio", "https", "fragment", "odd_ratio", "suffix_share", "suffix_rate")


def suffix_of(url: Column) -> Column:
    """The last two labels of a URL's host, lower case; '' where there is no host."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]*)\.?$", 1)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str) -> list[float]:
    """The features that depend on the URL alone."""
    scheme, host, path, query, fragment = (p or "" for p in _PARTS.match(url).groups())
    host = host.rpartition("@")[2].lower()
    labels = host.split(".")
    digits = sum(map(str.isdigit, url))
    letters = sum(map(str.isalpha, host))
    return [
        len(url), len(host), len(path), path.rstrip("/").count("/"), digits / max(1, len(url)), sum(map(str.isdigit, host)), _entropy(url), _entropy(host),
        len([p for p in query.split("&") if p]), len(query), url.count("-"), host.count("-"), len(labels), max(map(len, labels)),
        sum(host.count(v) for v in "aeiou") / max(1, letters), scheme.lower() == "https", bool(fragment), sum(not c.isalnum() for c in url) / max(1, len(url)),
    ]


class BoostedTrees:
    """Binary trees of fixed depth on binned features, fitted to the logistic loss.

    prior is the rate of ones where x was sampled from, when the classes were kept in other shares than
    they have there: log-odds are shifted by what the sampling put in.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, prior: float | None = None):
        cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
        binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, x.T)], 1)
        self.depth, self.rate = depth, rate
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        self.feature = np.zeros((trees, 2**depth - 1), np.int64)
        self.cut = np.full((trees, 2**depth - 1), np.inf)
        self.value = np.zeros((trees, 2**depth))
        score = np.full(len(y), self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-9
            node = np.zeros(len(y), np.int64)
            for d in range(depth):
                best = np.full(2**d, 1e-6)
                width = 2**d * (bins + 1)
                for f in range(x.shape[1]):
                    at = node * (bins + 1) + binned[:, f]
                    sums = [np.bincount(at, w, width).reshape(2**d, -1).cumsum(1) for w in (g, h, None)]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < least) | (nt - nl < least)] = 0
                    k = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(2**d), k] > best):
                        if k[i] < len(cuts[f]):
                            best[i] = gain[i, k[i]]
                            self.feature[t, 2**d - 1 + i], self.cut[t, 2**d - 1 + i] = f, cuts[f][k[i]]
                at = 2**d - 1 + node
                node = 2 * node + (x[np.arange(len(x)), self.feature[t, at]] > self.cut[t, at])
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            self.value[t] = -gs / (hs + 1)
            score += rate * self.value[t][node]
        if prior is not None:
            self.base += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = 2**d - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            score += self.rate * value[node]
        return 1 / (1 + np.exp(-score))


class UrlModel:
    """Trees, and the rate of bad URLs among all labelled ones, which a suffix without labels gets."""

    def __init__(self, urls: list[str], shares: np.ndarray, labelled: np.ndarray, wrong: np.ndarray, bad: np.ndarray, prior: float):
        """labelled, wrong: labels, and bad ones among them, of each URL's suffix in the other parts."""
        self.prior = prior
        self.trees = BoostedTrees(self.matrix(urls, shares, self.rates(labelled, wrong)), bad.astype(np.float64), prior=prior)

    def rates(self, labelled: np.ndarray, wrong: np.ndarray) -> np.ndarray:
        return (wrong + SMOOTHING * self.prior) / (labelled + SMOOTHING)

    @staticmethod
    def matrix(urls: list[str], shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
        return np.column_stack([np.array([lexical(u) for u in urls], np.float64).reshape(len(urls), -1), shares, rates])

    def probabilities(self, urls: list[str], shares: np.ndarray, labelled: np.ndarray, wrong: np.ndarray) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        return self.trees.probabilities(self.matrix(urls, shares, self.rates(labelled, wrong)))


def _with_suffix(pages: DataFrame) -> DataFrame:
    """(page_id, url, suffix, suffix_share): the share is counted over all rows that have a URL."""
    rows = pages.select("page_id", "url", F.when(F.col("url").rlike("\\S"), suffix_of(F.col("url"))).alias("suffix"))
    # written: its true size is known then, by which Spark broadcasts it or not; suffixes are few and hot
    counts = written(rows.where("suffix is not null").groupBy("suffix").agg(F.count("*").alias("n")), "suffixes")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return rows.join(counts, "suffix", "left").select("page_id", "url", "suffix", (F.col("n") / F.lit(total)).alias("suffix_share"))


def _labels(labelled: DataFrame) -> DataFrame:
    """(u, b, suffix): every labelled URL once; contradicting labels cancel it."""
    known = labelled.select(F.col("url").alias("u"), F.col("bad").cast("int").alias("b")).where(F.col("u").rlike("\\S") & F.col("b").isin(0, 1))
    return known.groupBy("u").agg(F.min("b").alias("b"), F.max("b").alias("z")).where("b = z").select("u", "b", suffix_of(F.col("u")).alias("suffix"))


def _part() -> Column:
    return F.floor(unit_hash(F.col("u"), seed=1) * FOLDS)


def _tallies(known: DataFrame) -> DataFrame:
    """(suffix, labelled, wrong, parts): labels and bad ones of each suffix, over all labelled URLs and by part."""
    bad = F.col("b") == 1
    parts = F.array(*[F.struct(F.count_if(_part() == k).alias("labelled"), F.count_if(bad & (_part() == k)).alias("wrong")) for k in range(FOLDS)])
    return written(known.groupBy("suffix").agg(F.count("*").alias("labelled"), F.count_if(bad).alias("wrong"), parts.alias("parts")), "labels")


def fit(rows: DataFrame, known: DataFrame, tallies: DataFrame, per_class: int = TRAIN_PER_CLASS) -> UrlModel | None:
    """A model whose trees see a bounded sample of the labelled URLs (u, b, suffix); None when a class has none."""
    all_of = tallies.agg(F.sum("labelled").alias("n"), F.sum("wrong").alias("bad")).first()
    if not all_of["bad"] or all_of["bad"] == all_of["n"]:
        return None
    some = bounded_rows(known, "u", "b", per_class)
    shares = rows.where("suffix is not null").groupBy("suffix").agg(F.first("suffix_share").alias("share"))
    own = F.element_at("parts", (_part() + 1).cast("int"))
    some = some.join(tallies, "suffix").select("u", "b", "suffix", (F.col("labelled") - own["labelled"]).alias("labelled"), (F.col("wrong") - own["wrong"]).alias("wrong"))
    some = some.join(shares, "suffix", "left").na.fill({"share": 0.0}).toPandas().sort_values("u")
    if some["b"].nunique() < 2:
        return None
    return UrlModel(some["u"].tolist(), some["share"].to_numpy(), some["labelled"].to_numpy(), some["wrong"].to_numpy(), some["b"].to_numpy() == 1, all_of["bad"] / all_of["n"])


def known_bad(pages: DataFrame, names: tuple[str, ...] = BAD_NAMES, hosts: float = LABELLED_HOSTS) -> DataFrame:
    """(url, bad): URLs of a share of the hosts, chosen by a hash, labelled by a list of registered names of bad hosts."""
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = F.exists(F.split(host, r"\."), lambda s: s.isin(*names))
    return pages.where(F.col("url").isNotNull() & (unit_hash(host, seed=9) < hosts)).select("url", named.cast("int").alias("bad"))


def filter_urls(pages: DataFrame, labelled: DataFrame, reject_from: float = REJECT_FROM) -> DataFrame:
    """(page_id, url, bad_probability, accepted) for every row of pages, learnt from labelled URLs (url, bad: 0 or 1).

    A null or blank URL is no URL: its probability is null and it is not accepted. Anything else is
    scored, malformed and very long URLs too. Equal URLs get equal results, so repeated rows agree;
    a probability equal to reject_from is rejected. Contradicting labels of a URL cancel it. Without
    labelled URLs of both classes nothing can be told apart and every URL has probability 0. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = _with_suffix(pages)
    known = _labels(labelled)
    tallies = _tallies(known)
    sent = pages.sparkSession.sparkContext.broadcast(fit(rows, known, tallies))

    def run(urls: pa.Array, shares: pa.Array, labels: pa.Array, wrong: pa.Array) -> pa.Array:
        model = sent.value
        u = [t or "" for t in urls.to_pylist()]
        if model is None:
            return pa.array(np.zeros(len(u)))
        s, n, k = (np.array([v or 0.0 for v in c.to_pylist()], np.float64) for c in (shares, labels, wrong))
        return pa.array(model.probabilities(u, s, n, k))

    run.__annotations__ = {"urls": pa.Array, "shares": pa.Array, "labels": pa.Array, "wrong": pa.Array, "return": pa.Array}
    rows = rows.join(tallies.drop("parts"), "suffix", "left")
    p = F.when(F.col("suffix").isNotNull(), F.arrow_udf(run, "double")("url", "suffix_share", "labelled", "wrong"))
    got = rows.select("page_id", "url", p.alias("bad_probability"))
    return got.select("page_id", "url", "bad_probability", F.coalesce(F.col("bad_probability") < reject_from, F.lit(False)).alias("accepted"))
