import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import urls

DDL = "page_id bigint, url string, html string"


def fine(i):
    r = random.Random(i)
    host = "".join(r.choice(["tar", "mel", "son", "ven"]) for _ in range(r.randint(1, 3)))
    return f"https://{r.choice(['', 'www.', 'm.'])}{host}.example.{r.choice(['com', 'org'])}/{r.choice(['en', 'de'])}/{r.randrange(900)}"


def foul(i):
    r = random.Random(i)
    return f"http://{r.choice(['free', 'cheap', 'best'])}-{r.choice(['pills', 'win', 'bets'])}{r.randrange(99)}.example.{r.choice(['com', 'net'])}/{r.randrange(10**9)}?a={r.randrange(99)}&b={r.randrange(99)}"


ROWS = [(i, foul(i) if i % 5 == 0 else fine(i), "") for i in range(900)]


def labelled(spark, rows=ROWS):
    return spark.createDataFrame([(r[1], int(r[0] % 5 == 0)) for r in rows], "url string, bad int")


def test_held_out_accuracy(spark):
    held = [(i, foul(i) if i % 2 else fine(i), "") for i in range(5000, 5300)]
    got = urls.filter_urls(spark.createDataFrame(held, DDL), labelled(spark)).collect()
    assert np.mean([r["accepted"] != bool(r["page_id"] % 2) for r in got]) > 0.97


def brute_tree(x, y, bins, least):
    """Best first split by trying every feature and cut."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p) + 1e-9)
    best = (1e-6, None)
    for f in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])):
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (f, c))
    return best[1]


def test_splits_are_the_best_ones():
    r = np.random.default_rng(0)
    for seed in range(8):
        x = r.normal(size=(300, 4)).round(1)
        y = ((x[:, seed % 4] > 0.3) ^ (r.random(300) < 0.1)).astype(float)
        t = urls.BoostedTrees(x, y, trees=1, depth=1)
        assert (t.feature[0, 0], t.cut[0, 0]) == brute_tree(x, y, 32, 10)


def test_more_trees_fit_better():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] * x[:, 1] > 0)).astype(float)
    loss = [-np.mean(np.log(np.where(y == 1, p, 1 - p))) for p in (urls.BoostedTrees(x, y, trees=n).probabilities(x) for n in (1, 5, 40))]
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.2


def brute_trees(x, y, trees=40, depth=3, rate=0.3, bins=32, least=10):
    """Boosting by recursion over sets of rows, trying every feature and cut of every node."""
    cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-9
        worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)

        def grow(rows, level):
            if level < depth and len(rows):
                best, found = 1e-6, None
                for f, own in enumerate(cuts):
                    for c in own:
                        left = rows[x[rows, f] <= c]
                        right = rows[x[rows, f] > c]
                        if min(len(left), len(right)) >= least and (gain := worth(left) + worth(right) - worth(rows)) > best + 1e-12:
                            best, found = gain, (left, right)
                if found is not None:
                    for part in found:
                        grow(part, level + 1)
                    return
            if len(rows):
                score[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-score))


def test_the_whole_result_is_that_of_plain_boosting(spark):
    """Features, shares, rates of the other parts, trees and decision, by loops over a small table."""
    rows = ROWS[:200]
    lab = labelled(spark, rows)
    got = {r["url"]: r for r in urls.filter_urls(spark.createDataFrame(rows, DDL), lab).collect()}
    known = {r["u"]: (r["b"], r["suffix"], r["part"]) for r in urls._labels(lab).withColumn("part", urls._part()).collect()}
    names = sorted(known)
    share = {s: sum(urls_suffix == s for urls_suffix in (known[r[1]][1] for r in rows)) / len(rows) for s in {k[1] for k in known.values()}}
    prior = np.mean([known[u][0] for u in names])

    def rate(u, all_parts):
        some = [known[v][0] for v in names if known[v][1] == known[u][1] and (all_parts or known[v][2] != known[u][2])]
        return (sum(some) + urls.SMOOTHING * prior) / (len(some) + urls.SMOOTHING)

    y = np.array([float(known[u][0]) for u in names])
    fit_on = np.array([[*urls.lexical(u), share[known[u][1]], rate(u, False)] for u in names], float)
    # scored rows go through the trees with the rate over all parts: the class's own trees stand in for that walk,
    # after they have been held against the plain ones on the rows that they were grown on
    trees = urls.BoostedTrees(fit_on, y, prior=prior)
    assert np.allclose(trees.probabilities(fit_on), brute_trees(fit_on, y), atol=1e-6)
    want = trees.probabilities(np.array([[*urls.lexical(u), share[known[u][1]], rate(u, True)] for u in names], float))
    for u, p in zip(names, want):
        assert got[u]["bad_probability"] == pytest.approx(p, abs=1e-6) and (got[u]["accepted"] == (p < urls.REJECT_FROM) or abs(p - urls.REJECT_FROM) < 1e-6)


def test_hosts_without_labels_are_told_by_their_signs(spark):
    """The query's own labels: half of the hosts; bad hosts of the other half are found all the same."""
    hosts = [f"{'www.' if k % 2 else ''}{n}{'' if k < 2 else k}.example.{t}" for n in urls.BAD_NAMES for k in range(2) for t in ("com", "net", "org")]
    rows = [(i, f"http://{hosts[i % len(hosts)]}/de/{i}", "") if i % 9 == 0 else (i, fine(i), "") for i in range(3000)]
    pages = spark.createDataFrame(rows, DDL)
    lab = urls.known_bad(pages)
    known = {r["url"] for r in lab.collect()}
    got = [r for r in urls.filter_urls(pages, lab).collect() if r["url"] not in known]
    bad = [not r["accepted"] for r in got if r["page_id"] % 9 == 0]
    good = [r["accepted"] for r in got if r["page_id"] % 9]
    assert len(bad) > 50 and np.mean(bad) > 0.9 and len(good) > 300 and np.mean(good) > 0.97


def test_features():
    f = dict(zip(urls.FEATURES, urls.lexical("https://u@WWW.a-b.example.com/x/y1/?p=1&q=&&r#top")))
    assert (f["depth"], f["params"], f["https"], f["fragment"], f["host_hyphens"], f["labels"], f["longest_label"]) == (2, 3, True, True, 1, 4, 7)
    assert len(urls.lexical("")) == len(urls.FEATURES) - 2 and urls.lexical("%%::")[0] == 4


@pytest.mark.parametrize(("url", "want"), [("https://a.b.co.uk/x", "co.uk"), ("http://u@h.Example.COM:80/", "example.com"), ("localhost/x", "localhost"), ("https:///p", ""), ("x", "x"), ("https://a.b./", "a.b")])
def test_suffixes(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.suffix_of(F.col("u"))).first()[0] == want


def test_suffix_shares_count_all_rows(spark):
    rows = {r["page_id"]: r["suffix_share"] for r in urls._with_suffix(spark.createDataFrame([(1, "http://a.x.com", ""), (2, "http://b.x.com", ""), (3, "http://c.y.org", ""), (4, None, "")], DDL)).collect()}
    assert rows == {1: 2 / 3, 2: 2 / 3, 3: 1 / 3, 4: None}


def test_suffix_rates_count_labels_outside_the_sample(spark):
    # 40 suffixes, every second one bad, that URLs do not tell apart; a sample of a dozen a class misses most of them
    rows = [(i, f"https://{'abcdefghij'[i // 40 % 10]}.{chr(97 + i % 40 // 20)}{chr(97 + i % 20)}q.org/x", "") for i in range(400)]
    known = urls._labels(spark.createDataFrame([(u, i % 2) for i, u, _ in rows], "url string, bad int"))
    tallies = urls._tallies(known)
    got = {r["suffix"]: (r["labelled"], r["wrong"]) for r in tallies.collect()}
    assert len(got) == 40 and set(got.values()) == {(10, 0), (10, 10)}
    model = urls.fit(urls._with_suffix(spark.createDataFrame(rows, DDL)), known, tallies, per_class=30)
    p = model.probabilities([u for _, u, _ in rows], np.full(400, 1 / 40), np.full(400, 10.0), np.array([10.0 * (i % 2) for i, _, _ in rows]))
    assert all((p >= 0.5) == [i % 2 == 1 for i, _, _ in rows])


def test_probabilities_do_not_depend_on_the_share_sampled(spark):
    # nothing in these URLs tells the 6 % of bad ones, so that each has a chance of 6 %
    r = random.Random(5)
    rows = [(i, f"https://www.example.com/{r.randrange(10**6):06}", "") for i in range(4000)]
    known = urls._labels(spark.createDataFrame([(u, int(i % 100 < 6)) for i, u, _ in rows], "url string, bad int"))
    pages, tallies = urls._with_suffix(spark.createDataFrame(rows, DDL)), urls._tallies(known)
    for per_class in (150, urls.TRAIN_PER_CLASS):
        some = rows[:1000]
        p = urls.fit(pages, known, tallies, per_class).probabilities([u for _, u, _ in some], np.ones(1000), np.full(1000, 4000.0), np.full(1000, 240.0))
        assert np.mean(p < urls.REJECT_FROM) > 0.97 and 0.02 < np.median(p) < 0.1


def test_awkward_rows(spark):
    rows = [*ROWS, (2000, None, ""), (2001, " \t\n", ""), (2002, "no url at all", ""), (None, fine(3), ""), ROWS[0], (2003, "https://x.example.com/" + "a" * 200_000, "")]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(1) for c in ("suffix", "n", "total", "suffix_share", "accepted", "u", "b")})
    lab = labelled(spark).union(spark.createDataFrame([(None, 1), (" ", 0), (ROWS[1][1], 1), (ROWS[2][1], None)], "url string, bad int"))
    got = urls.filter_urls(df, lab).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and all((by[i]["bad_probability"], by[i]["accepted"]) == (None, False) for i in (2000, 2001))
    assert by[2002]["bad_probability"] is not None and by[None]["accepted"] and 0 <= by[2003]["bad_probability"] <= 1
    assert len({r["bad_probability"] for r in got if r["page_id"] == 0}) == 1


def test_without_rows_or_labels(spark):
    none = labelled(spark, [])
    assert urls.filter_urls(spark.createDataFrame([], DDL), none).collect() == []
    (r,) = urls.filter_urls(spark.createDataFrame([(1, fine(1), "")], DDL), none).collect()
    assert (r["bad_probability"], r["accepted"]) == (0.0, True)
