"""Operator 2: mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash. A document's virtual finish time is the running
token count of its source, divided by the source's target weight; in the order of finish times the
sources advance in proportion to their weights until the total budget is spent.

No source is ordered in one task: the hash splits it into as many buckets as each holds documents (the
root of their number), whose token sums give each bucket its offset, and running sums are taken inside
buckets. The cut is found over intervals of finish time, the one in which the budget ends being split again
until it holds few documents, however unevenly the times lie. Within a source finish times ascend with the hash, so the chosen
documents of a source are those up to one last hash, and the texts never move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, q, written

#: Target weights by source; sources not named have DEFAULT_WEIGHT.
TARGET_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
#: Total budget as a share of the input's tokens, used when no number of tokens is given.
BUDGET_SHARE = 0.8
SEED = "mix"
#: Documents that are ordered one by one to find the cut, at most about as many.
ORDERED = 100_000


def tokens(text: Column) -> Column:
    """Tokens of a text: runs of characters other than blank, tab, line feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Place of a document in its source's shuffled order: an MD5 of seed, doc_id and text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def weight_of(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in sorted(weights.items()):
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def _bucket(key: Column, n: Column) -> Column:
    """One of n ascending ranges of the hash."""
    first = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.floor(first * n / F.lit(float(1 << 32))).cast("bigint")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT) -> DataFrame:
    """(doc_id, source, n_tokens, shuffle_key, virtual_finish) of the documents that have tokens and a positive weight."""
    weights = TARGET_WEIGHTS if weights is None else weights
    if not all(0 <= w < math.inf for w in (*weights.values(), default_weight)):
        raise ValueError("weights must be finite and not negative")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"), shuffle_key(F.col("doc_id"), F.col("text")).alias("shuffle_key"))
    rows = written(rows.where((F.col("n_tokens") > 0) & (weight_of(F.col("source"), weights, default_weight) > 0)), "lengths")
    sizes = rows.groupBy("source").agg(F.ceil(F.sqrt(F.count("*"))).alias("buckets"))
    rows = rows.join(sizes, "source").withColumn("bucket", _bucket(F.col("shuffle_key"), F.col("buckets"))).drop("buckets")
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "bucket", before.alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("shuffle_key").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(offsets, ["source", "bucket"])
    done = (F.col("before") + F.col("own")).cast("double") / weight_of(F.col("source"), weights, default_weight)
    return rows.select("doc_id", "source", "n_tokens", "shuffle_key", done.alias("virtual_finish"))


def _chosen(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, budget_tokens: int | None, budget_share: float, ordered: int = ORDERED) -> DataFrame:
    plan = written(schedule(docs, weights, default_weight), "finish")
    finish = F.col("virtual_finish")
    n, total, low, high = plan.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.min(finish), F.max(finish)).first()
    budget = int(total * budget_share) if budget_tokens is None else budget_tokens
    if total <= budget:
        return plan
    # the interval in which the budget ends, by ever narrower ones; all before it fits
    before, inside, spent = F.lit(False), F.lit(True), 0
    while n > ordered and low < high:
        spans = max(2, math.isqrt(n))
        span = F.least(F.floor((finish - F.lit(low)) * F.lit(spans / (high - low))), F.lit(spans - 1)).cast("bigint")
        sums = plan.where(inside).groupBy(span.alias("span")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.min(finish).alias("low"), F.max(finish).alias("high"))
        sums = sums.withColumn("upto", F.sum("t").over(Window.orderBy("span")) + F.lit(spent))
        cut = sums.where(F.col("upto") > budget).orderBy("span").first()
        before, inside = before | (inside & (span < cut["span"])), inside & (span == cut["span"])
        n, low, high, spent = cut["n"], cut["low"], cut["high"], cut["upto"] - cut["t"]
    order = Window.orderBy("virtual_finish", "source", "shuffle_key").rowsBetween(Window.unboundedPreceding, 0)
    fits = plan.where(inside).withColumn("upto", F.sum("n_tokens").over(order) + F.lit(spent)).where(F.col("upto") <= budget).drop("upto")
    return plan.where(before).union(fits)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget_tokens: int | None = None, budget_share: float = BUDGET_SHARE) -> DataFrame:
    """(doc_id, source, n_tokens, virtual_finish) of the documents in the mixture, in the order of finish times.

    The documents are the longest beginning of that order (ties: source, then shuffle key) whose
    tokens fit the budget: budget_tokens, or budget_share of the tokens of the documents that can be
    scheduled. Null and empty texts have no tokens and are not scheduled, nor are documents of a
    source of weight 0. A null source counts as the source ''. Repeated rows are documents of their
    own, one after the other; rows equal in doc_id and text can stand for each other. A very long
    text takes its tokens like any other; if it does not fit, the mixture ends before it. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    chosen = _chosen(docs, weights, default_weight, budget_tokens, budget_share)
    return chosen.select("doc_id", "source", "n_tokens", "virtual_finish").orderBy("virtual_finish", "source", "doc_id")


def keep_mixed(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget_tokens: int | None = None, budget_share: float = BUDGET_SHARE) -> DataFrame:
    """The rows of docs in the mixture of :func:`mix`, with all their columns unchanged.

    The chosen rows of a source are those up to its last chosen shuffle key, so only one small row per
    source is joined. Equal rows at that last key are kept in as many copies as were chosen.
    """
    chosen = written(_chosen(docs, weights, default_weight, budget_tokens, budget_share), "chosen")
    s, key, us, last, many, rank = fresh(docs, "s", "key", "us", "last", "many", "rank")
    top = chosen.groupBy("source").agg(F.max("shuffle_key").alias(last))
    ends = chosen.join(top, "source").where(F.col("shuffle_key") == F.col(last)).groupBy("source", last).agg(F.count("*").alias(many))
    rows = docs.withColumns({s: F.coalesce(F.col(q("source")), F.lit("")), key: shuffle_key(F.col(q("doc_id")), F.col(q("text")))})
    # written: its true size is known then, and docs stay where they are while sources are few
    ends = written(ends.withColumnRenamed("source", us), "ends")
    rows = rows.join(ends, F.col(s) == F.col(us)).where((F.col(key) <= F.col(last)) & (tokens(F.col(q("text"))) > 0))
    at_end = rows.where(F.col(key) == F.col(last)).withColumn(rank, F.row_number().over(Window.partitionBy(s).orderBy(key))).where(F.col(rank) <= F.col(many))
    cols = [q(c) for c in docs.columns]
    return rows.where(F.col(key) < F.col(last)).select(*cols).union(at_end.select(*cols))
