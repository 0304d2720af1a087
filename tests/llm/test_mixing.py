import pyarrow as pa
import pytest
from helpers import DOCS, crowded, dicts, documents, duck, frame, same_rows
from pyspark.sql import functions as F

from millrace.llm import mixing, queries


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(["w"] * (1 + i % 9)), "en", f"src{i % 5 if i % 3 else 0}") for i in range(3000)]
    out += [(5000, None, "en", "src1"), (5001, "", "en", "src1"), (5002, "a b", "en", None), (None, "a b c", None, "src2"), (5003, "long " * 3000, "en", "src3")]
    return out + out[:20] + [(1, "other text", "en", "src1")] * 3


def test_sql_says_the_same(spark, rows):
    table = pa.table(list(map(list, zip(*documents(rows)))), schema=DOCS)
    got = mixing.mix(crowded(frame(spark, rows)))
    assert same_rows(dicts(got), duck(queries.ORACLE_SQL["op2_mixing"], documents=table))


def test_finish_times_ascend_and_shares_follow_weights(spark, rows):
    got = mixing.mix(frame(spark, rows), budget_share=0.3).collect()
    times = [r["virtual_finish"] for r in got]
    assert times == sorted(times)
    spent = {}
    for r in got:
        spent[r["source"]] = spent.get(r["source"], 0) + r["n_tokens"]
    assert spent["src0"] / spent["src1"] == pytest.approx(2, rel=0.05) and spent["src1"] / spent["src4"] == pytest.approx(2, rel=0.05)


@pytest.mark.parametrize("budget", [0, 1, 500, 10**9])
def test_the_rows_kept_are_those_of_the_mixture(spark, rows, budget):
    docs = crowded(frame(spark, rows))
    mixed = mixing.mix(docs, budget_tokens=budget).collect()
    kept = mixing.keep_mixed(docs, budget_tokens=budget)
    assert kept.columns == docs.columns
    left = kept.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), mixing.tokens(F.col("text")).alias("n")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["source"], r["n"]) for r in left))) == sorted(map(repr, ((r["doc_id"], r["source"], r["n_tokens"]) for r in mixed)))
    assert sum(r["n"] for r in left) <= budget


def test_weights(spark, rows):
    docs = frame(spark, rows)
    assert {r["source"] for r in mixing.mix(docs, weights={"src0": 1}, default_weight=0).collect()} == {"src0"}
    assert {r["source"] for r in mixing.keep_mixed(docs, weights={"src0": 1}, default_weight=0).select("source").collect()} == {"src0"}
    for w in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="negative"):
            mixing.mix(docs, weights={"src0": w})
        with pytest.raises(ValueError, match="negative"):
            mixing.mix(docs, default_weight=w)


@pytest.mark.parametrize("ordered", [1, 50, 10**6])
def test_the_cut_is_the_same_however_often_intervals_are_split(spark, rows, ordered):
    """One source of tiny weight stretches the times to millions of times the others'."""
    docs = frame(spark, rows)
    weights = {"src0": 4.0, "src1": 2.0, "src2": 1e-6}
    key = lambda df: sorted((r["virtual_finish"], r["source"], r["shuffle_key"], r["doc_id"] or -1) for r in df.collect())
    plan = key(mixing.schedule(docs, weights))
    size = {r["shuffle_key"]: r["n_tokens"] for r in mixing.schedule(docs, weights).collect()}
    for budget in (0, 1, 700, 9000, sum(size[p[2]] for p in plan) - 1):
        want, spent = [], 0
        for p in plan:
            spent += size[p[2]]
            if spent > budget:
                break
            want.append(p)
        assert key(mixing._chosen(docs, weights, 1.0, budget, 0.0, ordered)) == want


def test_equal_rows_at_the_cut(spark):
    docs = frame(spark, [(1, "a b", "en", "s")] * 10)
    assert mixing.mix(docs, budget_tokens=7).count() == 3 and mixing.keep_mixed(docs, budget_tokens=7).count() == 3


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).collect() == [] and mixing.keep_mixed(frame(spark, [])).collect() == []
    assert mixing.mix(frame(spark, [(1, None), (2, " ")])).collect() == []
