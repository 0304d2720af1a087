"""The pipeline, and the corpus queries through the entry module."""

import base64
import hashlib
import random
import re
from pathlib import Path

import pytest
import tiktoken
from helpers import DOCS_DDL, documents
from test_langid import plain_decisions
from test_neardup import brute_groups
from test_quality import bad, brute_probability, good

import __spark_entry__
import corpus_pipeline
from millrace.llm import bpe, langid, mixing, neardup, quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, good(i) if i % 4 else bad(i), "en", f"src{i % 4}") for i in range(240)]
    rows += [(1000 + i, rows[1][1], "en", "src1") for i in range(10)] + [(2000, None, "en", "src0"), (2001, "", "en", "src0"), (None, good(77), "en", None), rows[2]]
    rows += [(3000 + i, "".join(random.Random(i).choices("жшщыъэ ", k=300)), None, "src2") for i in range(5)]
    spark.createDataFrame(documents(rows), DOCS_DDL).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(bool(r[0] % 4)), 0) for r in rows[:240]], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_run_equals_the_operators_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    left = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)
    schema = docs.schema

    def rebuilt(rows):
        keep = set(rows)
        out = [r for r in docs.collect() if (r["doc_id"], r["text"], r["source"]) in keep]
        # rows that were repeated come once each here
        return spark.createDataFrame([tuple(r) for r in dict.fromkeys(out)], schema)

    # stage by stage, each on what the one before kept, against the operator's own decisions
    one = quality.keep_good(docs, labels)
    p = {r["doc_id"]: r["accepted"] for r in quality.classify(docs, labels).collect()}
    assert left(one) == left(docs.where("false").union(one)) and {d for d, *_ in left(one)} == {d for d, ok in p.items() if ok}
    two = langid.keep_identified(one)
    ok = {r["doc_id"]: r["accepted"] for r in langid.identify(one).collect()}
    assert {d for d, *_ in left(two)} == {d for d, k in ok.items() if k}
    three = neardup.keep_one(two)
    gone = {r["doc_a"] for r in neardup.near_duplicates(two).collect()}
    assert {d for d, *_ in left(three)} == {d for d, *_ in left(two)} - gone
    four = mixing.keep_mixed(rebuilt(left(three)))
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == [*columns, "token_ids", "n_tokens"]
    assert left(final) == left(four)
    v = bpe.vocabulary(bpe.VOCABULARY)
    for r in final.collect():
        assert b"".join(v.bytes[i] for i in r["token_ids"]).decode() == r["text"] and r["n_tokens"] == len(r["token_ids"])
    ids = {d for d, *_ in left(final)}
    assert not ids & {2000, 2001, *range(3000, 3005), *range(0, 240, 4)} and sum(i in ids for i in [1, *range(1000, 1010)]) <= 1
    assert len({d for d, *_ in left(three)} & set(range(240))) >= 170


def test_run_equals_a_version_by_plain_loops(spark, sf_dir):
    """Every stage by loops over rows in memory; of the operators only the fitted quality model is taken over."""
    from collections import defaultdict

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if r[1] and r[1].split() and brute_probability(model, r[1]) >= quality.KEEP_FROM]
    decided = plain_decisions([r[:3] for r in rows if r[2]], {r[1] for r in rows})
    rows = [r for r in rows if decided[r[1]][2]]
    groups = defaultdict(list)
    for root, r in zip(brute_groups(rows, 0.5), rows):
        groups[root].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    key = lambda r: hashlib.md5(f"{mixing.SEED}|{'' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()
    size = lambda r: len(re.findall("[^ \t\n\r]+", r[1]))
    paced = []
    for s in {r[3] or "" for r in rows}:
        spent = 0
        for r in sorted((r for r in rows if (r[3] or "") == s), key=key):
            spent += size(r)
            paced.append((spent / mixing.TARGET_WEIGHTS.get(s, mixing.DEFAULT_WEIGHT), s, key(r), r))
    budget, spent, want = int(sum(map(size, rows)) * mixing.BUDGET_SHARE), 0, []
    for *_, r in sorted(paced, key=lambda p: p[:3]):
        spent += size(r)
        if spent > budget:
            break
        want.append(r)
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r["doc_id"], r["text"], r["source"], list(r["token_ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert len(want) > 50 and sorted(got, key=repr) == sorted(((r[0], r[1], r[3], enc.encode_ordinary(r[1])) for r in want), key=repr)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [f.split()[0] for f in DOCS_DDL.split(", ")]


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS_DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parents[2]
    for p in [*root.glob("millrace/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import)\s+[\w.]*llm", p.read_text(), re.M), p
    for p in [*root.glob("millrace/llm/*.py"), root / "corpus_pipeline.py"]:
        assert "ImportError" not in p.read_text() and "localCheckpoint" not in p.read_text()
