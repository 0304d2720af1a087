import base64
import random

import numpy as np
import pytest
import tiktoken
from helpers import crowded, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe

ODD = ["", "a" * 3000, "aaaaaaa ", "  \n\n  x", "日本語😀👨‍👩‍👧", "\x00\x1c\x85", "it's 's 'll don't", "x²½Ⅷ٣ 12", "<|endoftext|>", "é" * 99]


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def pair(request):
    path = f"/opt/tokenizers/{request.param}.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.vocabulary(path), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(pair, texts):
    v, other = pair
    ids, counts = bpe.Encoder(v).encode(iter([texts]))
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [other.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids, counts, v) == [t.encode() for t in texts]


def test_ids_are_those_of_a_public_encoder(pair):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghilmnorstu", k=r.randint(1, 14))) for _ in range(3000)]
    check(pair, ODD + [" ".join(r.choices(words, k=200)) for _ in range(30)])


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(max_size=30), max_size=4))
def test_any_text(pair, texts):
    check(pair, texts)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2100, exclude_categories=["Cs"]), max_size=20))
def test_the_fast_pattern_splits_alike(text):
    import regex

    assert bpe.splitter()(text) == regex.findall(bpe.PATTERN, text)


def test_merging_is_lowest_rank_first_by_brute_force():
    r = random.Random(9)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 330:
        token = b"".join(r.choice([*list(ranks)[256:], b"a", b"b", b"c"]) for _ in range(2))
        ranks.setdefault(token, len(ranks))

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            some = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not some:
                return [ranks[p] for p in parts]
            _, i = min(some)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    v = bpe.Vocabulary.__new__(bpe.Vocabulary)
    v.ids, v.size, v._merge = ranks, len(ranks), {}
    v.bytes = list(ranks)
    v.single = np.arange(256)
    words = ["".join(r.choices("abc", k=r.randint(1, 25))).encode() for _ in range(400)]
    tokens, ends = bpe.merge_words(words, v)
    at = np.concatenate(([0], ends))
    assert [tokens[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(w) for w in words]


def test_forgetting_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "MERGED_AT_ONCE", 3)
    monkeypatch.setattr(bpe, "DECODED_AT_ONCE", 2)
    v, other = pair
    e = bpe.Encoder(v)
    for t in ["one two three four five six", "seven eight", "one two"]:
        assert e.encode(iter([[t]]))[0].tolist() == other.encode_ordinary(t)
    check(pair, ODD)


def test_unknown_ids(pair):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.decode(np.array([10**6]), np.array([1]), pair[0])


def test_on_a_table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "x y"), (0, ""), (91, "lorem ipsum " * 40_000)]
    docs = crowded(frame(spark, rows))
    got = bpe.encode_documents(docs).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got if r["doc_id"] != 90)
    by = {r["doc_id"]: r for r in got}
    assert (by[90]["token_ids"], by[90]["n_tokens"], by[90]["round_trip"]) == (None, None, None)
    assert by[0]["token_ids"] == [] and all(r["n_tokens"] == len(r["token_ids"]) for r in got if r["doc_id"] != 90)
    out = bpe.with_tokens(docs)
    assert [c for c in out.columns if c not in ("token_ids", "n_tokens")] == [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    back = out.select("doc_id", "text", bpe.decoded(F.col("token_ids")).alias("again")).collect()
    assert all(r["text"] == r["again"] for r in back)
    assert bpe.encode_documents(frame(spark, [])).collect() == [] and bpe.with_tokens(frame(spark, [])).collect() == []
