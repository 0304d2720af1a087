"""Token counting, truncation and chunking."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import InvalidArg, batch
from millrace.functions import KERNELS, tokens

ENC = "byte_bpe_50k"
TEXTS = ["The quick brown fox. " * 20, "🎉👨‍👩‍👧" * 10, "東京タワーへ行く。" * 15, "déjà vu à Noël " * 25, "", "<|endoftext|>"]


def test_counts_on_the_cluster(spark):
    enc = tokens.encoder(ENC)
    assert batch("countTokens", TEXTS, ENC, spark=spark) == [len(enc.encode_ordinary(t)) for t in TEXTS]


@pytest.mark.parametrize("keep", ["start", "end"])
@pytest.mark.parametrize("most", [1, 3, 7, 20])
def test_truncation_is_a_clean_part_within_the_budget(keep, most):
    for t in TEXTS:
        cut = KERNELS["truncateTokens"](ENC, most, keep).item(t)
        assert t.startswith(cut) if keep == "start" else t.endswith(cut)
        whole = tokens.encoder(ENC).encode_ordinary(t)
        if len(whole) <= most:
            assert cut == t
        assert len(cut.encode()) <= len(b"".join(tokens.encoder(ENC).decode_tokens_bytes(whole[:most] if keep == "start" else whole[-most:])))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_chunks_without_overlap_join_to_the_text(text, most):
    assert "".join(json.loads(KERNELS["chunkByTokens"](ENC, most).item(text))) == text


def test_overlapping_chunks(spark):
    text = TEXTS[0]
    (out,) = batch("chunkByTokens", [text], ENC, 12, 4, spark=spark)
    parts, ids = json.loads(out), tokens.encoder(ENC).encode_ordinary(text)
    assert parts == [tokens.encoder(ENC).decode(ids[i : i + 12]) for i in range(0, len(ids) - 4, 8)]
    assert KERNELS["chunkByTokens"](ENC, 5).item("") == "[]"


@pytest.mark.parametrize("args", [("nope", 5), (ENC, 0), (ENC, 1.5), (ENC, 5, "middle")])
def test_options(args):
    with pytest.raises(InvalidArg, match="truncateTokens"):
        KERNELS["truncateTokens"](*args)


@pytest.mark.parametrize("overlap", [-1, 5, 9])
def test_overlap(overlap):
    with pytest.raises(InvalidArg, match="overlap"):
        KERNELS["chunkByTokens"](ENC, 5, overlap)


def test_a_named_encoding_is_never_stood_in_for(monkeypatch, tmp_path):
    monkeypatch.setenv(tokens.FOLDER_VARIABLE, str(tmp_path))
    with pytest.raises(InvalidArg, match="cl100k_base"):
        KERNELS["countTokens"]("cl100k_base")


def test_windows_by_table_are_those_by_token_bytes():
    import random

    enc = tokens.encoder(ENC)
    assert tokens.lengths(ENC).tolist() == [len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)]
    r = random.Random(3)
    for _ in range(40):
        t = "".join(r.choices(["word ", "é", "日本", "👩‍👩‍👧", "\n", "12", " x"], k=r.randint(0, 60)))
        ids = enc.encode_ordinary(t)
        assert tokens._ids(ENC, t).tolist() == ids
        for most in (1, 3, 7):
            cut = b"".join(enc.decode_tokens_bytes(ids[:most])).decode("utf-8", "ignore") if len(ids) > most else t
            assert tokens.truncate_tokens(ENC, most).item(t) == cut
            assert "".join(tokens.chunks(t, ENC, most, 0)) == t
