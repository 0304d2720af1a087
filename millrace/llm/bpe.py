"""Operator 5: byte-level BPE encoding and decoding with a public vocabulary of ranks.

Encoding works on a pair occurrence index. The distinct words that a partition has not met yet are
laid out one after another as bytes; the index maps each pair of neighbouring tokens to all its
positions. The lowest active rank is taken next, merged at all its positions at once, and the lists
of the pairs to the left and right are updated. Every word then keeps its tokens for the rest of the
partition, and a text is the concatenation of its words' tokens.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, q, released, slices

#: Ranks in the form "base64 token, rank" by line; the path is a parameter, the file is read where tasks run.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 1 << 18
#: Bytes of text whose new words share an index, about; more of a batch comes after it.
ENCODED_AT_ONCE = 1 << 22
#: Words remembered in a partition; beyond it the memory starts anew, which changes no result.
REMEMBERED = 250_000
MERGED_AT_ONCE = 200_000
DECODED_AT_ONCE = 300_000
MERGES_REMEMBERED = 250_000


class Vocabulary:
    """Token bytes by id, ids by token bytes, and the table that decoding gathers from."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.ids.values(), default=-1) + 1
        self.bytes = [b""] * self.size
        for b, i in self.ids.items():
            self.bytes[i] = b
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1])).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._merge: dict[int, int] = {}

    def merge(self, pair: int) -> int:
        """Rank, which is the id, of the token that a pair (left << 32 | right) joins to; -1 if it joins to none."""
        found = self._merge.get(pair)
        if found is None:
            found = self.ids.get(self.bytes[pair >> 32] + self.bytes[pair & 0xFFFFFFFF], -1)
            if len(self._merge) < MERGES_REMEMBERED:
                self._merge[pair] = found
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a path, read once in a Python worker."""
    return Vocabulary(path)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words one after another, and the end of each word, by the pair occurrence index."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    token = v.single[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    n = len(token)
    if not n:
        return token, ends
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends[size > 0] - 1] = n
    prv[(ends - size)[size > 0]] = -1
    lists: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[tuple[int, int]] = []

    def add(positions: np.ndarray) -> None:
        """Enter the pairs that begin at the positions into the index."""
        positions = positions[nxt[positions] < n]
        if not len(positions):
            return
        pair = (token[positions].astype(np.int64) << 32) | token[nxt[positions]]
        if len(pair) == 1:
            groups = [(int(pair[0]), positions)]
        else:
            order = np.argsort(pair, kind="stable")
            pair, positions = pair[order], positions[order]
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist()]
            groups = [(k, positions[a:b]) for k, a, b in zip(pair[cuts].tolist(), cuts, [*cuts[1:], len(pair)])]
        for key, at in groups:
            if (rank := v.merge(key)) >= 0:
                if key not in lists:
                    heapq.heappush(heap, (rank, key))
                lists[key].append(at)

    add(np.arange(n, dtype=np.int32))
    while heap:
        rank, key = heapq.heappop(heap)
        at = lists.pop(key)
        at = np.sort(np.concatenate(at)) if len(at) > 1 else at[0]
        left, right = key >> 32, key & 0xFFFFFFFF
        # positions may be out of date: a neighbour's merge has taken one of the two tokens
        at = at[token[at] == left]
        at = at[nxt[at] < n]
        at = at[token[nxt[at]] == right]
        if left == right and len(at) > 1:
            at = _leftmost(at, nxt)
        if not len(at):
            continue
        second = nxt[at]
        token[at], token[second] = rank, -1
        after = nxt[second]
        nxt[at] = after
        inner = after < n
        prv[after[inner]] = at[inner]
        before = prv[at]
        fresh_left = before >= 0
        fresh_left[1:] &= before[1:] != at[:-1]  # that token is a merged one itself
        add(np.concatenate([before[fresh_left], at]))
    alive = token >= 0
    return token[alive], np.cumsum(np.bincount(word[alive], minlength=len(words)))


def _leftmost(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of positions whose pairs overlap in runs, every second one from the left of each run."""
    joined = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(joined, 0, place))
    return at[(place - start) % 2 == 0]


#: The pattern for texts of these characters alone, of which none is a number but the ASCII digits.
_PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]").search


def splitter(pattern: str = PATTERN):
    """text -> words, by the pattern; Latin texts go through an equal pattern of the faster engine."""
    full = regex.compile(pattern).findall
    return (lambda t: full(t) if _NOT_PLAIN(t) else _PLAIN(t)) if pattern == PATTERN else full


class _Numbers(dict):
    """Words to numbers in the order of their first coming; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes the texts of a partition, remembering the tokens of every word met."""

    def __init__(self, v: Vocabulary, pattern: str = PATTERN):
        self.v, self.split = v, splitter(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Merge the words that are new, many at a time: the more share an index, the fewer steps each costs."""
        new, self.known.new = self.known.new, []
        for k in range(0, len(new), MERGED_AT_ONCE):
            tokens, ends = merge_words([w.encode("utf-8", "surrogatepass") for w in new[k : k + MERGED_AT_ONCE]], self.v)
            self.ends = np.concatenate([self.ends, ends + self.ends[-1]])
            self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)])

    def encode(self, parts: Iterator[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts of all parts one after another, and the number of tokens of each text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        seen, many = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for texts in parts:
            words = list(map(self.split, texts))
            many.append(np.fromiter(map(len, words), np.int64, len(words)))
            seen.append(np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int32, int(many[-1].sum())))
        self._learn()
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at, n in zip(seen, many):
            start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
            upto = np.concatenate(([0], np.cumsum(size)))
            ids.append(self.tokens[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)])
            counts.append(np.diff(upto[np.concatenate(([0], np.cumsum(n)))]))
        return np.concatenate(ids), np.concatenate(counts)


def decode(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[bytes]:
    """Bytes of each of the token lists that lie one after another."""
    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
        raise ValueError("a token id is not in the vocabulary")
    out: list[bytes] = []
    last = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    a = 0
    while a < len(counts):
        # some texts at a time: the gathered places take eight times the text
        b = max(a + 1, int(np.searchsorted(last, last[a] + DECODED_AT_ONCE, side="right")) - 1)
        some = ids[last[a] : last[b]]
        size = v.length[some]
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = v.flat[np.arange(upto[-1]) + np.repeat(v.start[some] - upto[:-1], size)].tobytes()
        ends = upto[last[a + 1 : b + 1] - last[a]]
        out += [flat[x:y] for x, y in zip([0, *ends[:-1]], ends)]
        a = b
    return out


def _encoding(path: str, pattern: str, check: bool):
    """An Arrow UDF text -> token ids, with ``check`` -> struct(ids, same): whether decoding gives the text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path)
        encoder = Encoder(v, pattern)
        for batch in batches:
            for x, y in slices(batch, ENCODED_AT_ONCE):
                texts = batch.slice(x, y - x)
                ids, n = encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()] for a, b in slices(texts, SLICE_BYTES))
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids), mask=texts.is_null())
                if not check:
                    yield lists
                    continue
                same = np.zeros(len(texts), bool)
                for a, b in slices(texts, SLICE_BYTES):
                    own = [(t or "").encode("utf-8") for t in texts.slice(a, b - a).to_pylist()]
                    same[a:b] = [u == w for u, w in zip(own, decode(ids[at[a] : at[b]], n[a:b], v))]
                yield pa.StructArray.from_arrays([lists, pa.array(same, mask=texts.is_null().to_numpy(zero_copy_only=False))], ["ids", "same"])

    return F.arrow_udf(released(run), "struct<ids array<int>, same boolean>" if check else "array<int>")


def encoded(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """text -> array<int> of token ids; null for null."""
    return _encoding(path, pattern, False)(text)


def decoded(ids: Column, path: str = VOCABULARY) -> Column:
    """array<int> of token ids -> text (bytes that are no UTF-8 become U+FFFD); null for null."""

    def run(lists: pa.Array) -> pa.Array:
        v = vocabulary(path)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.diff(lists.offsets.to_numpy())
        out = decode(flat, np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, counts), v)
        return pa.array([b.decode("utf-8", "replace") for b in out], pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) for every row of docs; round_trip: decoding gives the text.

    Texts are ordinary text throughout: strings of special tokens are not special. A null text has
    null token_ids, n_tokens and round_trip; an empty one has no tokens. Lone surrogates cannot occur in Spark
    strings. Very long words and texts are merged whole. Repeated rows stay, with equal results, and
    rows with a null doc_id are encoded like others. Other columns of docs are ignored, whatever
    their names; an empty table gives an empty result.
    """
    got = docs.select("doc_id", _encoding(path, PATTERN, True)(F.col("text")).alias("r"))
    size = F.when(F.col("r.ids").isNotNull(), F.size("r.ids"))
    return got.select("doc_id", F.col("r.ids").alias("token_ids"), size.alias("n_tokens"), F.col("r.same").alias("round_trip"))


def with_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with all its columns and token_ids, n_tokens; columns of docs of those names are replaced."""
    (ids,) = fresh(docs, "ids")
    got = docs.withColumn(ids, encoded(F.col(q("text")), path))
    kept = [F.col(q(c)) for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")]
    return got.select(*kept, F.col(ids).alias("token_ids"), F.when(F.col(ids).isNotNull(), F.size(ids)).alias("n_tokens"))
