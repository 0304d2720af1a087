"""Token counting, truncation and chunking with byte-level BPE vocabularies."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import tiktoken

from ..errors import InvalidArg
from .kernel import STR, Kernel

_GPT2 = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CL100K = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
_O200K = "|".join(
    [
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
#: Folder of rank files ``<encoding>.tiktoken``; the environment's name for it, and the folder it has by default.
FOLDER_VARIABLE, FOLDER = "MILLRACE_ENCODINGS", "/opt/tokenizers"
#: cl100k_base and o200k_base need their rank files in the folder; they are never stood in for by others.
KEEP = ("start", "end")
PATTERNS = {"cl100k_base": _CL100K, "o200k_base": _O200K, "byte_bpe_50k": _GPT2, "byte_bpe_multi_50k": _GPT2}


def _path(encoding: str) -> str:
    return os.path.join(os.environ.get(FOLDER_VARIABLE, FOLDER), f"{encoding}.tiktoken")


def _known(op: str, encoding: str) -> str:
    if encoding not in PATTERNS:
        raise InvalidArg(f"{op}: unknown encoding '{encoding}': expected 'cl100k_base' or 'o200k_base', or a configured one")
    if not os.path.exists(_path(encoding)):
        raise InvalidArg(f"{op}: the rank file of encoding '{encoding}' is not at {_path(encoding)}; set {FOLDER_VARIABLE} to its folder")
    return encoding


@lru_cache(maxsize=4)
def encoder(encoding: str) -> tiktoken.Encoding:
    """One encoder for each encoding in a Python worker."""
    with open(_path(encoding), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(encoding, pat_str=PATTERNS[encoding], mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def lengths(encoding: str) -> np.ndarray:
    """Bytes of each token."""
    enc = encoder(encoding)
    out = np.zeros(enc.n_vocab, np.int64)
    for token, i in enc._mergeable_ranks.items():
        out[i] = len(token)
    return out


def _ids(encoding: str, s: str) -> np.ndarray:
    return encoder(encoding).encode_to_numpy(s, disallowed_special=())


def _whole(op: str, name: str, value, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value != int(value):
        raise InvalidArg(f"{op}: {name} must be an integer, got {value}")
    if value < least:
        raise InvalidArg(f"{op}: {name} must be >= {least}, got {int(value)}")
    return int(value)


def count_tokens(encoding: str) -> Kernel:
    _known("countTokens", encoding)
    return Kernel("countTokens", STR, "int", lambda s: len(_ids(encoding, s)))


def truncate_tokens(encoding: str, max_tokens: int, keep: str | None = None) -> Kernel:
    """The first or last tokens as a clean part of the text: a character cut in two is left out."""
    _known("truncateTokens", encoding)
    most = _whole("truncateTokens", "maxTokens", max_tokens, 1)
    keep = "start" if keep is None else keep
    if keep not in KEEP:
        raise InvalidArg(f"truncateTokens: keep must be {' or '.join(map(repr, KEEP))}, got '{keep}'")

    def run(s: str) -> str:
        ids = _ids(encoding, s)
        if len(ids) <= most:
            return s
        raw, size = s.encode("utf-8", "replace"), lengths(encoding)
        cut = raw[: int(size[ids[:most]].sum())] if keep == "start" else raw[len(raw) - int(size[ids[-most:]].sum()) :]
        return cut.decode("utf-8", "ignore")

    return Kernel("truncateTokens", STR, "string", run)


def chunks(s: str, encoding: str, most: int, overlap: int) -> list[str]:
    """Windows of tokens, their edges drawn back to whole characters; empty ones are dropped."""
    raw = s.encode("utf-8", "replace")
    at = [0, *np.cumsum(lengths(encoding)[_ids(encoding, s)]).tolist()]

    def whole(i: int) -> int:
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    out, start, last = [], 0, len(at) - 1
    while last:
        end = min(start + most, last)
        a, b = whole(at[start]), whole(at[end])
        if a < b:
            out.append(raw[a:b].decode("utf-8"))
        if end == last:
            break
        start += most - overlap
    return out


def chunk_by_tokens(encoding: str, max_tokens: int, overlap: int | None = None) -> Kernel:
    """JSON text of the list of windows."""
    _known("chunkByTokens", encoding)
    most = _whole("chunkByTokens", "maxTokens", max_tokens, 1)
    overlap = 0 if overlap is None else _whole("chunkByTokens", "overlap", overlap, 0)
    if overlap >= most:
        raise InvalidArg(f"chunkByTokens: overlap must be >= 0 and < maxTokens, got {overlap}")
    return Kernel("chunkByTokens", STR, "string", lambda s: json.dumps(chunks(s, encoding, most, overlap), ensure_ascii=False, separators=(",", ":")))
