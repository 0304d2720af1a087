"""Hashes and checksums: lower-case hex of bytes, or of a string's UTF-8 bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import xxhash
from pyspark.sql import functions as F

from .kernel import ANY, Kernel, as_bytes


def _hex_kernel(op: str, digest, native=None, batch=None, stream=None) -> Kernel:
    return Kernel(op, ANY, "string", lambda v: digest(as_bytes(v)), native, batch=batch, stream=stream)


#: Bytes of a file that are read at a time: whole subtrees of BLAKE3 and blocks of CRC-32C.
_READ = 1 << 20


def _blocks(f: BinaryIO) -> Iterator[bytes]:
    """Blocks of _READ bytes of an open file; the last is what is left."""
    while block := f.read(_READ):
        yield block


def _updated(make):
    """The digest of an open file by a hash object."""

    def run(f: BinaryIO) -> str:
        h = make()
        for block in _blocks(f):
            h.update(block)
        return h.hexdigest()

    return run


def _summed(f: BinaryIO, step, start: int) -> int:
    for block in _blocks(f):
        start = step(block, start)
    return start


def sha256() -> Kernel:
    return _hex_kernel("sha256Hex", lambda b: hashlib.sha256(b).hexdigest(), lambda c: (F.sha2(c.cast("binary"), 256), None), stream=_updated(hashlib.sha256))


# -- BLAKE3 (one-shot hash of the published specification)

_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF


def _schedules() -> list[tuple[int, ...]]:
    out, now = [], tuple(range(16))
    for _ in range(7):
        out.append(now)
        now = tuple(now[i] for i in _ORDER)
    return out


_ROUNDS = _schedules()
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


#: Bytes hashed at a time.
_AT_ONCE = 4 << 20


def _rotated(x: np.ndarray, n: int, spare: np.ndarray) -> None:
    """x rotated right by n bits, in place."""
    np.left_shift(x, np.uint32(32 - n), out=spare)
    np.right_shift(x, np.uint32(n), out=x)
    np.bitwise_or(x, spare, out=x)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of n blocks of words (16, n)."""
    n = cv.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = cv
    v[8:12] = np.array(_IV[:4], np.uint32)[:, None]
    v[12], v[13] = counter & _M, counter >> 32
    v[14], v[15] = size, flags
    spare = np.empty(n, np.uint32)
    for order in _ROUNDS:
        for lane, (a, b, c, d) in enumerate(_LANES):
            va, vb, vc, vd = v[a], v[b], v[c], v[d]
            for word, (r1, r2) in ((order[2 * lane], (16, 12)), (order[2 * lane + 1], (8, 7))):
                va += vb
                va += words[word]
                vd ^= va
                _rotated(vd, r1, spare)
                vc += vd
                vb ^= vc
                _rotated(vb, r2, spare)
    return v[:8] ^ v[8:]


def blake3_digests(items: list[bytes]) -> list[str]:
    """Hex of the 32-byte BLAKE3 hash of each item.

    Chunks of 1 KiB are the leaves of a left-full binary tree; the chunks of all items, and then the parents
    of each level, are compressed side by side.
    """
    out: list[str] = []
    a = 0
    while a < len(items):
        b, room = a, _AT_ONCE
        while b < len(items) and (b == a or room > 0):
            room -= max(1024, len(items[b]))
            b += 1
        out += _digests(items[a:b])
        a = b
    return out


def _digests(items: list[bytes]) -> list[str]:
    return _hexes(_roots(items))


def _hexes(cv: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.ascontiguousarray(cv.T).astype("<u4")]


def _roots(items: list[bytes], at: int | None = None) -> np.ndarray:
    """Chaining values (8, n) of the items' trees: of whole ones, or of one item that is the subtree from chunk ``at`` of a larger."""
    root = _ROOT if at is None else 0
    chunks = np.array([max(1, -(-len(b) // 1024)) for b in items])
    data = np.frombuffer(b"".join(b.ljust(int(n) * 1024, b"\0") for b, n in zip(items, chunks)), "<u4").reshape(-1, 16, 16)
    total = int(chunks.sum())
    first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    number = np.arange(total) - np.repeat(first, chunks) + (at or 0)
    size = np.full(total, 1024)
    size[first + chunks - 1] = [len(b) - 1024 * (int(n) - 1) for b, n in zip(items, chunks)]
    blocks = np.maximum(1, -(-size // 64))
    alone = np.repeat(np.where(chunks == 1, root, 0), chunks)
    cv = np.repeat(np.array(_IV, np.uint32)[:, None], total, 1)
    for j in range(int(blocks.max())):
        on = np.flatnonzero(blocks > j)
        last = blocks[on] == j + 1
        flags = np.where(j == 0, _CHUNK_START, 0) | np.where(last, _CHUNK_END | alone[on], 0)
        cv[:, on] = _compress(cv[:, on], np.ascontiguousarray(data[on, j].T), number[on], np.minimum(64, size[on] - 64 * j), flags)
    return _joined(cv, chunks, root)


def _joined(cv: np.ndarray, counts: np.ndarray, root: int) -> np.ndarray:
    """The trees over runs of nodes: neighbours are joined level by level, an odd one out goes up as it is."""
    while counts.max() > 1:
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        place = np.arange(cv.shape[1]) - np.repeat(first, counts)
        mate = (place % 2 == 0) & (place + 1 < np.repeat(counts, counts))
        left = np.flatnonzero(mate)
        flags = np.where(np.repeat(counts, counts)[left] == 2, _PARENT | root, _PARENT)
        iv = np.repeat(np.array(_IV, np.uint32)[:, None], len(left), 1)
        cv[:, left] = _compress(iv, np.concatenate([cv[:, left], cv[:, left + 1]]), np.zeros(len(left), np.int64), np.full(len(left), 64), flags)
        cv = cv[:, place % 2 == 0]
        counts = (counts + 1) // 2
    return cv


def _blake3_file(f: BinaryIO) -> str:
    """Blocks are whole subtrees of the file's tree, all but the last full; their 32 bytes each are kept and joined at the end."""
    block, after, nodes = f.read(_READ), f.read(_READ), []
    if not after:
        return blake3_digests([block])[0]
    while block:
        nodes.append(_roots([block], len(nodes) * (_READ // 1024)))
        block, after = after, f.read(_READ)
    return _hexes(_joined(np.concatenate(nodes, axis=1), np.array([len(nodes)]), _ROOT))[0]


def blake3() -> Kernel:
    return _hex_kernel("blake3Hex", lambda b: blake3_digests([b])[0], batch=lambda vs: blake3_digests([as_bytes(v) for v in vs]), stream=_blake3_file)


def xxh3() -> Kernel:
    return _hex_kernel("xxh3Hex", xxhash.xxh3_64_hexdigest, stream=_updated(xxhash.xxh3_64))


#: Spark's XXH64 starts from seed 42, and hashes each of its arguments with the hash of the one before as seed: that of this number is 0.
_TO_SEED_ZERO = -365884300664092260


def xxh64() -> Kernel:
    native = lambda c: (F.when(c.isNotNull(), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(_TO_SEED_ZERO).cast("bigint"), c.cast("binary"))), 16, "0"))), None)
    return _hex_kernel("xxh64Hex", lambda b: xxhash.xxh64_hexdigest(b, 0), native, stream=_updated(xxhash.xxh64))


def crc32() -> Kernel:
    return _hex_kernel("crc32Hex", lambda b: f"{zlib.crc32(b):08x}", lambda c: (F.lower(F.lpad(F.hex(F.crc32(c.cast("binary"))), 8, "0")), None), stream=lambda f: f"{_summed(f, zlib.crc32, 0):08x}")


#: Bytes of a CRC-32C block, for each of whose places there is a table.
_BLOCK = 2048


def _castagnoli() -> np.ndarray:
    """[k, b]: what byte b does to the state, k bytes before the end of a block."""
    out = np.empty((_BLOCK, 256), np.uint32)
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = n >> np.uint32(1) ^ np.where(n & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    out[0] = n
    for k in range(1, _BLOCK):
        out[k] = out[k - 1] >> np.uint32(8) ^ out[0][out[k - 1] & np.uint32(0xFF)]
    return out


_CRC32C: list[np.ndarray] = []


def crc32c_value(data: bytes, before: int = 0) -> int:
    """The bytes' contributions are independent of each other, so a block is one gather and one reduction. ``before``: the value of what precedes."""
    if not _CRC32C:
        _CRC32C.append(_castagnoli())
    table, crc = _CRC32C[0], before ^ _M
    places = np.arange(_BLOCK - 1, -1, -1)
    for i in range(0, len(data), _BLOCK):
        block = np.frombuffer(data[i : i + _BLOCK], np.uint8)
        if len(block) < 4:
            for b in block.tolist():
                crc = crc >> 8 ^ int(table[0][(crc ^ b) & 0xFF])
            continue
        block = block.copy()
        block[:4] ^= np.frombuffer(crc.to_bytes(4, "little"), np.uint8)
        crc = int(np.bitwise_xor.reduce(table[places[-len(block) :], block]))
    return crc ^ _M


def crc32c() -> Kernel:
    return _hex_kernel("crc32cHex", lambda b: f"{crc32c_value(b):08x}", stream=lambda f: f"{_summed(f, crc32c_value, 0):08x}")
