"""Compression and encodings."""

from __future__ import annotations

import base64
import binascii
import re
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ..errors import Fault, InvalidArg
from .kernel import ANY, BYTES, STR, Kernel, as_bytes, faulty


def integer(name: str, value, low: int, high: int | None, message: str) -> int:
    """An option that must be a whole number in a range."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value != int(value):
        raise InvalidArg(f"{name} must be an integer, got {value}")
    if value < low or (high is not None and value > high):
        raise InvalidArg(f"{message}, got {int(value)}")
    return int(value)


def gzip(level: int | None = None) -> Kernel:
    level = integer("gzip: level", 6 if level is None else level, 0, 9, "gzip: level must be 0-9")

    def run(b: bytes) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        return c.compress(b) + c.flush()

    return Kernel("gzip", BYTES, "binary", run)


def _gunzip(b: bytes) -> bytes:
    out = []
    try:
        while True:
            d = zlib.decompressobj(31)
            out.append(d.decompress(b) + d.flush())
            if not d.eof:
                raise Fault("unexpected end of file")
            b = d.unused_data
            if not b:
                return b"".join(out)
            if b[:2] != b"\x1f\x8b":
                raise Fault("trailing garbage after gzip stream")
    except zlib.error as e:
        raise Fault("invalid gzip header" if not out else str(e)) from None


def gunzip() -> Kernel:
    return Kernel("gunzip", BYTES, "binary", _gunzip)


def zstd_compress(level: int | None = None) -> Kernel:
    level = integer("zstdCompress: level", 3 if level is None else level, 1, 22, "zstdCompress: level must be 1-22")
    return Kernel("zstdCompress", BYTES, "binary", lambda b: zstandard.ZstdCompressor(level=level).compress(b))


def _unzstd(b: bytes) -> bytes:
    out = []
    try:
        while b:
            d = zstandard.ZstdDecompressor().decompressobj()
            out.append(d.decompress(b))
            if not d.eof:
                raise Fault("incomplete frame")
            b = d.unused_data
    except zstandard.ZstdError as e:
        raise Fault(str(e)) from None
    return b"".join(out)


def zstd_decompress() -> Kernel:
    return Kernel("zstdDecompress", BYTES, "binary", _unzstd)


def brotli_compress(quality: int | None = None, lgwin: int | None = None) -> Kernel:
    """lgwin is checked; the codec at hand picks the window itself, and any window decodes alike."""
    quality = integer("brotliCompress: quality", 5 if quality is None else quality, 0, 11, "brotliCompress: quality must be 0-11")
    integer("brotliCompress: lgwin", 22 if lgwin is None else lgwin, 10, 24, "brotliCompress: lgwin must be 10-24")
    return Kernel("brotliCompress", BYTES, "binary", lambda b: pa.Codec("brotli", compression_level=quality).compress(b, asbytes=True))


def _unbrotli(b: bytes) -> bytes:
    if not b:
        raise Fault("unexpected end of stream")
    try:
        out = pa.CompressedInputStream(pa.BufferReader(b), "brotli").read()
    except (OSError, pa.ArrowException) as e:
        raise Fault(str(e)) from None
    return out


def brotli_decompress() -> Kernel:
    return Kernel("brotliDecompress", BYTES, "binary", _unbrotli)


def base64_encode() -> Kernel:
    """Standard alphabet with padding. Spark breaks lines unless told not to, so breaks are taken out again."""
    return Kernel("base64Encode", ANY, "string", lambda v: base64.b64encode(as_bytes(v)).decode(), lambda c: (F.translate(F.base64(c.cast("binary")), "\r\n", ""), None))


_QUAD = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\Z")
_BARE = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2,3})?\Z")
_PADDED = re.compile(r"[^=]*={0,2}")


def _unbase64(s: str) -> bytes:
    parts = [s + "=" * (-len(s) % 4)] if "=" not in s and _BARE.match(s) else [m for m in _PADDED.findall(s) if m]
    out = []
    for p in parts:
        if not _QUAD.match(p):
            raise Fault("invalid base64")
        data = base64.b64decode(p)
        if base64.b64encode(data).decode() != p:
            raise Fault("non-zero trailing bits")
        out.append(data)
    return b"".join(out)


def base64_decode() -> Kernel:
    """Padded or unpadded, canonical only; padded streams may follow one another."""
    return Kernel("base64Decode", STR, "binary", _unbase64)


def hex_encode() -> Kernel:
    return Kernel("hexEncode", ANY, "string", lambda v: as_bytes(v).hex(), lambda c: (F.lower(F.hex(c.cast("binary"))), None))


def _unhex(s: str) -> bytes:
    try:
        return binascii.unhexlify(s)
    except (ValueError, binascii.Error):
        raise Fault("invalid hex") from None


def hex_decode() -> Kernel:
    return Kernel("hexDecode", STR, "binary", _unhex, lambda c: faulty("hexDecode", c.rlike(r"^([0-9A-Fa-f]{2})*\z"), F.unhex(c), "invalid hex", c))
