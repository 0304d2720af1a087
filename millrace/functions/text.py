"""Kind conversions and Unicode string functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..errors import Fault, InvalidArg
from .kernel import ANY, BYTES, STR, Kernel, as_bytes

#: Characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _decode(b: bytes) -> str:
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Fault(f"invalid utf-8 sequence of bytes from index {e.start}") from None


def utf8() -> Kernel:
    def native(c):
        text = F.try_validate_utf8(c.cast("string"))
        return text, F.when(c.isNotNull() & text.isNull(), F.lit("utf8: invalid utf-8 sequence"))

    return Kernel("utf8", BYTES, "string", _decode, native)


def to_bytes() -> Kernel:
    return Kernel("bytes", STR, "binary", lambda s: s.encode("utf-8", "surrogatepass"), lambda c: (c.cast("binary"), None))


def lowercase() -> Kernel:
    return Kernel("lowercase", STR, "string", str.lower, lambda c: (F.lower(c), None))


def uppercase() -> Kernel:
    return Kernel("uppercase", STR, "string", str.upper, lambda c: (F.upper(c), None))


def trim() -> Kernel:
    return Kernel("trim", STR, "string", lambda s: s.strip(WHITE), lambda c: (F.btrim(c, F.lit(WHITE)), None))


def normalize(form: str) -> Kernel:
    if form not in FORMS:
        raise InvalidArg(f"normalize: unknown form '{form}' (expected NFC|NFD|NFKC|NFKD)")
    return Kernel("normalize", STR, "string", lambda s: unicodedata.normalize(form, s))


def byte_len() -> Kernel:
    return Kernel("byteLen", ANY, "int", lambda v: len(as_bytes(v)), lambda c: (F.octet_length(c), None))
