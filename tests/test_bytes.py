"""Hashes, checksums, compression and encodings."""

import base64
import gzip
import hashlib
import zlib

import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import InvalidArg, ItemError, batch
from millrace.errors import Fault
from millrace.functions import KERNELS

PARAGRAPH = "Zwölf Boxkämpfer 🥊 jagen Viktor. " * 300
SAMPLES = [b"", b"abc", PARAGRAPH.encode(), bytes(range(256)) * 41]


def item(op, *args, **options):
    return KERNELS[op](*args, **options).item


@pytest.mark.parametrize(
    ("op", "want"),
    [
        ("sha256Hex", lambda b: hashlib.sha256(b).hexdigest()),
        ("xxh3Hex", lambda b: xxhash.xxh3_64_hexdigest(b)),
        ("xxh64Hex", lambda b: xxhash.xxh64_hexdigest(b)),
        ("crc32Hex", lambda b: f"{zlib.crc32(b):08x}"),
        ("hexEncode", bytes.hex),
        ("base64Encode", lambda b: base64.b64encode(b).decode()),
    ],
)
def test_digests_on_the_cluster(spark, op, want):
    assert batch(op, SAMPLES, spark=spark) == [want(b) for b in SAMPLES]


def test_published_vectors():
    blake = item("blake3Hex")
    assert blake(b"").startswith("af1349b9f5f9a1a6") and blake(b"abc").startswith("6437b3ac38465133")
    assert item("crc32cHex")(b"123456789") == "e3069283" and item("crc32Hex")("123456789") == "cbf43926"
    assert item("crc32cHex")(b"") == item("crc32Hex")(b"") == "00000000"
    assert item("xxh64Hex")(b"") == "ef46db3751d8e999"


@pytest.mark.parametrize(
    ("size", "want"),
    [(1, "2d3adedff11b61f1"), (1023, "10108970eeda3eb9"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2048, "e776b6028c7cd22a"), (2049, "5f4d72f40d7a5f82"), (3072, "b98cb0ff3623be03"), (31744, "62b6960e1a44bcc1")],
)
def test_blake3_over_the_specification_s_counting_bytes(size, want):
    assert item("blake3Hex")(bytes(i % 251 for i in range(size))).startswith(want)


@pytest.mark.parametrize("codec", [("gzip", "gunzip"), ("zstdCompress", "zstdDecompress"), ("brotliCompress", "brotliDecompress")])
@settings(max_examples=40, deadline=None)
@given(data=st.binary(max_size=3000))
def test_round_trips(codec, data):
    assert item(codec[1])(item(codec[0])(data)) == data


def test_gunzip_takes_members_and_refuses_garbage():
    gunzip = item("gunzip")
    assert gunzip(gzip.compress(b"one") + gzip.compress(b"two")) == b"onetwo"
    assert gzip.decompress(item("gzip", 9)(b"x" * 999)) == b"x" * 999
    for bad in (b"no gzip here", gzip.compress(b"a") + b"tail", gzip.compress(b"abcdef")[:-3], b""):
        with pytest.raises(Fault):
            gunzip(bad)


def test_zstd_and_brotli_refuse_what_is_broken():
    frame = zstandard.ZstdCompressor().compress(b"hello" * 50)
    assert item("zstdDecompress")(frame + frame) == b"hello" * 100
    for op, bad in (("zstdDecompress", b"junk"), ("zstdDecompress", frame[:-2]), ("brotliDecompress", b""), ("brotliDecompress", item("brotliCompress")(b"hello" * 500)[:-4])):
        with pytest.raises(Fault):
            item(op)(bad)


@pytest.mark.parametrize(("op", "bad"), [("gzip", 10), ("gzip", -1), ("gzip", 1.5), ("zstdCompress", 0), ("zstdCompress", 23), ("brotliCompress", 12)])
def test_levels_are_checked_before_any_item(op, bad):
    with pytest.raises(InvalidArg):
        KERNELS[op](bad)


def test_brotli_window_is_checked():
    with pytest.raises(InvalidArg, match="lgwin"):
        KERNELS["brotliCompress"](5, 25)


@pytest.mark.parametrize("bad", ["!!!", " aGk=", "aGl", "aG=k", "aGk=\n", "a", "=", "QQ=", "QR=="])
def test_base64_is_strict(bad):
    with pytest.raises(Fault):
        item("base64Decode")(bad)


def test_base64_forms():
    decode = item("base64Decode")
    assert decode("aGk=") == decode("aGk") == b"hi" and decode("") == b"" and decode("QQ==QQ==") == b"AA"


@pytest.mark.parametrize("bad", ["abc", "zz", "12 34", "ab\n"])
def test_hex_is_strict_in_both_forms(spark, bad):
    with pytest.raises(Fault):
        item("hexDecode")(bad)
    with pytest.raises(ItemError, match="item 1: hexDecode: invalid hex"):
        batch("hexDecode", ["00", bad], spark=spark)


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=400))
def test_encodings_invert(data):
    assert item("base64Decode")(item("base64Encode")(data)) == data
    assert item("hexDecode")(item("hexEncode")(data).upper()) == data


def test_long_base64_has_no_line_breaks(spark):
    data = bytes(500)
    assert batch("base64Encode", [data], spark=spark) == [base64.b64encode(data).decode()]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=5000), max_size=5))
def test_many_at_once_equal_one_by_one(items):
    from millrace.functions import hashing

    assert hashing.blake3_digests(items) == [hashing.blake3_digests([b])[0] for b in items]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(2040, 2060))
def test_crc32c_by_blocks_equals_bytes(data, more):
    from millrace.functions import hashing

    data += bytes(i * 7 % 256 for i in range(more))
    table, crc = [int(t) for t in hashing._castagnoli()[0]], 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    assert hashing.crc32c_value(data) == crc ^ 0xFFFFFFFF


def test_native_xxh64_is_the_seedless_one(spark):
    import random

    r = random.Random(4)
    items = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(70), 1000, 4097]]
    assert batch("xxh64Hex", items, spark=spark) == [xxhash.xxh64_hexdigest(b, 0) for b in items]
    from millrace import functions as M

    texts = ["", "é", "x" * 99]
    df = spark.createDataFrame([(None,), *((t,) for t in texts)], "t string")
    assert {r[0] for r in df.select(M.xxh64_hex("t")).collect()} == {None, *(xxhash.xxh64_hexdigest(t.encode(), 0) for t in texts)}


@pytest.mark.parametrize("op", ["sha256Hex", "blake3Hex", "xxh3Hex", "xxh64Hex", "crc32Hex", "crc32cHex"])
def test_digests_of_files_in_bounded_memory(op):
    """The same as of the bytes, a megabyte of which is read at a time."""
    import io
    import random

    asked = []

    class File(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    m, kernel = 1 << 20, KERNELS[op]()
    for n in (0, 1, 1024, m - 1, m, m + 1, 2 * m + 1, 3 * m, 3 * m + 5000, 5 * m + 1024):
        data = random.Random(n).randbytes(n)
        assert kernel.stream(File(data)) == kernel.item(data)
    assert 0 < min(asked) and max(asked) <= m
