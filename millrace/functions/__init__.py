"""Column functions: each takes columns (or their names) and options, and gives a column usable anywhere.

A failing item fails the query with ``{op}: {cause}``; null gives null. The pipeline in
:mod:`millrace.operators` runs the same functions with errors as data.
"""

from __future__ import annotations


from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codecs, hashing, html, jsonpath, markdown, pairs, search, sorting, text, tokens
from . import tabular as _tabular
from .kernel import Kernel, column

#: Kernel makers by the names that plans and batch calls use.
KERNELS: dict[str, Callable[..., Kernel]] = {
    "sha256Hex": hashing.sha256,
    "blake3Hex": hashing.blake3,
    "xxh3Hex": hashing.xxh3,
    "xxh64Hex": hashing.xxh64,
    "crc32Hex": hashing.crc32,
    "crc32cHex": hashing.crc32c,
    "gzip": codecs.gzip,
    "gunzip": codecs.gunzip,
    "zstdCompress": codecs.zstd_compress,
    "zstdDecompress": codecs.zstd_decompress,
    "brotliCompress": codecs.brotli_compress,
    "brotliDecompress": codecs.brotli_decompress,
    "base64Encode": codecs.base64_encode,
    "base64Decode": codecs.base64_decode,
    "hexEncode": codecs.hex_encode,
    "hexDecode": codecs.hex_decode,
    "lowercase": text.lowercase,
    "uppercase": text.uppercase,
    "trim": text.trim,
    "normalize": text.normalize,
    "byteLen": text.byte_len,
    "jsonValidate": jsonpath.validate,
    "jsonPluck": jsonpath.pluck_or_null,
    "csvToNdjson": _tabular.csv_to_ndjson,
    "ndjsonTransform": _tabular.ndjson_transform,
    "multiReplace": search.multi_replace,
    "multiFind": search.multi_find,
    "regexTest": search.regex_test,
    "regexCount": search.regex_count,
    "regexReplace": search.regex_replace,
    "regexExtract": search.regex_extract_or_null,
    "sanitizeHtml": html.sanitize_html,
    "markdownToHtml": markdown.markdown_to_html,
    "htmlToText": html.html_to_text,
    "htmlExtract": html.html_extract,
    "countTokens": tokens.count_tokens,
    "truncateTokens": tokens.truncate_tokens,
    "chunkByTokens": tokens.chunk_by_tokens,
    "levenshtein": pairs.levenshtein,
    "similarity": pairs.similarity,
    "diff": pairs.diff,
}


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _as_column(make: Callable[..., Kernel], pair: bool) -> Callable[..., Column]:
    if pair:

        @wraps(make)
        def two(a: Column | str, b: Column | str, *args, **options) -> Column:
            return column(make(*args, **options), a, b)

        return two

    @wraps(make)
    def one(col: Column | str, *args, **options) -> Column:
        return column(make(*args, **options), col)

    return one


_PAIRS = ("levenshtein", "similarity", "diff")
for _name, _make in KERNELS.items():
    globals()[_snake(_name)] = _as_column(_make, _name in _PAIRS)


def json_list(col: Column | str, of: str = "string") -> Column:
    """The list that a JSON-giving function (multi_find, chunk_by_tokens, html_extract with all) wrote, as an array."""
    return F.from_json(F.col(col) if isinstance(col, str) else col, f"array<{of}>")


sort_numbers, sort_strings, number_key = sorting.sort_numbers, sorting.sort_strings, sorting.number_key
__all__ = [*map(_snake, KERNELS), "KERNELS", "json_list", "sort_numbers", "sort_strings", "number_key"]
