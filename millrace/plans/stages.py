"""The closed set of stages: names in plans, input kinds, options and kernels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import InvalidArg
from ..functions import KERNELS, jsonpath, search, text
from ..functions.kernel import Kernel


@dataclass(frozen=True)
class Spec:
    """How a stage is made: its kernel and the names of its options, in the order of positional arguments."""

    make: Callable[..., Kernel]
    options: tuple[tuple[str, str], ...] = ()  # (name in plans, name in Python)
    required: tuple[str, ...] = ()


def _spec(make: Callable[..., Kernel], *options: str, required: tuple[str, ...] = ()) -> Spec:
    snake = lambda n: "".join(f"_{c.lower()}" if c.isupper() else c for c in n)
    return Spec(make, tuple((o, snake(o)) for o in options), required)


_K = KERNELS
STAGES: dict[str, Spec] = {
    **{op: _spec(_K[op]) for op in ("gunzip", "zstdDecompress", "brotliDecompress", "sha256Hex", "blake3Hex", "xxh3Hex", "xxh64Hex", "crc32Hex", "crc32cHex")},
    **{op: _spec(_K[op]) for op in ("lowercase", "uppercase", "trim", "base64Encode", "base64Decode", "hexEncode", "hexDecode")},
    "gzip": _spec(_K["gzip"], "level"),
    "zstdCompress": _spec(_K["zstdCompress"], "level"),
    "brotliCompress": _spec(_K["brotliCompress"], "quality", "lgwin"),
    "utf8": _spec(text.utf8),
    "bytes": _spec(text.to_bytes),
    "normalize": _spec(_K["normalize"], "form", required=("form",)),
    "jsonPluck": _spec(jsonpath.pluck, "path", required=("path",)),
    "regexReplace": _spec(_K["regexReplace"], "pattern", "replacement", required=("pattern", "replacement")),
    "regexExtract": _spec(search.regex_extract, "pattern", "group", required=("pattern",)),
    "sanitizeHtml": _spec(_K["sanitizeHtml"], "allowedTags", "allowedAttrs", "urlSchemes", "stripComments"),
    "markdownToHtml": _spec(_K["markdownToHtml"], "gfm", "tables", "footnotes", "smartPunct", "unsafe"),
    "htmlToText": _spec(_K["htmlToText"], "width"),
    "htmlExtract": _spec(_K["htmlExtract"], "selector", "extract", "all", required=("selector", "extract")),
    "csvToNdjson": _spec(_K["csvToNdjson"], "delimiter", "quote", "hasHeader", "select"),
    "ndjsonTransform": _spec(_K["ndjsonTransform"], "filter", "project"),
    "multiReplace": _spec(_K["multiReplace"], "patterns", "replacements", "caseInsensitive", required=("patterns", "replacements")),
    "multiFind": _spec(_K["multiFind"], "patterns", "caseInsensitive", "limit", required=("patterns",)),
    "truncateTokens": _spec(_K["truncateTokens"], "encoding", "maxTokens", "keep", required=("encoding", "maxTokens")),
}


@dataclass(frozen=True)
class Stage:
    """One stage of a plan: its name and its options by their plan names."""

    op: str
    options: dict = field(default_factory=dict)

    def kernel(self) -> Kernel:
        spec = STAGES.get(self.op)
        if spec is None:
            raise InvalidArg(f"unknown op '{self.op}'")
        names = dict(spec.options)
        for k in self.options:
            if k not in names:
                raise InvalidArg(f"{self.op}: unknown option '{k}'")
        for k in spec.required:
            if self.options.get(k) is None:
                raise InvalidArg(f"{self.op}: missing option '{k}'")
        return spec.make(**{names[k]: v for k, v in self.options.items() if v is not None})

    def to_json(self) -> dict:
        return {"op": self.op, **self.options}
