"""Operator 4: Matroska media columns as packet tables.

``parse`` walks the EBML elements of a file (variable-length ids and sizes, unknown sizes of segment and
clusters), reads tracks, clusters, simple blocks and block groups with every kind of lacing, and cues, and gives one row for each frame with
its track, timestamp and byte range. ``mux`` writes such files; the query uses it to turn each
document into a text track of one packet per line, as the tables hold no media of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, DURATION, CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xD7, 0x23E383, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")


class Malformed(ValueError):
    """The bytes are no Matroska from some place on."""


def read_id(b: bytes, at: int, end: int) -> tuple[int, int]:
    """Element id, marker bit kept, and the place behind it."""
    if at >= end or not b[at]:
        raise Malformed(f"no element id at byte {at}")
    n = 9 - b[at].bit_length()
    if n > 4 or at + n > end:
        raise Malformed(f"no element id at byte {at}")
    return int.from_bytes(b[at : at + n], "big"), at + n


def read_size(b: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Value of a variable-length integer (-1: all ones, unknown), the place behind it, and its length."""
    if at >= end or not b[at]:
        raise Malformed(f"no size at byte {at}")
    n = 9 - b[at].bit_length()
    if at + n > end:
        raise Malformed(f"a size is cut off at byte {at}")
    value = int.from_bytes(b[at : at + n], "big") & ((1 << (7 * n)) - 1)
    return (-1 if value == (1 << (7 * n)) - 1 else value), at + n, n


def elements(b: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of element, start of data, end of data) of the elements of a range.

    An element of unknown size ends where its parent does; with ``stop``, at the next id of that set.
    """
    while at < end:
        start = at
        name, at = read_id(b, at, end)
        if name in stop:
            return
        size, at, _ = read_size(b, at, end)
        last = end if size < 0 else at + size
        if last > end:
            raise Malformed(f"the element at byte {start} is cut off")
        if size < 0 and name == CLUSTER:
            last = _cluster_end(b, at, end)
        elif size < 0 and name != SEGMENT:
            raise Malformed(f"the element at byte {start} has no size")
        yield name, start, at, last
        at = last


def _cluster_end(b: bytes, at: int, end: int) -> int:
    while at < end:
        name, data = read_id(b, at, end)
        if name in _TOP:
            return at
        size, data, _ = read_size(b, data, end)
        if size < 0:
            raise Malformed(f"the element at byte {at} has no size")
        at = data + size
    return end


def _uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


def laces(b: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose data, behind its flags, begins at ``at``."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise Malformed(f"a lace is cut off at byte {at}")
    count, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        each, over = divmod(end - at, count)
        if over:
            raise Malformed(f"frames of unequal size in a fixed lace at byte {at}")
        sizes = [each] * count
    elif kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed(f"a lace is cut off at byte {at}")
                at += 1
                size += b[at - 1]
                if b[at - 1] < 255:
                    break
            sizes.append(size)
    elif count > 1:
        size, at, _ = read_size(b, at, end)
        sizes.append(size)
        for _ in range(count - 2):
            diff, at, n = read_size(b, at, end)
            diff = (1 << (7 * n)) - 1 if diff < 0 else diff
            size += diff - ((1 << (7 * n - 1)) - 1)
            sizes.append(size)
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"frames overrun their block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


#: Times, in nanoseconds, must lie within 64 bits.
_FURTHEST = (1 << 63) - 1


def parse(b: bytes) -> tuple[list[tuple], str | None]:
    """Packets (track, timestamp in ns, offset, size, key frame, lacing, cluster offset, cued), and the error that ended the walk."""
    out: list[tuple] = []
    cued: set[tuple[int, int, int]] = set()
    scale, durations = 1_000_000, {}
    try:
        tops = elements(b, 0, len(b))
        first = next(tops, None)
        if first is None or first[0] != EBML:
            raise Malformed("no EBML header")
        for name, _, at, end in tops:
            if name != SEGMENT:
                continue
            base = at
            for name, start, a, z in elements(b, at, end):  # noqa: B020
                if name == INFO:
                    scale = next((_uint(b, x, y) for n, _, x, y in elements(b, a, z) if n == SCALE), scale)
                elif name == TRACKS:
                    for n, _, x, y in elements(b, a, z):
                        if n == ENTRY:
                            own = {m: _uint(b, p, r) for m, _, p, r in elements(b, x, y) if m in (NUMBER, DURATION)}
                            durations[own.get(NUMBER, 0)] = own.get(DURATION, 0)
                elif name == CLUSTER:
                    _cluster(b, a, z, start - base, scale, durations, out)
                elif name == CUES:
                    for n, _, x, y in elements(b, a, z):
                        if n == POINT:
                            time = 0
                            for m, _, p, r in elements(b, x, y):
                                if m == CUE_TIME:
                                    time = _uint(b, p, r)
                                elif m == POSITIONS:
                                    own = {k: _uint(b, i, j) for k, _, i, j in elements(b, p, r) if k in (CUE_TRACK, CUE_CLUSTER)}
                                    cued.add((own.get(CUE_TRACK, 0), time * scale, own.get(CUE_CLUSTER, -1)))
    except Malformed as e:
        return [(*p, (p[0], p[1], p[6]) in cued) for p in out], str(e)
    return [(*p, (p[0], p[1], p[6]) in cued) for p in out], None


def _cluster(b: bytes, at: int, end: int, where: int, scale: int, durations: dict[int, int], out: list[tuple]) -> None:
    time = 0
    for name, _, a, z in elements(b, at, end):
        if name == TIME:
            time = _uint(b, a, z)
        elif name == SIMPLE:
            _block(b, a, z, time, None, where, scale, durations, out)
        elif name == GROUP:
            inner = list(elements(b, a, z))
            key = all(n != REFERENCE for n, *_ in inner)
            for n, _, x, y in inner:
                if n == BLOCK:
                    _block(b, x, y, time, key, where, scale, durations, out)


def _block(b: bytes, at: int, end: int, time: int, key: bool | None, where: int, scale: int, durations: dict[int, int], out: list[tuple]) -> None:
    track, at, _ = read_size(b, at, end)
    if at + 3 > end:
        raise Malformed(f"a block is cut off at byte {at}")
    flags, kind = b[at + 2], (b[at + 2] >> 1) & 3
    begin = (time + int.from_bytes(b[at : at + 2], "big", signed=True)) * scale
    key = bool(flags & 0x80) if key is None else key
    step = durations.get(track, 0)
    frames = laces(b, at + 3, end, kind)
    if begin < -_FURTHEST or begin + (len(frames) - 1) * step > _FURTHEST:
        raise Malformed(f"a time out of range at byte {at}")
    for i, (offset, size) in enumerate(frames):
        out.append((track, begin + i * step, offset, size, key, LACINGS[kind], where))


# -- writing


def write_id(name: int) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big")


def write_size(value: int, n: int = 0) -> bytes:
    """A variable-length integer, of n bytes or as few as it takes."""
    while not n or value >= (1 << (7 * n)) - 1:
        n += 1
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def element(name: int, data: bytes) -> bytes:
    return write_id(name) + write_size(len(data)) + data


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The data of a block behind its flags."""
    body = b"".join(frames)
    if kind == 0:
        return body
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes)
    elif kind == 3 and sizes:
        head += write_size(sizes[0])
        for a, z in zip(sizes, sizes[1:]):
            n = 1
            while not -((1 << (7 * n - 1)) - 1) < z - a < (1 << (7 * n - 1)) - 1:
                n += 1
            head += write_size(z - a + (1 << (7 * n - 1)) - 1, n)
    return head + body


def mux(frames: list[bytes], step_ms: int = 1000, per_block: int = 4, blocks_per_cluster: int = 8, unknown_sizes: bool = False) -> bytes:
    """A Matroska file of one text track: frame i at i * step_ms; blocks take the kinds of lacing in turn."""
    head = element(EBML, element(0x4282, b"matroska"))
    info = element(INFO, number(SCALE, 1_000_000))
    track = number(NUMBER, 1) + number(0x73C5, 1) + number(0x83, 0x11) + element(0x86, b"S_TEXT/UTF8") + number(DURATION, step_ms * 1_000_000)
    body = [info, element(TRACKS, element(ENTRY, track))]
    size, cues, i, turn = sum(map(len, body)), [], 0, 0
    while i < len(frames):
        start, parts = i, [number(TIME, i * step_ms)]
        for _ in range(blocks_per_cluster):
            kind = turn % 4
            some = frames[i : i + (1 if kind == 0 else per_block)]
            relative = (i - start) * step_ms
            if not some or relative >= 1 << 15:
                break
            if kind == 2 and len({len(f) for f in some}) > 1:
                kind = 3
            data = write_size(1) + relative.to_bytes(2, "big")
            if turn % 5 == 4:
                parts.append(element(GROUP, element(BLOCK, data + bytes([kind << 1]) + lace(some, kind))))
            else:
                parts.append(element(SIMPLE, data + bytes([0x80 | kind << 1]) + lace(some, kind)))
            i, turn = i + len(some), turn + 1
        cues.append(element(POINT, number(CUE_TIME, start * step_ms) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, size))))
        inner = b"".join(parts)
        body.append(write_id(CLUSTER) + b"\x01" + b"\xff" * 7 + inner if unknown_sizes else element(CLUSTER, inner))
        size += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    inner = b"".join(body)
    return head + (write_id(SEGMENT) + b"\x01" + b"\xff" * 7 + inner if unknown_sizes else element(SEGMENT, inner))


# -- columns

_PACKET = "track bigint, timestamp_ns bigint, byte_offset bigint, byte_size bigint, key_frame boolean, lacing string, cluster_offset bigint, cued boolean, payload_md5 string"
_FIELDS = [f.split()[0] for f in _PACKET.split(", ")]


def media(text: Column) -> Column:
    """text -> a Matroska file whose packets are its lines; null for null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mux(t.encode("utf-8").split(b"\n")) for t in texts.to_pylist()], pa.binary())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def parsed(data: Column) -> Column:
    """binary -> struct(packets array, error string)."""

    def run(files: pa.Array) -> pa.Array:
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        columns: list[list] = [[] for _ in _FIELDS]
        ends, errors = [0], []
        for b in files:
            b = b.as_py()
            packets, error = ([], None) if b is None else parse(b)
            errors.append(error)
            ends.append(ends[-1] + len(packets))
            for c, values in zip(columns, zip(*packets)):
                c.extend(values)
            columns[-1].extend(hashlib.md5(b[p[2] : p[2] + p[3]]).hexdigest() for p in packets)
        rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _FIELDS)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(errors, pa.string())], ["packets", "error"])

    run.__annotations__ = {"files": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<packets array<struct<{_PACKET.replace(' ', ':')}>>, error string>".replace(",:", ", "))(data)


def packet_table(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, packet, track, timestamp_ns, byte_offset, byte_size, key_frame, lacing, cluster_offset, cued, payload_md5, error).

    One row for each frame, numbered from 0 in the order of the file; byte ranges count from the
    file's start. A file without frames (null, empty of clusters, or malformed before its first) has
    one row with packet null; a malformed file keeps the frames before the fault, and error says
    where it lies on all its rows; a time beyond 64 bits of nanoseconds is such a fault. Frames of size 0 are rows. Repeated files and null keys are kept
    row by row. Other columns of files are ignored, whatever their names; an empty table gives an empty result.
    """
    got = files.select(F.col(key).alias("key"), parsed(F.col(data)).alias("p"))
    rows = got.select("key", F.col("p.error").alias("error"), F.posexplode_outer("p.packets").alias("packet", "f"))
    return rows.select(F.col("key").alias(key), "packet", *[F.col(f"f.{c}").alias(c) for c in _FIELDS], "error")


def document_packets(docs: DataFrame) -> DataFrame:
    """The packet table of the documents as media files; see :func:`packet_table`."""
    return packet_table(docs.select("doc_id", media(F.col("text")).alias("data")), "doc_id", "data")


#: What SQL can say of the packets; byte offsets and laces are held against a plain reader in the tests.
SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS packet, CAST(1 AS BIGINT) AS track, CAST(i AS BIGINT) * 1000000000 AS timestamp_ns,
       CAST(strlen(lines[i + 1]) AS BIGINT) AS byte_size, md5(lines[i + 1]) AS payload_md5
FROM p
"""
