import hashlib
import random

import pyarrow as pa
import pytest
from helpers import DOCS, crowded, documents, duck, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import mkv


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=60), st.booleans(), st.integers(1, 9))
def test_frames_come_back(frames, unknown, per_block):
    data = mkv.mux(frames, per_block=per_block, unknown_sizes=unknown)
    packets, error = mkv.parse(data)
    assert error is None and [data[p[2] : p[2] + p[3]] for p in packets] == frames
    assert [p[1] for p in packets] == [i * 10**9 for i in range(len(frames))] and {p[0] for p in packets} <= {1}


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_laces(kind):
    r = random.Random(kind)
    for _ in range(200):
        n = 1 if kind == 0 else r.randint(1, 12)
        size = r.choice([0, 3, 255, 700])
        frames = [bytes(size if kind == 2 else r.choice([0, 1, 254, 255, 256, 510, 20_000])) for _ in range(n)]
        data = mkv.lace(frames, kind)
        assert [s for _, s in mkv.laces(data, 0, len(data), kind)] == [len(f) for f in frames]


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**28, 2**49])
def test_variable_length_integers(value):
    b = mkv.write_size(value)
    assert mkv.read_size(b, 0, len(b)) == (value, len(b), len(b))
    assert mkv.read_size(mkv.write_size(value, 8), 0, 8)[0] == value
    assert mkv.read_size(b"\x01" + b"\xff" * 7, 0, 8)[0] == -1 and mkv.read_size(b"\xff", 0, 1)[0] == -1


def hand_made() -> bytes:
    """Two tracks, a scale of 2 ms, a negative block time, a group with a reference, a void, and cues to one cluster."""
    e, u = mkv.element, mkv.number
    track = lambda n, d: e(mkv.ENTRY, u(mkv.NUMBER, n) + (u(mkv.DURATION, d) if d else b""))
    cluster = e(mkv.CLUSTER, u(mkv.TIME, 100) + e(mkv.SIMPLE, b"\x81" + (-5).to_bytes(2, "big", signed=True) + b"\x00" + b"abc") + e(0xEC, b"\0" * 9) + e(mkv.GROUP, e(mkv.BLOCK, b"\x40\x02\x00\x07\x04\x01" + b"xyXY") + u(mkv.REFERENCE, 1) + u(0x9B, 7)))
    head = e(mkv.EBML, e(0x4282, b"matroska"))
    info = e(mkv.INFO, u(mkv.SCALE, 2_000_000))
    tracks = e(mkv.TRACKS, track(1, 0) + track(2, 40_000_000))
    cues = e(mkv.CUES, e(mkv.POINT, u(mkv.CUE_TIME, 107) + e(mkv.POSITIONS, u(mkv.CUE_TRACK, 2) + u(mkv.CUE_CLUSTER, len(info) + len(tracks)))))
    return head + e(0xEC, b"") + e(mkv.SEGMENT, info + tracks + cluster + e(mkv.TAGS, b"") + cues)


def test_a_hand_made_file():
    data = hand_made()
    packets, error = mkv.parse(data)
    assert error is None
    where = packets[0][6]
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], *p[4:]) for p in packets] == [
        (1, 95 * 2_000_000, b"abc", False, "none", where, False),
        (2, 107 * 2_000_000, b"xy", False, "fixed", where, True),
        (2, 107 * 2_000_000 + 40_000_000, b"XY", False, "fixed", where, False),
    ]


def test_damage_is_reported_and_never_raises():
    data = mkv.mux([b"frame %d" % i * 9 for i in range(40)])
    whole, _ = mkv.parse(data)
    for cut in range(0, len(data), 7):
        packets, error = mkv.parse(data[:cut])
        assert error is not None and packets == [] or all(p[2] + p[3] <= cut for p in packets)
    r = random.Random(1)
    for _ in range(500):
        b = bytearray(data)
        for _ in range(3):
            b[r.randrange(len(b))] = r.randrange(256)
        packets, _ = mkv.parse(bytes(b))
        assert all(p[2] + p[3] <= len(b) for p in packets)
    assert mkv.parse(b"") == ([], "no EBML header") and mkv.parse(b"RIFF" * 9)[0] == []
    open_ended = mkv.mux([b"frame %d" % i for i in range(300)], unknown_sizes=True)
    some, error = mkv.parse(open_ended[: len(open_ended) * 2 // 3])
    assert error and 0 < len(some) < 300 and [p[2] for p in some] == [p[2] for p in mkv.parse(open_ended)[0]][: len(some)] and len(whole) == 40


def test_on_a_table(spark):
    rows = [(1, "one\ntwo\n\nthree ü"), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "a\nb"), (5, "\n".join(["line " * (i % 900) for i in range(2000)]))]
    got = mkv.document_packets(crowded(frame(spark, rows))).collect()
    want = duck(mkv.SQL, documents=pa.table(list(map(list, zip(*documents(rows)))), schema=DOCS))
    keys = ("doc_id", "packet", "track", "timestamp_ns", "byte_size", "payload_md5")
    assert sorted(map(repr, ([r[k] for k in keys] for r in got if r["packet"] is not None))) == sorted(map(repr, ([r[k] for k in keys] for r in want)))
    assert [r["packet"] for r in got if r["doc_id"] == 2] == [None] and all(r["error"] is None for r in got)
    files = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(hand_made())), (3, None)], "id int, data binary").withColumns({"packet": F.lit(1), "error": F.lit("x"), "f": F.lit(2)})
    out = mkv.packet_table(files, "id", "data").collect()
    assert [(r["id"], r["packet"], r["error"]) for r in out if r["id"] != 2] == [(1, None, mkv.parse(b"junk")[1]), (3, None, None)] and mkv.parse(b"junk")[1]
    assert [r["payload_md5"] for r in out if r["id"] == 2] == [hashlib.md5(b).hexdigest() for b in (b"abc", b"xy", b"XY")]
    assert mkv.document_packets(frame(spark, [])).collect() == []


def test_damage_never_ends_a_task(spark):
    """Times beyond 64 bits, and bytes changed at random, through the column and not the parser alone."""
    track = mkv.element(mkv.TRACKS, mkv.element(mkv.ENTRY, mkv.number(mkv.NUMBER, 1) + mkv.number(mkv.DURATION, (1 << 64) - 1)))

    def file(scale, time, kind=0, body=b"abc"):
        block = mkv.element(mkv.SIMPLE, b"\x81\x00\x00" + bytes([0x80 | kind << 1]) + body)
        parts = mkv.element(mkv.INFO, mkv.number(mkv.SCALE, scale)) + track + mkv.element(mkv.CLUSTER, mkv.number(mkv.TIME, time) + block)
        return mkv.element(mkv.EBML, mkv.element(0x4282, b"matroska")) + mkv.element(mkv.SEGMENT, parts)

    huge = (1 << 64) - 1
    r = random.Random(2)
    data = mkv.mux([b"frame %d" % i * 9 for i in range(40)])
    files = [file(huge, huge), file(huge, 1), file(1, huge), file(1, (1 << 63) - 1), file(1, 5, 2, b"\x01abcd")]
    for _ in range(300):
        b = bytearray(data)
        for _ in range(4):
            b[r.randrange(120)] = r.choice((0, 255, r.randrange(256)))
        files.append(bytes(b))
    got = {}
    for x in mkv.packet_table(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "id int, data binary"), "id", "data").collect():
        got.setdefault(x["id"], []).append((x["packet"], x["timestamp_ns"], x["error"]))
    assert len(got) == len(files)
    assert all(got[i][0][0] is None and "out of range" in got[i][0][2] for i in (0, 1, 2, 4))
    assert got[3] == [(0, (1 << 63) - 1, None)]
