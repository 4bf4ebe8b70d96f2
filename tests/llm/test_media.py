"""Matroska: exact round trips by any lacing, foreign layouts, damage."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import matroska as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from(["none", "xiph", "fixed", "ebml"]), st.integers(1, 300), st.integers(1, 9))
def test_round_trip(payload, lacing, frame, per_block):
    data = M.mux(payload, frame, 1 if lacing == "none" else per_block, 3, lacing)
    m = M.parse(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in m.packets) == payload
    assert [p.packet for p in m.packets] == list(range(-(-len(payload) // frame)))
    assert {at for _, _, at in m.cues} == {p.cluster_offset for p in m.packets}


def test_uneven_lacing():
    frames = [bytes([i]) * n for i, n in enumerate([3, 700, 255, 1, 0, 510, 90])]
    for mode in ("xiph", "ebml"):
        flags, body = M.lace(frames, mode)
        assert [body[a : a + n] for a, n in M._frames(body, 0, len(body), flags)] == frames


def test_foreign_layout():
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x82\x00\x05\x00abc") + M._uint(M.BLOCK_DURATION, 7) + M._uint(M.REFERENCE_BLOCK, 1))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M._uint(M.TIMESTAMP, 10) + M._element(0xEC, b"void") + group  # of unknown size
    track = M._element(M.TRACKS, M._element(M.TRACK_ENTRY, M._uint(M.TRACK_NUMBER, 2) + M._uint(M.TRACK_TYPE, 1) + M._element(M.CODEC_ID, b"V_TEST")))
    body = M._element(M.INFO, M._uint(M.TIMESTAMP_SCALE, 500_000)) + track + cluster + cluster
    data = M._element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body
    m = M.parse(data)
    assert m.clusters == 2 and m.tracks[2].codec == "V_TEST"
    assert [(p.track, p.packet, p.timestamp_ns, p.duration_ns, p.keyframe, data[p.offset : p.offset + p.size]) for p in m.packets] == [(2, k, 15 * 500_000, 7 * 500_000, False, b"abc") for k in (0, 1)]


def unknown(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + b"\xff" + body


def far(number: int, time: int) -> bytes:
    """A file with one packet of this track and time."""
    block = M._element(M.SIMPLE_BLOCK, M._vint(number, 8) + b"\x00\x00\x80x")
    return M._element(M.EBML, b"") + M._element(M.SEGMENT, M._element(M.CLUSTER, M._uint(M.TIMESTAMP, time) + block))


def test_damage():
    data = M.mux(bytes(5000))
    for cut in (0, 3, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            M.parse(data[:cut])
    rng = random.Random(1)
    for _ in range(2000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 3)):
            bad[rng.randrange(300)] = rng.randrange(256)
        try:
            M.parse(bytes(bad))
        except ValueError:
            pass


def nested(levels: int) -> bytes:
    body = b""
    for _ in range(levels):
        body = unknown(0xA0, body)
    return M._element(M.EBML, b"") + unknown(M.SEGMENT, unknown(M.CLUSTER, body))


def test_limits():
    assert M.parse(nested(M.DEPTH - 1)).clusters == 1
    for data in (nested(3000), nested(M.DEPTH), far(1, 1 << 62)):
        with pytest.raises(ValueError):
            M.parse(data)
    assert [(p.track, p.timestamp_ns) for p in M.parse(far(1 << 40, 7)).packets] == [(1 << 40, 7_000_000)]


def test_features_of_any_file(spark):
    """Nulls, damage, files without track 1, without packets, and with several tracks."""
    track = lambda n: M._element(M.TRACK_ENTRY, M._uint(M.TRACK_NUMBER, n) + M._uint(M.TRACK_TYPE, 2) + M._element(M.CODEC_ID, b"A_X"))
    blocks = b"".join(M._element(M.SIMPLE_BLOCK, bytes([0x80 | n, 0, 0, 0x80]) + body) for n, body in ((3, b"abc"), (2, b"other"), (3, b"d")))
    two = M._element(M.EBML, b"") + M._element(M.SEGMENT, M._element(M.TRACKS, track(5) + track(3)) + M._element(M.CLUSTER, blocks))
    files = {1: None, 2: b"", 3: M.mux(b"x" * 600)[:-9], 4: two, 5: M._element(M.EBML, b"") + M._element(M.SEGMENT, b""), 6: nested(3000), 7: far(1, 1 << 62), 8: far(1 << 40, 7)}
    df = spark.createDataFrame(list(files.items()), "error long, media binary")
    got = {r.error: r for r in M.media_features(df, ["error"]).collect()}
    assert got[1][1:] == (None,) * 6
    for k in (2, 3, 6, 7):
        assert got[k].payload_sha256 is None and got[k].media_bytes == len(files[k]) and got[k].feature.startswith("error: ")
    assert (got[4].payload_sha256, got[4].payload_bytes) == (hashlib.sha256(b"abcd").hexdigest(), 4) and got[4].feature.startswith("A_X;8000;1;0;packets=2;")
    assert (got[5].payload_bytes, got[5].feature) == (0, "no track;packets=0;clusters=0;cues=0;ms=0") and got[8].feature.startswith("no track;packets=1")
    rows = M.packet_table(df, "error", "media").collect()
    assert sorted((r.media_id, r.error is None) for r in rows) == [(2, False), (3, False), (4, True), (4, True), (4, True), (6, False), (7, False), (8, True)]


def test_columns(spark):
    texts = [(1, "a" * 576), (2, ""), (3, None), (4, "é" * 1000), (4, "é" * 1000)]
    stored = M.store_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    got = M.media_features(stored, ["doc_id", "n_bytes"]).collect()
    for r, (i, t) in zip(got, texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    table = M.packet_table(stored.unionByName(spark.sql("select 9L as doc_id, 0L as n_bytes, unhex('1A45') as media union all select 8L, 0L, null")), "doc_id", "media")
    rows = table.collect()
    assert [r.error is None for r in rows if r.media_id == 9] == [False] and not [r for r in rows if r.media_id == 8]
    assert sum(r.size for r in rows if r.media_id == 1) == 576
