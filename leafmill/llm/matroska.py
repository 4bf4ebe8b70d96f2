"""Media columns: Matroska files as binary columns, parsed into packet tables.

The parser walks variable-length EBML elements, reads tracks, clusters, blocks
with any lacing (none, Xiph, fixed, EBML) and cues, and gives each packet its
track, timestamp and byte range.  The muxer stores bytes as 8-bit PCM samples.

Files become rows in steps: a column of files, a column of their packets and
tracks beside it, and from these a table of packets, or features that are read by
the packets' byte ranges.

Cases: null media gives null packets, no rows and null features; elements of
unknown size are taken to end where an element of their parent's level begins;
what is cut off, nested more than ``DEPTH`` unknown sizes deep or out of the range
of 64 bits raises ``ValueError`` in :func:`parse` and gives a reason as ``error``
in the columns; repeated rows give repeated packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table

#: Samples of 8 bits in a packet, packets in a laced block, blocks in a cluster.
FRAME, LACE, BLOCKS = 576, 8, 64
RATE = 48_000
SCALE = 1_000_000
#: Elements of unknown size that may stand in each other; a segment and its cluster make two.
DEPTH = 6

# Element identifiers of the Matroska specification (RFC 9559); fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
#: Elements of the segment's level: each ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}


class Packet(NamedTuple):
    track: int
    packet: int
    timestamp_ns: int
    duration_ns: int | None
    keyframe: bool
    cluster_offset: int
    offset: int
    size: int


class Track(NamedTuple):
    number: int
    kind: int
    codec: str
    rate: float
    channels: int
    bits: int
    default_ns: int | None


class Media(NamedTuple):
    tracks: dict[int, Track]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, offset of the cluster in the file
    clusters: int
    duration_ns: int


# -- writing ---------------------------------------------------------------


def _vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones stays reserved for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return _element(ident, struct.pack(">d", x))


def lace(frames: list[bytes], mode: str) -> tuple[int, bytes]:
    """The flag bits and the body of a block with these frames laced by ``mode``: none, xiph, fixed or ebml."""
    if mode == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return 0, frames[0]
    sizes, count = [len(f) for f in frames], bytes([len(frames) - 1])
    if mode == "xiph":
        return 0x02, count + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    if mode == "fixed":
        if len(set(sizes)) != 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, count + b"".join(frames)
    head = _vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += _vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, count + head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, per_block: int = LACE, per_cluster: int = BLOCKS, lacing: str = "fixed") -> bytes:
    """A Matroska file with ``payload`` as one track of mono 8-bit PCM, one cue for each cluster."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    frame_ms = frame * 1000 / RATE
    info = _element(INFO, _uint(TIMESTAMP_SCALE, SCALE) + _float(DURATION, len(payload) * 1000 / RATE) + _element(MUXING_APP, b"leafmill") + _element(WRITING_APP, b"leafmill"))
    audio = _element(AUDIO, _float(SAMPLING, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(FLAG_LACING, int(per_block > 1)) + _uint(DEFAULT_DURATION, round(frame_ms * 1e6)) + audio
    body, cues = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))], []
    at = sum(map(len, body))
    for c in range(0, len(frames), per_block * per_cluster):
        start = round(c * frame_ms)
        parts = [_uint(TIMESTAMP, start)]
        for b in range(c, min(len(frames), c + per_block * per_cluster), per_block):
            group = frames[b : b + per_block]
            mode = lacing if lacing != "fixed" or len({*map(len, group)}) == 1 else "ebml"
            flags, data = lace(group, mode)
            parts.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", round(b * frame_ms) - start, 0x80 | flags) + data))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(_element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(_element(CUES, b"".join(cues)))
    head = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    return head + _element(SEGMENT, b"".join(body))


# -- reading ---------------------------------------------------------------


def _head(data: bytes, at: int, end: int) -> tuple[int, int | None, int]:
    """Identifier, size (None: unknown) and start of the body of the element at ``at``."""
    if at >= end or not (first := data[at]):
        raise ValueError(f"no element at {at}")
    n = 9 - first.bit_length()
    ident = int.from_bytes(data[at : at + n], "big")
    at += n
    if n > 4 or at >= end or not (first := data[at]):
        raise ValueError(f"bad element head before {at}")
    width = 9 - first.bit_length()
    if at + width > end:
        raise ValueError(f"size cut off at {at}")
    size = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return ident, None if size == (1 << 7 * width) - 1 else size, at + width


def _children(data: bytes, at: int, end: int, stop: set[int] = frozenset(), depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Identifier, start, body and end of each element in a range; an element in ``stop`` ends it."""
    while at < end:
        ident, size, body = _head(data, at, end)
        if ident in stop:
            return
        if size is None:
            close = end if ident == SEGMENT else _unknown_end(data, body, end, depth + 1)
        elif (close := body + size) > end:
            raise ValueError(f"element {ident:x} at {at} is cut off")
        yield ident, at, body, close
        at = close


def _unknown_end(data: bytes, at: int, end: int, depth: int) -> int:
    if depth > DEPTH:
        raise ValueError(f"more than {DEPTH} unknown sizes before {at}")
    for _, _, _, close in _children(data, at, end, TOP, depth):
        at = close
    return at


def _vint_at(data: bytes, at: int) -> tuple[int, int, int]:
    """Value, width and end of the variable-length integer at ``at``."""
    if not data[at]:
        raise ValueError(f"no integer at {at}")
    width = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width, width, at + width


def _fits(*numbers: int | None) -> None:
    """``ValueError`` unless all numbers are of 64 bits."""
    for n in numbers:
        if n is not None and not -(1 << 63) <= n < 1 << 63:
            raise ValueError(f"{n} is out of range")


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _signed_vint(data: bytes, at: int) -> tuple[int, int]:
    n, width, end = _vint_at(data, at)
    return n - ((1 << 7 * width - 1) - 1), end


def _frames(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of the frames in a block whose body begins at ``at``."""
    mode = flags & 0x06
    if not mode:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if mode == 0x04:
        sizes = [(end - at) // count] * count
        if sizes[0] * count != end - at:
            raise ValueError("fixed lacing doesn't divide the block")
    else:
        if mode == 0x02:
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        else:
            n, _, at = _vint_at(data, at)
            sizes.append(n)
            for _ in range(count - 2):
                step, at = _signed_vint(data, at)
                sizes.append(sizes[-1] + step)
            sizes = sizes[: count - 1]
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds the block")
    ranges = []
    for n in sizes:
        ranges.append((at, n))
        at += n
    return ranges


def _track(data: bytes, body: int, close: int) -> Track:
    x: dict[int, int] = {}
    codec, rate = "", 8000.0
    for ident, _, a, b in _children(data, body, close):
        if ident == CODEC_ID:
            codec = data[a:b].decode("ascii", "replace").rstrip("\0")
        elif ident == AUDIO:
            for i, _, c, d in _children(data, a, b):
                if i == SAMPLING:
                    rate = _real(data, c, d)
                elif i in (CHANNELS, BIT_DEPTH):
                    x[i] = _number(data, c, d)
        elif ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            x[ident] = _number(data, a, b)
    return Track(x.get(TRACK_NUMBER, 0), x.get(TRACK_TYPE, 0), codec, rate, x.get(CHANNELS, 1), x.get(BIT_DEPTH, 0), x.get(DEFAULT_DURATION))


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file; ``ValueError`` for what isn't one."""
    try:
        return _parse(data)
    except (IndexError, KeyError, OverflowError, struct.error) as e:
        raise ValueError(f"cut off or damaged: {e}") from e


def _parse(data: bytes) -> Media:
    tracks: dict[int, Track] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    counts: dict[int, int] = {}
    scale, duration, clusters, raw_cues, raw_duration = SCALE, 0, 0, [], 0.0
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    if not any(ident == SEGMENT for ident, *_ in top):
        raise ValueError("no segment")

    def block(a: int, b: int, base: int, cluster: int, key: bool | None, length: int | None) -> None:
        track, _, at = _vint_at(data, a)
        relative, flags = struct.unpack_from(">hB", data, at)
        ranges = _frames(data, at + 3, b, flags)
        step = tracks[track].default_ns if track in tracks else None
        if length is not None:
            step = length * scale // len(ranges)
        k, time = counts.get(track, 0), (base + relative) * scale
        _fits(step, time, time + len(ranges) * (step or 0))
        for i, (offset, size) in enumerate(ranges):
            packets.append(Packet(track, k + i, time + i * (step or 0), step, bool(flags & 0x80) if key is None else key, cluster, offset, size))
        counts[track] = k + len(ranges)

    for segment, _, start, end in top:
        if segment != SEGMENT:
            continue
        for ident, at, body, close in _children(data, start, end):
            if ident == INFO:
                for i, _, a, b in _children(data, body, close):
                    if i == TIMESTAMP_SCALE:
                        scale = _number(data, a, b)
                    elif i == DURATION:
                        raw_duration = _real(data, a, b)
            elif ident == TRACKS:
                for i, _, a, b in _children(data, body, close):
                    if i == TRACK_ENTRY:
                        track = _track(data, a, b)
                        tracks[track.number] = track
            elif ident == CLUSTER:
                clusters, base = clusters + 1, 0
                for i, _, a, b in _children(data, body, close):
                    if i == SIMPLE_BLOCK:
                        block(a, b, base, at, None, None)
                    elif i == TIMESTAMP:
                        base = _number(data, a, b)
                    elif i == BLOCK_GROUP:
                        inner = {j: (c, d) for j, _, c, d in _children(data, a, b)}
                        if BLOCK in inner:
                            length = _number(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                            block(*inner[BLOCK], base, at, REFERENCE_BLOCK not in inner, length)
            elif ident == CUES:
                for i, _, a, b in _children(data, body, close):
                    if i == CUE_POINT:
                        parts = list(_children(data, a, b))
                        time = next((_number(data, c, d) for j, _, c, d in parts if j == CUE_TIME), 0)
                        for j, _, c, d in parts:
                            if j == CUE_POSITIONS:
                                x = {m: _number(data, e, f) for m, _, e, f in _children(data, c, d)}
                                raw_cues.append((time, x.get(CUE_TRACK, 0), start + x.get(CUE_CLUSTER, 0)))
        duration = max(duration, round(raw_duration * scale))
    cues = [(t * scale, track, at) for t, track, at in raw_cues]
    _fits(duration, *(n for cue in cues for n in cue), *(n for t in tracks.values() for n in (t.number, t.kind, t.channels, t.bits, t.default_ns)))
    return Media(tracks, packets, cues, clusters, duration)


# -- columns ---------------------------------------------------------------

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LONG, STRING = T.LongType(), T.StringType()
PACKET = _struct(track=LONG, packet=LONG, timestamp_ns=LONG, duration_ns=LONG, keyframe=T.BooleanType(), cluster_offset=LONG, offset=LONG, size=LONG)
TRACK = _struct(number=LONG, kind=LONG, codec=STRING, rate=T.DoubleType(), channels=LONG, bits=LONG, default_ns=LONG)
CUE = _struct(timestamp_ns=LONG, track=LONG, cluster_offset=LONG)
PARSED = _struct(packets=T.ArrayType(PACKET), tracks=T.ArrayType(TRACK), cues=T.ArrayType(CUE), clusters=LONG, duration_ns=LONG, error=STRING)


def _columns(media: bytes | None) -> tuple:
    """A file as the values of ``PARSED``."""
    if media is None:
        return (None,) * 6
    try:
        m = parse(media)
    except ValueError as e:
        return *(None,) * 5, str(e)
    named = lambda kind, rows: [dict(zip(kind.names, row)) for row in rows]
    return named(PACKET, m.packets), named(TRACK, [m.tracks[n] for n in sorted(m.tracks)]), named(CUE, m.cues), m.clusters, m.duration_ns, None


def parse_media(df: DataFrame, keep: list[str], media_col: str = "media", out: str = "parsed") -> DataFrame:
    """The columns ``keep`` and, as one struct ``out``, of each file its packets, tracks, cues, number of clusters, duration and ``error``."""

    def start():
        return lambda files: [[dict(zip(PARSED.names, _columns(f))) for f in files]]

    return map_text(df, start, media_col, keep, T.StructType([T.StructField(out, PARSED)]))


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of each Matroska file in ``media_col``; a file that can't be parsed gives one row with ``error``."""
    found = parse_media(df, [id_col], media_col, "__parsed")
    error = F.col("__parsed.error")
    packets = F.when(error.isNotNull(), F.array(F.lit(None).cast(PACKET))).otherwise(F.col("__parsed.packets"))
    return found.select(F.col(id_col).alias("media_id"), error.alias("error"), F.explode(packets).alias("p")).select("media_id", "p.*", "error")


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """``payload`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return payload + b"\xff" * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


STORED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text (null: empty) as a Matroska file of 8-bit samples in a binary column."""

    def start():
        def work(texts):
            raw = [(t or "").encode() for t in texts]
            return [len(b) for b in raw], [mux(pad(b)) for b in raw]

        return work

    return map_text(df, start, text_col, [id_col], STORED)


FEATURES = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def digest(file: dict) -> tuple:
    """The payload that a stored file's packets hold, read by their byte ranges, as digests and a feature string."""
    media = file["media"]
    if media is None:
        return (None,) * 6
    whole = len(media), hashlib.sha256(media).hexdigest()
    if file["error"] is not None:
        return None, None, None, *whole, f"error: {file['error']}"
    packets, cues, track = file["packets"], file["cues"], file["track"]
    payload = b"".join([media[p["offset"] : p["offset"] + p["size"]] for p in packets])
    known = f"{track['codec']};{track['rate']:.0f};{track['channels']};{track['bits']}" if track else "no track"
    good = set(cues) <= {p["cluster_offset"] for p in packets}
    feature = f"{known};packets={len(packets)};clusters={file['clusters']};cues={len(cues)}{'' if good else '?'};ms={file['duration_ns'] // 1_000_000}"
    if payload:
        x = np.frombuffer(payload, np.uint8).astype(np.float64)
        feature += f";mean={x.mean():.3f};rms={np.sqrt(np.mean((x - 128) ** 2)):.3f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *whole, feature


def media_features(df: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """Digests and features of the stored files, of the first track's packets; null for null media, digests null where there is an error."""
    kept = df.select(*keep, F.col(media_col).alias("__media"))
    parsed, x = parse_media(kept, [*keep, "__media"], "__media", "__parsed"), F.col("__parsed")
    track = F.when(F.size(x["tracks"]) > 0, F.element_at(x["tracks"], 1))
    own = F.filter(x["packets"], lambda p: track.isNull() | (p["track"] == track["number"]))
    ranges = F.transform(own, lambda p: F.struct(p["offset"].alias("offset"), p["size"].alias("size"), p["cluster_offset"].alias("cluster_offset")))
    file = F.struct(F.col("__media").alias("media"), ranges.alias("packets"), track.alias("track"), x["cues"]["cluster_offset"].alias("cues"), x["clusters"].alias("clusters"), x["duration_ns"].alias("duration_ns"), x["error"].alias("error"))

    def start():
        return lambda files: list(zip(*map(digest, files))) or [[]] * 6

    return map_text(parsed.select(*keep, file.alias("__file")), start, "__file", keep, FEATURES)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as Matroska and read back."""
    return media_features(store_texts(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
