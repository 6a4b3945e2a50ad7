"""Media columns in Matroska: a writer, and a parser of EBML elements into packet tables.

The parser walks variable-length element ids and sizes (unknown sizes included), descends into segments, clusters
and block groups, undoes Xiph, EBML and fixed-size lacing, and gives one row for each frame: track, timestamp in ns,
key flag, byte offset and size within the file. Cues come as (time, track, cluster position).

Defined results: a null value is an empty one; a damaged or foreign file raises ValueError in `parse`, and in
`packets` gives one row with a null track and the fault's text. Equal bytes give equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import map_rows, text_or_empty

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold others and are walked into.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a segment or a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367, SEGMENT, EBML}

NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3
RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, UNIT = 8000, 1024, 8, 3, 64


def vint(value: int, width: int = 0) -> bytes:
    """A size; the all-ones value of each width means unknown and is stepped over."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The body of a block after its flags."""
    if kind == NO_LACE:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACE:
        head += vint(sizes[0])
        for before, size in zip(sizes, sizes[1:-1], strict=False):
            diff = size - before
            width = next(w for w in range(1, 9) if abs(diff) < (1 << 7 * w - 1) - 1)
            head += vint(diff + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs equal frames")
    return head + b"".join(frames)


def simple_block(track: int, relative: int, frames: list[bytes], kind: int) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", relative, 0x80 | kind << 1) + lace(frames, kind))


def mux(samples: bytes) -> bytes:
    """One track of 8-bit PCM in laced blocks, a cluster for each BLOCKS_A_CLUSTER blocks, and a cue for each cluster."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    scale = 1_000_000_000 // RATE  # one tick is one sample
    info = element(INFO, number(TIMESTAMP_SCALE, scale) + element(DURATION, struct.pack(">d", len(samples))) + element(MUXING_APP, b"arealis") + element(WRITING_APP, b"arealis"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME * scale) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    span, block = FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER, FRAME * FRAMES_A_BLOCK  # few blocks keep relative timestamps within 16 bits
    for start in range(0, len(samples), span):
        blocks = []
        for s in range(start, min(start + span, len(samples)), block):
            part = samples[s : min(s + block, start + span)]
            frames = [part[k : k + FRAME] for k in range(0, len(part), FRAME)]
            kind = NO_LACE if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACE
            blocks.append(simple_block(1, s - start, frames, kind))
        cluster = element(CLUSTER, number(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        at += len(cluster)
        body.append(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass
class Parsed:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)  # track, ns, key, offset, size
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, absolute cluster offset
    clusters: list[int] = field(default_factory=list)


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length() if at < len(data) and data[at] else 9
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """None for an unknown size."""
    width = 9 - data[at].bit_length() if at < len(data) and data[at] else 9
    if width > 8 or at + width > len(data):
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, end) of the children between at and end."""
    while at < end:
        start = at
        key, at = read_id(data, at)
        size, at = read_size(data, at)
        if size is None:
            if key not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {key:x} at byte {start} has no size")
            stop = end if key == SEGMENT else next((s for k, s, _, _ in elements(data, at, end) if k in TOP), end)
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {key:x} at byte {start} ends beyond its parent")
        yield key, start, at, stop
        at = stop


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block's body."""
    if kind == NO_LACE:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACE:
        for k in range(count - 1):
            width = 9 - data[at].bit_length()
            value, at = read_size(data, at)
            value = (1 << 7 * width) - 1 if value is None else value
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % count:
            raise ValueError(f"block at byte {at} can't be cut into {count} equal frames")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing at byte {at} exceeds its block")
    offsets = [at]
    for size in sizes[:-1]:
        offsets.append(offsets[-1] + size)
    return list(zip(offsets, sizes, strict=True))


def parse(data: bytes) -> Parsed:
    out = Parsed()
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]

    def block(a: int, b: int, base: int, key: bool | None) -> None:
        track, a = read_size(data, a)
        relative, flags = struct.unpack(">hB", data[a : a + 3])
        spans = unlace(data, a + 3, b, flags >> 1 & 3)
        frame_ns = next((t["default_ns"] for t in out.tracks if t["number"] == track), 0)
        for k, (offset, size) in enumerate(spans):
            out.packets.append((track or 0, (base + relative) * out.scale + k * frame_ns, bool(flags & 0x80) if key is None else key, offset, size))

    def segment(a: int, b: int) -> None:
        origin = a
        for key, start, x, y in elements(data, a, b):
            if key == INFO:
                for k, _, p, q in elements(data, x, y):
                    if k == TIMESTAMP_SCALE:
                        out.scale = uint(p, q)
                    elif k == DURATION:
                        out.duration = real(p, q)
            elif key == TRACKS:
                for k, _, p, q in elements(data, x, y):
                    if k == TRACK_ENTRY:
                        track = {"number": 0, "type": 0, "codec": "", "default_ns": 0, "rate": 8000.0, "channels": 1, "bits": 0}
                        for e, _, m, n in elements(data, p, q):
                            if e == AUDIO:
                                for f, _, u, v in elements(data, m, n):
                                    if f == SAMPLING_FREQUENCY:
                                        track["rate"] = real(u, v)
                                    elif f in (CHANNELS, BIT_DEPTH):
                                        track["channels" if f == CHANNELS else "bits"] = uint(u, v)
                            elif e == CODEC_ID:
                                track["codec"] = data[m:n].decode("latin-1")
                            elif e in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                                track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns"}[e]] = uint(m, n)
                        out.tracks.append(track)
            elif key == CLUSTER:
                out.clusters.append(start)
                base = 0
                for k, _, p, q in elements(data, x, y):
                    if k == TIMESTAMP:
                        base = uint(p, q)
                    elif k == SIMPLE_BLOCK:
                        block(p, q, base, None)
                    elif k == BLOCK_GROUP:
                        inner = list(elements(data, p, q))
                        for e, _, m, n in inner:
                            if e == BLOCK:
                                block(m, n, base, all(z[0] != REFERENCE_BLOCK for z in inner))
            elif key == CUES:
                for k, _, p, q in elements(data, x, y):
                    if k == CUE_POINT:
                        time = 0
                        for e, _, m, n in elements(data, p, q):
                            if e == CUE_TIME:
                                time = uint(m, n)
                            elif e == CUE_TRACK_POSITIONS:
                                got = {f: uint(u, v) for f, _, u, v in elements(data, m, n)}
                                out.cues.append((time, got.get(CUE_TRACK, 0), origin + got.get(CUE_CLUSTER_POSITION, 0)))

    seen = False
    for key, _, a, b in elements(data, 0, len(data)):
        if key == EBML:
            seen = True
            out.doc_type = next((data[p:q].decode("latin-1") for k, _, p, q in elements(data, a, b) if k == DOC_TYPE), "")
        elif key == SEGMENT:
            if not seen:
                raise ValueError("no EBML header")
            segment(a, b)
    if not seen:
        raise ValueError("no EBML header")
    return out


def payload(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (a Matroska file that holds the padded text as 8-bit samples)."""

    def rows(part: pa.RecordBatch) -> dict:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        return {"id": part.column("id"), "n_bytes": [len(t) for t in texts], "media": pa.array([mux(payload(t)) for t in texts], pa.binary())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "text", f"id {kind}, n_bytes long, media binary", rows).withColumnRenamed("id", id_col)


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each frame: id, track, packet (0, 1, ...), timestamp_ns, key, byte_offset, byte_size, fault."""
    names = ("id", "track", "packet", "timestamp_ns", "key", "byte_offset", "byte_size", "fault")

    def rows(part: pa.RecordBatch) -> dict:
        found: list[tuple] = []
        for key, data in zip(part.column("id").to_pylist(), part.column("media").to_pylist(), strict=True):
            try:
                found += [(key, p[0], k, *p[1:], None) for k, p in enumerate(parse(data or b"").packets)]
            except (ValueError, IndexError, struct.error) as e:
                found.append((key, None, None, None, None, None, None, str(e)))
        return {n: [x[k] for x in found] for k, n in enumerate(names)}

    kind = media.schema[id_col].dataType.simpleString()
    return map_rows(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), "media", f"id {kind}, track int, packet long, timestamp_ns long, key boolean, byte_offset long, byte_size long, fault string", rows).withColumnRenamed("id", id_col)


def features(data: bytes) -> dict:
    """What the stored form gives back: its samples by way of the packet table, checksums and simple statistics."""
    parsed = parse(data)
    back = b"".join([data[o : o + n] for _, _, _, o, n in parsed.packets])
    x = np.frombuffer(back, "u1")
    signs = x >= 128
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    square = int((counts * (levels - 128) ** 2).sum())
    text = f"{parsed.doc_type};tracks={len(parsed.tracks)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};packets={len(parsed.packets)};samples={len(x)};sum={int((counts * levels).sum())};square={square};crossings={int((signs[1:] != signs[:-1]).sum())};last_ns={parsed.packets[-1][1]}"
    return {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": text}


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per row: id, n_bytes and the features of the stored file."""

    def rows(part: pa.RecordBatch) -> dict:
        found = [features(m) for m in part.column("media").to_pylist()]
        return {"id": part.column("id"), "n_bytes": part.column("n_bytes"), **{k: [f[k] for f in found] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}}

    kind = media.schema[id_col].dataType.simpleString()
    return map_rows(media.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media")), "media", f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows).withColumnRenamed("id", id_col)
