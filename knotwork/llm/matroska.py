"""Media columns: Matroska files of 8-bit PCM, written and parsed without a media library.

``mux`` stores a payload as one mono track of unsigned 8-bit samples at 8 kHz: 512-byte
frames, eight to a laced SimpleBlock, sixteen blocks to a cluster, a cue for each cluster.
``parse`` walks the variable-length EBML elements (known and unknown sizes), all three
lacings, SimpleBlocks and BlockGroups, and cues, and returns a packet table whose byte
ranges point into the file. Both work on one file in memory, so a task holds one document's
media at a time besides its Arrow batch.

A null text is the empty text, whose payload is 64 zero bytes. Equal texts give equal
files: nothing in them depends on ids, clocks or chance. Bytes that are not a complete
Matroska file raise ``ValueError`` in ``parse``; ``packet_table`` gives no row for a null
media value. Repeated rows and extra columns are carried through as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element ids of the Matroska specification (fixed values).
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, LACING, CODEC, DEFAULT_NS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME, LACE, BLOCKS = 512, 8, 16
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length integer, as short as possible or ``width`` bytes long."""
    while width == 0 or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: int) -> bytes:
    """Frame count, sizes and bodies of a laced block."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif mode == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < 1 << 7 * width - 1:
                width += 1
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], mode: int | None = None) -> bytes:
    """Body of a SimpleBlock; without a mode, equal frames use fixed lacing and others EBML lacing."""
    if len(frames) == 1:
        mode = NO_LACING
    elif mode is None:
        mode = FIXED if len({len(f) for f in frames}) == 1 else EBML_LACING
    head = vint(track) + struct.pack(">hB", relative, 0x80 | mode << 1)
    return head + (frames[0] if mode == NO_LACING else lace(frames, mode))


_HEADER = element(
    EBML,
    unsigned(VERSION, 1) + unsigned(READ_VERSION, 1) + unsigned(MAX_ID, 4) + unsigned(MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        ENTRY,
        unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + unsigned(LACING, 1) + unsigned(DEFAULT_NS, FRAME * 125_000)
        + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", 8000.0)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds ``payload``; a millisecond is 8 bytes of it."""
    info = element(INFO, unsigned(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / 8)) + element(MUXER, b"knotwork") + element(WRITER, b"knotwork"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for c in range(0, len(payload), FRAME * LACE * BLOCKS):
        body = [unsigned(TIMESTAMP, c // 8)]
        for b in range(c, min(c + FRAME * LACE * BLOCKS, len(payload)), FRAME * LACE):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + FRAME * LACE, len(payload)), FRAME)]
            body.append(element(SIMPLE, block(1, (b - c) // 8, frames)))
        cues.append(element(POINT, unsigned(CUE_TIME, c // 8) + element(POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What ``parse`` finds. Packets: (track, cluster, timestamp_ns, start, size, keyframe, lacing)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    segment: int = 0


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value, next position and width of the variable-length integer at ``at``."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the file ends inside a variable-length integer")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep_marker else value & (1 << 7 * width) - 1), at + width, width


def elements(data: bytes, at: int, end: int, until: frozenset = frozenset()):
    """(id, start of body, end of body) of the elements in a range.

    An element of unknown size reaches to the end of the range, or for a cluster to the next
    element that cannot be inside one.
    """
    while at < end:
        ident, body, _ = read_vint(data, at, True)
        size, body, width = read_vint(data, body)
        if ident in until:
            return
        stop = body + size
        if size == (1 << 7 * width) - 1:
            stop = end
            if ident == CLUSTER:
                stop = body
                for _, _, stop in elements(data, body, end, frozenset({CLUSTER, CUES, TRACKS, INFO})):
                    pass
        if stop > end:
            raise ValueError(f"element {ident:x} reaches beyond its parent")
        yield ident, body, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _frames(data: bytes, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and frame ranges of a block body."""
    track, a, _ = read_vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, a)
    a += 3
    mode = flags >> 1 & 3
    if mode == NO_LACING:
        return track, relative, flags, [(a, b - a)]
    count, a = data[a] + 1, a + 1
    sizes: list[int] = []
    if mode == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[a] == 255:
                size, a = size + 255, a + 1
            sizes.append(size + data[a])
            a += 1
    elif mode == EBML_LACING:
        for i in range(count - 1):
            value, a, width = read_vint(data, a)
            sizes.append(value if i == 0 else sizes[-1] + value - (1 << 7 * width - 1) + 1)
    else:
        if (b - a) % count:
            raise ValueError("fixed lacing with unequal frames")
        sizes = [(b - a) // count] * (count - 1)
    sizes.append(b - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames reach beyond their block")
    out = []
    for size in sizes:
        out.append((a, size))
        a += size
    return track, relative, flags, out


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file."""
    out, seen = Media(), False
    for ident, a, b in elements(data, 0, len(data)):
        seen |= ident == EBML
        if ident != SEGMENT:
            continue
        out.segment = a
        for part, pa_, pb in elements(data, a, b):
            if part == INFO:
                for i, x, y in elements(data, pa_, pb):
                    if i == SCALE:
                        out.scale = _number(data, x, y)
                    elif i == DURATION:
                        out.duration = _float(data, x, y)
            elif part == TRACKS:
                for i, x, y in elements(data, pa_, pb):
                    if i == ENTRY:
                        t = {"codec": "", "kind": 0, "default_ns": 0}
                        for j, p, q in elements(data, x, y):
                            if j == NUMBER:
                                t["number"] = _number(data, p, q)
                            elif j == KIND:
                                t["kind"] = _number(data, p, q)
                            elif j == CODEC:
                                t["codec"] = data[p:q].decode("ascii")
                            elif j == DEFAULT_NS:
                                t["default_ns"] = _number(data, p, q)
                        out.tracks[t["number"]] = t
            elif part == CLUSTER:
                _cluster(data, pa_, pb, out)
            elif part == CUES:
                for i, x, y in elements(data, pa_, pb):
                    if i == POINT:
                        when = 0
                        for j, p, q in elements(data, x, y):
                            if j == CUE_TIME:
                                when = _number(data, p, q)
                            elif j == POSITIONS:
                                d = {k: _number(data, r, s) for k, r, s in elements(data, p, q)}
                                out.cues.append((when, d.get(CUE_TRACK, 0), out.segment + d.get(CUE_CLUSTER, 0)))
    if not seen or not out.segment:
        raise ValueError("not a Matroska file")
    return out


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    # the id takes 4 bytes, and a cue points at it
    start, base = a, 0
    while data[start : start + 4] != b"\x1f\x43\xb6\x75":
        start -= 1
    number = len(out.clusters)
    out.clusters.append(start)
    for ident, x, y in elements(data, a, b):
        key = ident == SIMPLE
        if ident == TIMESTAMP:
            base = _number(data, x, y)
            continue
        if ident == GROUP:
            inner = list(elements(data, x, y))
            key = all(i != REFERENCE for i, _, _ in inner)
            x, y = next((p, q) for i, p, q in inner if i == BLOCK)
        elif ident != SIMPLE:
            continue
        track, relative, flags, frames = _frames(data, x, y)
        key = bool(flags & 0x80) if ident == SIMPLE else key
        step = out.tracks.get(track, {}).get("default_ns", 0)
        for i, (at, size) in enumerate(frames):
            out.packets.append((track, number, (base + relative) * out.scale + i * step, at, size, key, flags >> 1 & 3))


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets, one after the other."""
    return b"".join(data[p[3] : p[3] + p[4]] for p in media.packets if p[0] == track)


def padded(raw: bytes) -> bytes:
    """Zero bytes added up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 if raw else 64)


def media_column(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """``docs`` with a column of Matroska files made from a text column."""
    fields = [f for f in docs.schema if f.name != out_col]

    def run(batches):
        for batch in batches:
            made = [mux(padded((x or "").encode())) for x in batch.column(text_col).to_pylist()]
            kept = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(made, pa.binary())], names=[*kept, out_col])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.BinaryType())]))


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id, track, cluster, packet, timestamp_ns, start, size, keyframe, lacing, cued.

    ``cued`` is true for packets of a cluster that a cue points at.
    """

    def run(batches):
        names = ["id", "track", "cluster", "packet", "timestamp_ns", "start", "size", "keyframe", "lacing", "cued"]
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                m = parse(data)
                cued = {m.clusters.index(at) for _, _, at in m.cues if at in m.clusters}
                rows += [(i, t, c, n, ts, at, size, key, mode, c in cued) for n, (t, c, ts, at, size, key, mode) in enumerate(m.packets)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col)).mapInArrow(
        run, "id long, track int, cluster int, packet int, timestamp_ns long, start long, size long, keyframe boolean, lacing int, cued boolean"
    )


def features(payload: bytes, media: Media) -> str:
    """Features of a payload that was read back: container counts, level and crossings."""
    x = np.frombuffer(payload, np.uint8)
    above = x > 100
    cued = {at for _, _, at in media.cues} == set(media.clusters)
    return (
        f"tracks={len(media.tracks)};clusters={len(media.clusters)};packets={len(media.packets)};cues={len(media.cues)};cued={int(cued)};"
        f"ms={media.duration:.0f};sum={int(x.sum(dtype=np.int64))};max={int(x.max())};crossings={int(np.count_nonzero(above[1:] != above[:-1]))}"
    )


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read the stored bytes back, and describe both."""
    stored = media_column(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def run(batches):
        for batch in batches:
            rows = []
            for text, data in zip(batch.column("text").to_pylist(), batch.column("media").to_pylist()):
                m = parse(data)
                payload = payload_of(data, m)
                rows.append((len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, m), len(m.packets)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"
    )
