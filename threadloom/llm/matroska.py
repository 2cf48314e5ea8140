"""Media columns in Matroska: writing byte samples as laced blocks, and parsing files back into packet tables.

The element ids, the variable-length integers and the three lacings are those of the public EBML (RFC 8794) and
Matroska (RFC 9559) specifications.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

# Fixed values of the format: element ids.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE = 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
#: What ends an element of unknown size: elements of a segment, or of the file.
TOP_LEVEL = {EBML, SEGMENT}
SEGMENT_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME = 576
PAD = 255
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32
#: One frame lasts so many ticks, and a tick so many nanoseconds.
TICKS = 72
SCALE = 1_000_000


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least width; the all-ones pattern is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The frames behind a block's header, with the sizes that the lacing needs."""
    if lacing == NO_LACING:
        return b"".join(frames)
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in frames[:-1])
    elif lacing == EBML_LACING:
        sizes = [len(x) for x in frames[:-1]]
        for i, n in enumerate(sizes):
            if i == 0:
                head += vint(n)
            else:
                step = n - sizes[i - 1]
                width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
                head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, track: int = 1, frame: int = FRAME, frames_a_block: int = FRAMES_A_BLOCK, blocks_a_cluster: int = BLOCKS_A_CLUSTER) -> bytes:
    """A file with the payload as unsigned 8-bit samples. Blocks take the three lacings in turn; one of a single frame has none."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, b"\x45\xfa\x00\x00") + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    about = number(TRACK_NUMBER, track) + number(TRACK_UID, track) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, TICKS * SCALE)
    entry = element(TRACK_ENTRY, about + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    body = [element(INFO, number(TIMESTAMP_SCALE, SCALE)), element(TRACKS, entry)]
    at, cues, block = sum(map(len, body)), [], 0
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    step = frames_a_block * blocks_a_cluster
    for first in range(0, len(frames), step):
        start = first * TICKS
        parts = [number(TIMESTAMP, start)]
        for i in range(first, min(first + step, len(frames)), frames_a_block):
            own = frames[i : min(i + frames_a_block, first + step)]
            lacing = NO_LACING if len(own) == 1 else (XIPH, FIXED, EBML_LACING)[block % 3]
            if lacing == FIXED and len(set(map(len, own))) > 1:
                lacing = XIPH
            head_ = vint(track) + (i * TICKS - start).to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
            body_ = head_ + laced(own, lacing)
            parts.append(element(SIMPLE_BLOCK, body_) if block % 4 else element(BLOCK_GROUP, element(BLOCK, body_)))
            block += 1
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, track) + number(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass(slots=True)
class Packet:
    """A frame: its track, its timestamp in ticks, its bytes' place in the file, and what holds it."""

    track: int
    timestamp: int
    start: int
    size: int
    cluster: int
    block: int
    lacing: int
    key: bool


@dataclass(slots=True)
class Track:
    """A track's number, type and codec, and the nanoseconds that one frame lasts (0: not said)."""

    number: int = 0
    kind: int = 0
    codec: str = ""
    duration: int = 0


@dataclass
class Parsed:
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]
    doc_type: str = ""
    scale: int = SCALE
    tracks: list[Track] = field(default_factory=list)


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value (with its marker, if kept), the place after it, and its width."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the integer at byte {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    return n if keep else n ^ 1 << 7 * width, at + width, width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Each element in turn: id, its place, its body's place and end.

    A size of all ones is unknown: a segment then runs to the next element of the file's level, a cluster (or another part of a
    segment) to the next one of the segment's or the file's, or to the end of what holds it.
    """
    while at < end:
        kind, body, _ = read_vint(data, at, keep=True)
        size, body, width = read_vint(data, body)
        stop = body + size
        if size == (1 << 7 * width) - 1:
            over, stop = TOP_LEVEL if kind in TOP_LEVEL else TOP_LEVEL | SEGMENT_LEVEL, body
            while stop < end and read_vint(data, stop, keep=True)[0] not in over:
                stop = next(elements(data, stop, end))[3]
        if stop > end:
            raise ValueError(f"the element at byte {at} is cut off")
        yield kind, at, body, stop
        at = stop


def sizes_of(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of a block's frames and where the first one begins."""
    if lacing == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("frames of a fixed lacing differ in size")
        return [(end - at) // count] * count, at
    for i in range(count - 1):
        if lacing == XIPH:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            n, at, width = read_vint(data, at)
            if i:
                n += sizes[-1] - (1 << 7 * width - 1) + 1
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lacing's sizes exceed its block")
    return sizes, at


def parse(data: bytes) -> Parsed:
    """The packet table of a file, its tracks, its cue points (time, track, cluster's place in the file) and the places of its clusters."""
    found = Parsed([], [], [])
    whole = lambda body, stop: int.from_bytes(data[body:stop], "big")
    block = -1
    durations: dict[int, int] = {}

    def take(body: int, stop: int, cluster: int, start: int, simple: bool, lasts: int | None = None) -> None:
        """The frames of a block. A laced frame begins where the one before ends: by the track's default duration, else by its share of the block's."""
        nonlocal block
        block += 1
        track, at, _ = read_vint(data, body)
        time, flags = start + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        lacing = flags >> 1 & 3
        sizes, at = sizes_of(data, at + 3, stop, lacing)
        step = durations.get(track, 0) / found.scale or (lasts or 0) / len(sizes)
        for i, n in enumerate(sizes):
            found.packets.append(Packet(track, time + round(i * step), at, n, cluster, block, lacing, bool(flags & 0x80) if simple else True))
            at += n

    def entry(body: int, stop: int) -> Track:
        own = {k: (b, s) for k, _, b, s in elements(data, body, stop)}
        n = lambda k: whole(*own[k]) if k in own else 0
        codec = data[slice(*own[CODEC_ID])].decode("ascii", "replace").rstrip("\x00") if CODEC_ID in own else ""
        return Track(n(TRACK_NUMBER), n(TRACK_TYPE), codec, n(DEFAULT_DURATION))

    for kind, _, body, stop in elements(data, 0, len(data)):
        if kind == EBML:
            found.doc_type = next((data[b:s].decode() for k, _, b, s in elements(data, body, stop) if k == DOC_TYPE), "")
        elif kind == SEGMENT:
            base = body
            for k, at, b, s in elements(data, body, stop):
                if k == INFO:
                    found.scale = next((whole(x, y) for i, _, x, y in elements(data, b, s) if i == TIMESTAMP_SCALE), found.scale)
                elif k == TRACKS:
                    found.tracks += [entry(x, y) for i, _, x, y in elements(data, b, s) if i == TRACK_ENTRY]
                    durations |= {t.number: t.duration for t in found.tracks}
                elif k == CLUSTER:
                    start = 0
                    found.clusters.append(at)
                    for i, _, x, y in elements(data, b, s):
                        if i == TIMESTAMP:
                            start = whole(x, y)
                        elif i == SIMPLE_BLOCK:
                            take(x, y, len(found.clusters) - 1, start, True)
                        elif i == BLOCK_GROUP:
                            parts = {j: (v, w) for j, _, v, w in elements(data, x, y)}
                            if BLOCK in parts:
                                lasts = whole(*parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                                take(*parts[BLOCK], len(found.clusters) - 1, start, False, lasts)
                elif k == CUES:
                    for i, _, x, y in elements(data, b, s):
                        if i == CUE_POINT:
                            point = {j: (v, w) for j, _, v, w in elements(data, x, y)}
                            place = {j: whole(v, w) for j, _, v, w in elements(data, *point[CUE_TRACK_POSITIONS])}
                            found.cues.append((whole(*point[CUE_TIME]), place[CUE_TRACK], base + place[CUE_CLUSTER_POSITION]))
    return found


def payload_of(text: str, frame: int = FRAME) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // frame)) * frame - len(raw)), len(raw)


PACKETS = "doc_id long, packet int, track int, timestamp long, start long, size int, cluster int, block int, lacing int, key boolean"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (a Matroska file) for each row. A null text is stored as an empty one; equal texts give equal files, repeated rows a row each, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            made = [payload_of(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """A row per frame of each file of the column media: its track, timestamp, byte range, cluster, block and lacing. Null media have no rows; broken files raise ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [(doc, i, p) for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data is not None for i, p in enumerate(parse(data).packets)]
            columns = [[r[0] for r in rows], [r[1] for r in rows], *([getattr(r[2], k) for r in rows] for k in ("track", "timestamp", "start", "size", "cluster", "block", "lacing", "key"))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "packet", "track", "timestamp", "start", "size", "cluster", "block", "lacing", "key"])

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)


def feature(parsed: Parsed) -> str:
    """Counts of packets, blocks and clusters, last timestamp, blocks by lacing, and whether each cue names a cluster of its own."""
    lacings = {p.block: p.lacing for p in parsed.packets}
    kinds = "/".join(str(sum(x == k for x in lacings.values())) for k in (NO_LACING, XIPH, FIXED, EBML_LACING))
    cued = [c for _, _, c in parsed.cues] == parsed.clusters
    return f"packets={len(parsed.packets)};blocks={len(lacings)};clusters={len(parsed.clusters)};last={parsed.packets[-1].timestamp if parsed.packets else -1};lacings={kinds};cued={str(cued).lower()}"


def digest(media: DataFrame) -> DataFrame:
    """doc_id and n_bytes with what the stored files hold: payload read back by the packets' byte ranges, hashes and a feature string. A row per row; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = []
            for doc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parsed = parse(data)
                payload = b"".join(data[p.start : p.start + p.size] for p in parsed.packets)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(parsed)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files go from one operator to the next within a task; nothing is shuffled."""
    return digest(store(table(spark, sf_dir, "documents")))
