"""Ogg media columns: writing and reading physical streams (RFC 3533).

The writer lays packets of several logical streams into pages of at most 255 lacing values, continuing
packets over page ends; the reader checks every page checksum and sequence number, reassembles packets
from lacing values, separates logical streams by serial number and derives timestamps from granule
positions. Checksums run at C speed: the format's CRC is the bit-mirrored zlib CRC with zero start.

Defined cases: a null text is the empty text; the empty text is 192 spaces once padded; any damaged page,
gap in sequence, missing end or stray continuation raises ``ValueError``; equal payloads give equal media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import tune, utf8

FRAME = 192
RATE = 8000
#: Samples in a packet: a whole number of frames.
PACKET = 10 * FRAME
TRACKS = 2
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
INTRO = struct.Struct("<8sIIBB")


def checksum(page: bytes) -> int:
    """CRC-32 of the format: polynomial 04c11db7, most significant bit first, start 0, no final inversion."""
    c = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(MIRROR), "big")


def page(serial: int, seq: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    return b"".join((head[:22], struct.pack("<I", checksum(head + body)), head[26:], body))


def pages(serial: int, packets: list[bytes], ends: list[int], max_segments: int = 255) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream as (granule of its last finished packet, page). ``ends``: the granule
    position at the end of each packet. The first packet has a page of its own."""
    segments: list[tuple[int, bytes, int]] = []  # lacing value, bytes, granule if the packet ends here else -1
    seq, flags, last = 0, FIRST, len(packets) - 1
    for k, (p, end) in enumerate(zip(packets, ends, strict=True)):
        full, rest = divmod(len(p), 255)
        cuts = [(255, p[i * 255 : i * 255 + 255], -1) for i in range(full)] + [(rest, p[full * 255 :], end)]
        for j, c in enumerate(cuts):
            segments.append(c)
            done = k == last and j == len(cuts) - 1
            if len(segments) == max_segments or done or (k == 0 and j == len(cuts) - 1):
                granule = next((g for _, _, g in reversed(segments) if g >= 0), -1)
                yield granule, page(serial, seq, flags | LAST * done, granule, bytes(s[0] for s in segments), b"".join(s[1] for s in segments))
                flags, segments, seq = CONTINUED * (c[2] < 0), [], seq + 1


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """(serial, sequence, flags, granule, lacing, offset of the body) of each page, checksum verified."""
    at, n = 0, len(media)
    while at < n:
        if n - at < 27:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, seq, crc, count = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if len(lacing) < count or end > n:
            raise ValueError("truncated page")
        if checksum(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : end]))) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        yield serial, seq, flags, granule, lacing, body
        at = end


def demux(media: bytes) -> dict[int, tuple[list[bytes], list[int]]]:
    """serial -> (packets, granule of each page end that closes packets, spread to the packet it belongs to;
    -1 for packets closed earlier on a page)."""
    out: dict[int, tuple[list[bytes], list[int]]] = {}
    state: dict[int, list] = {}
    for serial, seq, flags, granule, lacing, body in read_pages(media):
        if flags & FIRST:
            if serial in state:
                raise ValueError("stream begins twice")
            state[serial], out[serial] = [0, [], False], ([], [])
        if serial not in state:
            raise ValueError("page of a stream that never began")
        s = state[serial]
        if s[2] or s[0] != seq:
            raise ValueError("pages missing or after the end")
        if bool(flags & CONTINUED) != bool(s[1]):
            raise ValueError("continuation flag and packets disagree")
        s[0] += 1
        packets, granules = out[serial]
        at = body
        closed = False
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                s[1].append(media[at : at + run])
                packets.append(b"".join(s[1]) if len(s[1]) > 1 else s[1][0])
                granules.append(-1)
                s[1], at, run, closed = [], at + run, 0, True
        if run:
            s[1].append(media[at : at + run])
        if closed:
            granules[-1] = granule
        elif granule != -1:
            raise ValueError("granule position on a page that ends no packet")
        s[2] = bool(flags & LAST)
    if any(not s[2] or s[1] for s in state.values()):
        raise ValueError("a stream has no end")
    return out


def encode(payload: bytes, packet: int = PACKET, tracks: int = TRACKS) -> bytes:
    """8-bit samples dealt packet by packet to ``tracks`` logical streams; granules count a track's samples."""
    base = zlib.crc32(payload)
    streams = []
    for k in range(tracks):
        serial = (base + k * 0x9E3779B1) & 0xFFFFFFFF
        own = [payload[i : i + packet] for i in range(k * packet, len(payload), packet * tracks)]
        ends = [0]
        for p in own:
            ends.append(ends[-1] + len(p))
        intro = INTRO.pack(b"pcm8mono", RATE, packet, k, tracks)
        streams.append(list(pages(serial, [intro, *own], ends)))
    first = [s[0][1] for s in streams]
    rest = sorted(((n, k, p) for k, s in enumerate(streams) for n, (_, p) in enumerate(s[1:])), key=lambda x: x[:2])
    return b"".join([*first, *(p for _, _, p in rest)])


def decode(media: bytes) -> tuple[bytes, list[list[float]]]:
    """(payload, for each track the end time in seconds of every packet) of ``encode``'s media."""
    by_track: dict[int, list[bytes]] = {}
    times: dict[int, list[float]] = {}
    total = 0
    for packets, granules in demux(media).values():
        magic, rate, _, k, total = INTRO.unpack(packets[0])
        if magic != b"pcm8mono" or k in by_track:
            raise ValueError("unknown or repeated track")
        at, own = 0, []
        for p, g in zip(packets[1:], granules[1:], strict=True):
            at += len(p)  # within a page, positions follow from the packets' samples
            if g not in (-1, at):
                raise ValueError("granule position and samples disagree")
            own.append(at / rate)
        by_track[k], times[k] = packets[1:], own
    if sorted(by_track) != list(range(total)):
        raise ValueError("a track is missing")
    most = max(map(len, by_track.values()))
    return b"".join(by_track[k][i] for i in range(most) for k in range(total) if i < len(by_track[k])), [times[k] for k in range(total)]


def pad(text: bytes, unit: int = FRAME) -> bytes:
    return text + b" " * (-len(text) % unit if text else unit)


def feature(payload: bytes, times: list[list[float]]) -> str:
    """Whole-number signal features: samples, per-mille mean and root mean square about 128, crossings of
    the middle, frames above it, and milliseconds by granule positions."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    n = len(x)
    energy = (x * x).reshape(-1, FRAME).sum(axis=1, dtype=np.int64)
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    ms = round(1000 * sum(t[-1] for t in times if t))
    return f"n={n};mean={int(x.sum(dtype=np.int64)) * 1000 // n};rms={int((int(energy.sum()) / n) ** 0.5 * 1000)};zc={cross};loud={int(np.count_nonzero(energy > energy.mean()))};ms={ms}"


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): the stored form of every text."""

    def store(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    tune(docs.sparkSession)
    src = docs.select(F.col(id_col), utf8(text_col).alias("t"))
    return src.mapInArrow(store, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def digest_table(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads media back (verifying it) and returns its digests and features."""

    def back(batches):
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                p, times = decode(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, times)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "n_bytes", *NAMES])

    ddl = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, "n_bytes", "media").mapInArrow(back, ddl)


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
