"""MPEG audio columns: a frame writer for lossless payloads, and a reader for any MPEG audio stream.

The reader reads ID3v2.2 to 2.4 tags (unsynchronised, with extended header or footer too) and ID3v1, resynchronises on frame headers (a
header counts when the next one, or the end of the stream, is where it says), reads the Xing, Info or VBRI table of a variable-bitrate
file with its seek points, verifies the CRC-16 of protected frames of all three layers, and returns exact sample
counts and the byte offset of every frame. Free-format frames (no bitrate in the header) are passed over as bytes of no frame.

The writer stores a payload in the main data of mono MPEG-1 layer III frames (unit: one frame): full 320 kbit/s
frames, then the smallest bitrate that holds the rest, so the file is of variable bitrate and starts with a Xing
frame. An ID3v2 text frame holds the payload's length. ``unpack(parse(pack(x))) == x`` for any bytes. Beside the media the table holds
the exact duration (samples and sample rate) and the seek offset of every frame.

Defined results: a null text counts as empty; an empty text is 64 zero bytes; equal texts give equal media; rows
with an equal doc_id are separate; an empty table gives no rows; other columns are not read. ``features`` takes any media:
null media has null features, a stream without frames has none of them, and media that the writer did not make
has no payload (null).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_batches, stored

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer), sample rates by version.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC16 = 0x8005

RATE = 32000
SIDE = 17
HEAD = 4 + 2 + SIDE


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None for free-format, reserved or broken values."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    kbps, hertz, pad = KBPS[version == 3, layer][bitrate], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    return Header(version, layer, not four[1] & 1, kbps, hertz, four[3] >> 6 == 3, size, samples)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC16 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


# Fixed values of layer II: bits of allocation by subband, for the five tables (27, 30, 8, 12 and, at low sample rates, 30 subbands).
ALLOCATION = {
    27: (4,) * 11 + (3,) * 12 + (2,) * 4,
    30: (4,) * 11 + (3,) * 12 + (2,) * 7,
    8: (4,) * 2 + (3,) * 6,
    12: (4,) * 2 + (3,) * 10,
    0: (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def allocation(h: Header) -> tuple[int, ...]:
    """Bits of allocation of each subband of a layer I or II frame."""
    if h.layer == 1:
        return (4,) * 32
    if h.version != 3:
        return ALLOCATION[0]
    each = h.kbps // (1 if h.mono else 2)
    if each <= 48:
        return ALLOCATION[12 if h.rate == 32000 else 8]
    return ALLOCATION[27 if each <= 80 or h.rate == 48000 else 30]


def checked(h: Header, frame: bytes) -> bytes | tuple[bytes, int]:
    """What the frame's checksum covers: bytes, or bytes and a number of bits of them."""
    if h.layer == 3:
        return frame[2:4] + frame[6 : 6 + h.side]
    mode, bound = frame[3] >> 6, 4 * ((frame[3] >> 4 & 3) + 1)
    bits = int.from_bytes(frame[6 : 6 + 64], "big") << (8 * (64 - len(frame[6:70])))
    taken, selected = 0, 0
    for band, width in enumerate(allocation(h)):
        channels = 1 if h.mono else 2
        for _ in range(1 if mode == 1 and band >= bound else channels):
            value = bits >> (512 - taken - width) & ((1 << width) - 1)
            taken += width
            if value:  # a joint subband has scale factors for both channels
                selected += 2 * channels if mode == 1 and band >= bound else 2
    return frame[2:4] + frame[6:70], 16 + taken + (selected if h.layer == 2 else 0)


def crc_of(covered: bytes | tuple[bytes, int]) -> int:
    if isinstance(covered, bytes):
        return crc16(covered)
    data, bits = covered
    crc = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1 if i // 8 < len(data) else 0
        crc = (crc << 1 ^ CRC16 if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


@dataclass
class Parsed:
    tags: dict[str, str] = field(default_factory=dict)
    frames: list[tuple[int, Header]] = field(default_factory=list)  # offset, header; without the table's frame
    table: dict[str, int] | None = None
    seek: list[int] = field(default_factory=list)  # the table's points: byte offsets in the stream, evenly spaced in time
    skipped: int = 0  # bytes that belong to no frame and no tag
    protected: int = 0
    crc_errors: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds, exact."""
        by_rate: dict[int, int] = {}
        for _, h in self.frames:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum((Fraction(n, r) for r, n in by_rate.items()), Fraction(0))


def syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def text_of(data: bytes) -> str:
    return data[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[0], "utf-8"), "replace")


def tag_frames(body: bytes, major: int) -> dict[str, str]:
    """Text frames of an ID3v2 tag body; user-defined ones as ``TXXX:name`` (``TXX:name`` in version 2.2)."""
    out, at = {}, 0
    name_size, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + name_size].strip(b"\0"):
        name = body[at : at + name_size].decode("latin-1")
        size = body[at + name_size : at + 2 * name_size]
        n = syncsafe(size) if major == 4 else int.from_bytes(size, "big")
        data = body[at + head : at + head + n]
        flags = body[at + 9] if major == 4 else 0
        if flags & 1:  # a data length stands first
            data = data[4:]
        if flags & 2:
            data = data.replace(b"\xff\x00", b"\xff")
        if name.startswith("T") and data and not flags & 12:  # packed or encrypted frames are not read
            text = text_of(data)
            if name in ("TXXX", "TXX"):
                key, _, text = text.partition("\0")
                name = f"{name}:{key}"
            out[name] = text.rstrip("\0")
        at += head + n
    return out


def leading_tag(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of the ID3v2 tag at the start, and where the stream goes on."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return {}, 0
    major, flags, n = data[3], data[5], syncsafe(data[6:10])
    body = data[10 : 10 + n]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and major > 2 and len(body) >= 4:
        body = body[syncsafe(body[:4]) if major == 4 and max(body[:4]) < 128 else 4 + int.from_bytes(body[:4], "big") :]
    return tag_frames(body, major) if major in (2, 3, 4) else {}, 10 + n + 10 * bool(major == 4 and flags & 0x10)


def seek_table(data: bytes, at: int, h: Header) -> tuple[dict[str, int], list[int]] | None:
    """A Xing, Info or VBRI table in the frame at ``at``: its numbers and seek points."""
    frame = data[at : at + h.size]
    place = 4 + 2 * h.protected + h.side
    number = lambda q, n=4: int.from_bytes(frame[q : q + n], "big")
    if frame[place : place + 4] in (b"Xing", b"Info"):
        flags, q = number(place + 4), place + 8
        table, seek = {"flags": flags}, []
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[name] = number(q)
                q += 4
        if flags & 4 and len(frame) >= q + 100:
            seek = [at + x * table.get("bytes", len(data) - at) // 256 for x in frame[q : q + 100]]
            q += 100
        if flags & 8:
            table["quality"] = number(q)
        return table, seek
    if frame[36:40] == b"VBRI":
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        table = {"version": number(40, 2), "quality": number(44, 2), "bytes": number(46), "frames": number(50), "frames_per_entry": number(60, 2)}
        seek, here = [], at + h.size
        for i in range(entries if 62 + entries * width <= len(frame) else 0):
            seek.append(here)
            here += scale * number(62 + i * width, width)
        return table, seek
    return None


def parse(data: bytes | None) -> Parsed:
    data = data or b""
    out, end = Parsed(), len(data)
    out.tags, at = leading_tag(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h is None or after > end or not (synced or after == end or header(data[after : after + 4])):
            synced = False
            step = data.find(b"\xff", at + 1, end)
            step = (end if step < 0 else step) - at
            at += step
            out.skipped += step
            continue
        synced = True
        if h.protected:
            out.protected += 1
            out.crc_errors += crc_of(checked(h, data[at:after])) != int.from_bytes(data[at + 4 : at + 6], "big")
        found = seek_table(data, at, h) if not out.frames and out.table is None and h.layer == 3 else None
        if found:
            out.table, out.seek = found
        else:
            out.frames.append((at, h))
        at = after
    out.skipped += max(0, end - at)
    return out


def _index(kbps: int) -> int:
    return KBPS[True, 3].index(kbps)


FITS = [(144 * 1000 * k // RATE - HEAD, k) for k in KBPS[True, 3][1:]]


@lru_cache(maxsize=64)
def frame_start(kbps: int) -> bytes:
    """Header, CRC and empty side information of a mono MPEG-1 layer III frame."""
    head = bytes([0xFF, 0xFA, _index(kbps) << 4 | 2 << 2, 0xC0])
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


def pack(payload: bytes) -> bytes:
    most, top = FITS[-1]
    full, rest = divmod(len(payload), most)
    body = [frame_start(top) + payload[i * most : (i + 1) * most] for i in range(full)]
    if rest:
        room, kbps = next(x for x in FITS if x[0] >= rest)
        body.append(frame_start(kbps) + payload[full * most :] + bytes(room - rest))
    n = str(len(payload)).encode()
    text = b"\0" + b"payload_bytes\0" + n
    inner = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(inner)
    tag = b"ID3\3\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + inner
    room, kbps = next(x for x in FITS if x[0] >= 120)
    total = sum(map(len, body)) + room + HEAD
    ends, at = [], room + HEAD
    for f in body or [b""]:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * ends[min(len(ends) - 1, i * len(ends) // 100)] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(body), total) + toc
    return tag + frame_start(kbps) + table + bytes(room - len(table)) + b"".join(body)


def unpack(data: bytes, parsed: Parsed) -> bytes | None:
    """The payload of media that pack() made; None for other media."""
    n = parsed.tags.get("TXXX:payload_bytes", "")
    if not n.isdecimal():
        return None
    got = b"".join(data[at + HEAD : at + h.size] for at, h in parsed.frames)
    return got[: int(n)] if len(got) >= int(n) else None


def feature(parsed: Parsed) -> str:
    """Frames, exact duration, checksum state and digests of the frame seek offsets and of the table's seek points."""
    d = parsed.duration
    offsets = b"".join(struct.pack("<Q", at) for at, _ in parsed.frames)
    points = b"".join(struct.pack("<q", at) for at in parsed.seek)
    rates = sorted({h.kbps for _, h in parsed.frames}) or [0]
    kinds = "+".join(sorted({f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version] }-l{h.layer}" for _, h in parsed.frames})) or "none"
    first, last = (parsed.frames[k][0] if parsed.frames else -1 for k in (0, -1))
    table = (parsed.table or {}).get("frames", -1)
    return f"{kinds};frames={len(parsed.frames)};duration={d.numerator}/{d.denominator};kbps={rates[0]}-{rates[-1]};vbr_frames={table};crc={parsed.protected - parsed.crc_errors}/{parsed.protected};skipped={parsed.skipped};first={first};last={last};seek={zlib.crc32(offsets):08x};points={zlib.crc32(points):08x}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


MEDIA = "doc_id long, n_bytes long, media binary, samples long, sample_rate int, seek_offsets array<long>"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, and what a player needs to seek in it: samples, sample_rate and the byte offset of every frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            both = [padded(t) for t in batch.column("text").to_pylist()]
            made = [pack(p) for _, p in both]
            offsets = [frame_offsets(len(p), len(m)) for (_, p), m in zip(both, made, strict=True)]
            values = [n for n, _ in both], made, [1152 * len(x) for x in offsets], [RATE] * len(made), offsets
            kinds = pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=[c.split()[0] for c in MEDIA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_batches, run, MEDIA)


def frame_offsets(payload: int, size: int) -> list[int]:
    """Where the frames of packed media start: all but the last are full, and the last ends the stream."""
    most, top = FITS[-1]
    count = -(-payload // most)
    rest = payload - (count - 1) * most
    last = size - next(room for room, _ in FITS if room >= rest) - HEAD
    return [last - (count - 1 - i) * (most + HEAD) for i in range(count)]


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, frames long, samples long, sample_rate int, seek_offsets array<long>"


def features(media: DataFrame) -> DataFrame:
    """Reads media (doc_id, n_bytes, media) of any origin and describes it, with exact durations and all frame seek offsets."""

    def described(i: int | None, n: int | None, data: bytes | None) -> tuple:
        if data is None:
            return (i, n, *[None] * 11)
        parsed = parse(data)
        payload = unpack(data, parsed)
        own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        rates = {h.rate for _, h in parsed.frames}
        return (i, n, *own, len(data), hashlib.sha256(data).hexdigest(), feature(parsed), float(parsed.duration), len(parsed.frames), sum(h.samples for _, h in parsed.frames), rates.pop() if len(rates) == 1 else None, [at for at, _ in parsed.frames])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        for batch in by_bytes(batches, "media"):
            rows = [described(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").transform(in_batches, run, FEATURES)


def store_and_read(docs: DataFrame) -> DataFrame:
    """The media table is written to the shared folder and read back for its features."""
    return features(stored(media_table(docs), "media"))
