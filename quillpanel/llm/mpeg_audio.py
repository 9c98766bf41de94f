"""MPEG audio streams: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

The reader takes any bytes: it skips tags, resynchronises on a frame header whose successor agrees
with it, reads Xing, Info and VBRI tables, and verifies the checksum of every protected Layer I and
III frame. Durations are whole samples, without the encoder's delay and padding where they are named.

The writer stores bytes losslessly as the ancillary part of Layer III frames, whose own audio part is
empty: a tag that holds the number of bytes, a Xing frame with a seek table, and protected frames of
varying bitrate, the last one the smallest that holds the rest.

Defined cases: a null text is stored as an empty one, 64 zero bytes; repeated rows are stored row by
row, alike; bytes without a frame have no duration and no offsets; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: kbit/s by (MPEG 1 or 2, layer) and index; sampling rates by version bits and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: The checksum's polynomial and start.
POLYNOMIAL, START = 0x8005, 0xFFFF


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ (POLYNOMIAL if r & 0x8000 else 0)) & 0xFFFF
        table.append(r)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    r = START
    for b in data:
        r = (r << 8 & 0xFFFF) ^ _CRC[r >> 8 ^ b]
    return r


@dataclass(frozen=True)
class Header:
    version: int  # as in the header's bits: 3 is MPEG 1, 2 is MPEG 2, 0 is MPEG 2.5
    layer: int
    protected: bool
    bitrate: int  # bit/s
    rate: int
    mode: int  # 3: one channel
    extension: int
    length: int  # bytes of the frame
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.version == 3:
            return 17 if self.mode == 3 else 32
        return 9 if self.mode == 3 else 17

    @property
    def guarded(self) -> int | None:
        """Bytes after the checksum that it covers; None where they depend on tables not kept here."""
        if self.layer == 3:
            return self.side
        if self.layer == 1:
            return 16 if self.mode == 3 else 32 if self.mode != 1 else (32 + 4 * (self.extension + 1)) // 2
        return None


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame that four bytes announce; None if they are no header (free-format is not taken)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    b, r = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or b in (0, 15) or r == 3 or four[3] & 3 == 2:
        return None
    bitrate = 1000 * BITRATES[1 if version == 3 else 2, layer][b]
    rate, pad = RATES[version][r], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    return Header(version, layer, not four[1] & 1, bitrate, rate, four[3] >> 6, four[3] >> 4 & 3, length, samples)


def _alike(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = ""  # Xing, Info or VBRI
    named_frames: int | None = None
    named_bytes: int | None = None
    seek: list[int] = field(default_factory=list)  # as the table has it
    delay: int = 0
    padding: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)  # of every audio frame
    lengths: list[int] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)  # where a frame's own data starts
    samples: int = 0
    checked: int = 0
    damaged: list[int] = field(default_factory=list)  # offsets of frames whose checksum is wrong
    skipped: int = 0  # bytes between frames
    kinds: set[tuple[int, int]] = field(default_factory=set)
    bitrates: set[int] = field(default_factory=set)

    @property
    def duration(self) -> int:
        """Samples that are heard."""
        return max(0, self.samples - self.delay - self.padding)


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Where the tag at this place ends; its frames go into tags."""
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    place = at + 10
    if flags & 0x40 and major >= 3 and place + 4 <= end:  # an extended header
        place += _synchsafe(data[place : place + 4]) if major == 4 else 4 + int.from_bytes(data[place : place + 4], "big")
    while place + 10 <= end and data[place : place + 1] not in (b"\0", b""):
        name = data[place : place + 4].decode("latin-1")
        n = _synchsafe(data[place + 4 : place + 8]) if major == 4 else int.from_bytes(data[place + 4 : place + 8], "big")
        tags.setdefault(name, data[place + 10 : min(end, place + 10 + n)])
        place += 10 + n
    return min(len(data), end + (10 if flags & 0x10 else 0))


def _vbr(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame is a table and no audio."""
    x = at + 4 + (2 if h.protected else 0) + h.side
    if data[x : x + 4] not in (b"Xing", b"Info"):
        x = at + 4 + h.side  # some writers leave no room for the checksum
    if (name := data[x : x + 4]) in (b"Xing", b"Info") and x + 8 <= at + h.length:
        flags, place = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        if flags & 1:
            out.named_frames, place = int.from_bytes(data[place : place + 4], "big"), place + 4
        if flags & 2:
            out.named_bytes, place = int.from_bytes(data[place : place + 4], "big"), place + 4
        if flags & 4:
            out.seek, place = list(data[place : place + 100]), place + 100
        place += 4 if flags & 8 else 0
        if data[place : place + 4] in (b"LAME", b"Lavf", b"Lavc") and place + 24 <= at + h.length:
            three = int.from_bytes(data[place + 21 : place + 24], "big")
            out.delay, out.padding = three >> 12, three & 0xFFF
        out.table = name.decode()
        return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        out.named_bytes, out.named_frames, n, scale, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        raw = data[at + 62 : at + 62 + n * width]
        out.seek = [scale * int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)] if width else []
        out.table = "VBRI"
        return True
    return False


def _tail_tags(data: bytes) -> list[tuple[str, int, int]]:
    """(name, start, end) of what looks like tags at the end, the foremost first."""
    found, end = [], len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        found.append(("ID3v1", end - 128, end))
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        start = end - size - (32 if data[end - 9] & 0x80 else 0)
        if size >= 32 and start >= 0:
            found.append(("APE", start, end))
    return found[::-1]


def parse(data: bytes) -> Stream:
    """The stream's frames and tags.

    Bytes that look like a tag at the end are one only if no frame lies over their start: a frame
    that ends where the next one or the data's end is keeps what it holds, whatever it looks like.
    """
    out, at, n = Stream(), 0, len(data)
    tags = _tail_tags(data)
    end = tags[0][1] if tags else n
    last = None  # the last header: its like needs no successor to be believed
    while at + 4 <= n:
        while tags and at > tags[0][1]:  # a frame lies over its start
            tags.pop(0)
            end = tags[0][1] if tags else n
        if tags and at == end:
            for name, start, stop in tags:
                out.tags[name] = data[start:stop]
            at = n
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(data[:end], at, out.tags)
            continue
        h = header(data[at : at + 4])
        if h is not None:
            stop = at + h.length
            follows = header(data[stop : stop + 4]) if stop + 4 <= n else None
            joined = follows is not None and _alike(h, follows)
            if stop > end:  # over a tag's start
                whole = stop <= n and (joined or stop == n)
            else:
                whole = last is not None and _alike(h, last) or joined or stop + 4 > end
            h = h if whole else None
        if h is None:
            step = data.find(b"\xff", at + 1, end)
            step = (end if at < end else n) if step < 0 else step
            out.skipped += step - at
            at, last = step, None
            continue
        first, last = last is None and not out.offsets and not out.table, h
        out.rate = out.rate or h.rate
        if not (first and h.layer == 3 and _vbr(data, at, h, out)):
            out.offsets.append(at)
            out.lengths.append(h.length)
            out.samples += h.samples
            out.kinds.add((h.version, h.layer))
            out.bitrates.add(h.bitrate)
            body = at + 4 + (2 if h.protected else 0)
            if h.protected and h.guarded is not None:
                out.checked += 1
                if crc16(data[at + 2 : at + 4] + data[body : body + h.guarded]) != int.from_bytes(data[at + 4 : at + 6], "big"):
                    out.damaged.append(at)
            out.bodies.append(body + (h.side if h.layer == 3 else 0))
        at += h.length
    out.skipped += max(0, n - at)
    return out


# --- the writer ---

_RATE_INDEX, _MONO = 2, 0xC4  # 32 kHz; one channel, original
_SIDE = 17
_HEAD = 4 + 2 + _SIDE
OWNER = b"payload-bytes\0"


@lru_cache(maxsize=64)
def _frame_head(index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information; and the bytes that the frame has room for."""
    four = bytes([0xFF, 0xFA, index << 4 | _RATE_INDEX << 2, _MONO])
    h = header(four)
    return four + crc16(four[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE), h.length - _HEAD


ROOMS = [_frame_head(i)[1] for i in range(1, 15)]


def store(payload: bytes) -> bytes:
    """The payload in frames; parse and payload_of give it back."""
    head, room = _frame_head(14)
    frames, sizes = [], []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        if len(part) < room:
            head, room = _frame_head(1 + next(i for i, r in enumerate(ROOMS) if r >= len(part)))
        frames += [head, part, bytes(room - len(part))]
        sizes.append(_HEAD + room)
    number = struct.pack(">Q", len(payload))
    private = b"PRIV" + struct.pack(">I", len(OWNER) + len(number)) + b"\0\0" + OWNER + number
    tag = b"ID3\4\0\0" + bytes([0, 0, 0, len(private)]) + private
    first, space = _frame_head(6)
    total, ends = len(first) + space + sum(sizes), []
    reach = len(first) + space
    for size in sizes:
        ends.append(reach)
        reach += size
    toc = bytes(min(255, 256 * ends[i * len(ends) // 100] // total) for i in range(100)) if ends else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    return b"".join([tag, first, xing, bytes(space - len(xing)), *frames])


def payload_of(data: bytes, stream: Stream) -> bytes:
    """What store put into the frames; frames with a wrong checksum are an error."""
    private = stream.tags.get("PRIV", b"")
    if not private.startswith(OWNER):
        raise ValueError("the stream has no payload")
    if stream.damaged:
        raise ValueError(f"wrong checksum at {stream.damaged[0]}")
    length = struct.unpack(">Q", private[len(OWNER) :])[0]
    found = b"".join([data[b : o + n] for b, o, n in zip(stream.bodies, stream.offsets, stream.lengths)])
    if len(found) < length:
        raise ValueError("the stream is cut short")
    return found[:length]


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def feature(stream: Stream) -> str:
    """Format, rate, frames, exact duration, bitrates, table, checksums and a digest of all seek offsets."""
    kinds = "+".join(f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[v]}-layer{n}" for v, n in sorted(stream.kinds, reverse=True))
    offsets = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    return (
        f"{kinds};rate={stream.rate};frames={len(stream.offsets)};samples={stream.duration};"
        f"kbps={min(stream.bitrates, default=0) // 1000}-{max(stream.bitrates, default=0) // 1000};"
        f"table={stream.table or 'none'};checked={stream.checked};damaged={len(stream.damaged)};seek={offsets:08x}"
    )


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate long, seek_offsets array<long>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.list_(pa.int64()) if c.endswith("array<long>") else pa.int64() for c in RESULT.split(", ")]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            data = text.as_py() or b""
            media = store(padded(data))
            stream = parse(media)
            back = payload_of(media, stream)
            rows.append((doc, len(data), len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha256(media).hexdigest(), feature(stream), len(stream.offsets), stream.duration, stream.rate, stream.offsets))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [store(padded(x.as_py() or b"")) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


INDEX = "doc_id long, rate int, n_samples long, duration_s double, table string, n_checked long, damaged array<long>, skipped long, offsets array<long>"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.int64(), longs, pa.int64(), longs]
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        rows = []
        for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
            s = parse(media.as_py() or b"")
            rows.append((doc, s.rate, s.duration, s.duration / s.rate if s.rate else None, s.table, s.checked, s.damaged, s.skipped, s.offsets))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text as an MPEG audio stream."""
    return _binary(docs).mapInArrow(_stored, "doc_id long, media binary")


def index_media(media: DataFrame) -> DataFrame:
    """INDEX's columns for any MPEG audio streams (doc_id, media): exact durations and seek offsets."""
    return media.select("doc_id", "media").mapInArrow(_indexed, INDEX)


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(documents(spark, sf_dir)).mapInArrow(_digests, RESULT)
