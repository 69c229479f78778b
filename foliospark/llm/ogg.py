"""Ogg media columns.

The container of RFC 3533, written and read without a codec.  A text's payload
becomes packets of ``UNIT`` bytes, dealt in turn to two logical streams (left
and right halves of a track, say) that are multiplexed page by page.  Each
stream opens with a header packet on a begin-of-stream page; its granule
position counts the 8-bit samples finished on a page, and the last page of a
stream carries the end flag.

Reading trusts nothing: it verifies each page's checksum, reassembles packets
from lacing values (across pages where the continued flag says so), separates
streams by serial number, checks page order, and turns granule positions into
seconds.  A damaged page is reported, and its packets are left out.

The page checksum (polynomial 04c11db7, most significant bit first, no
inversion) is the reflected CRC-32 of bit-reversed bytes, so zlib computes it.

Cases: a null text is empty, whose payload is one unit of 255s; equal texts
give equal bytes, as serial numbers come from the payload; very long texts
take memory in proportion to the longest text (about five copies of it), as a
file is made, read back and compared whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship

UNIT = 576
RATE = 48_000
_CONTINUED, _BEGIN, _END = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_NO_GRANULE = -1
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC of a whole page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED), "little")


def lacing(length: int, last: bool = True) -> bytes:
    """Lacing values of a packet; one that ends at a multiple of 255 gets a closing zero."""
    return b"\xff" * (length // 255) + (bytes([length % 255]) if last else b"")


@dataclass
class Writer:
    """One logical stream; ``page`` makes the next page of a multiplexed file."""

    serial: int
    sequence: int = 0

    def page(self, segments: bytes, body: bytes, granule: int, flags: int = 0) -> bytes:
        head = _HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(segments)) + segments
        self.sequence += 1
        crc = page_checksum(head + body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(packets: list[bytes], first_granule: int = 0) -> Iterator[tuple[bytes, bytes, int, int, bool]]:
    """Fills pages of up to 255 lacing values: segments, body, granule, flags, last."""
    table = b"".join(lacing(len(p)) for p in packets)
    body = b"".join(packets)
    at, taken, granule, done, continued = 0, 0, first_granule, 0, False
    ends = iter(packets)
    while at < len(table):
        segments = table[at : at + 255]
        size, finished = sum(segments), 0
        for value in segments:
            if value < 255:
                done += len(next(ends))
                finished += 1
        stop = at + len(segments) >= len(table)
        whole = segments[-1] < 255
        yield (
            segments,
            body[taken : taken + size],
            first_granule + done if finished else _NO_GRANULE,
            _CONTINUED * continued,
            stop,
        )
        at, taken, continued = at + len(segments), taken + size, not whole


def write(streams: list[tuple[int, bytes, list[bytes]]]) -> bytes:
    """Multiplexes streams of (serial, header packet, data packets) into one file."""
    out, queues = [], []
    for serial, header, packets in streams:
        writer = Writer(serial)
        pages = list(_pages(packets))
        out.append(writer.page(lacing(len(header)), header, 0, _BEGIN | _END * (not pages)))
        queues.append((writer, pages))
    depth = max((len(p) for _, p in queues), default=0)
    for i in range(depth):
        for writer, pages in queues:
            if i < len(pages):
                segments, body, granule, flags, last = pages[i]
                out.append(writer.page(segments, body, granule, flags | _END * last))
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: the second at which each page with a finished packet ends
    times: list[float] = field(default_factory=list)
    granule: int = 0
    pages: int = 0
    begun: bool = False
    ended: bool = False
    gaps: int = 0


@dataclass
class Media:
    streams: list[Stream]
    pages: int = 0
    bad_pages: int = 0

    @property
    def whole(self) -> bool:
        return not self.bad_pages and all(s.begun and s.ended and not s.gaps for s in self.streams)


def read(data: bytes, rate: int = RATE) -> Media:
    """Parses a multiplexed file; bytes between pages are skipped up to the next capture pattern."""
    out, streams, partial, expected = Media([]), {}, {}, {}
    at = data.find(b"OggS")
    while at >= 0 and at + _HEAD.size <= len(data):
        _, version, flags, granule, serial, sequence, crc, count = _HEAD.unpack_from(data, at)
        table = data[at + _HEAD.size : at + _HEAD.size + count]
        body_at = at + _HEAD.size + count
        end = body_at + sum(table)
        page = data[at:end]
        if version or end > len(data) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            at = data.find(b"OggS", at + 1)
            continue
        out.pages += 1
        if serial not in streams:
            streams[serial] = Stream(serial)
            out.streams.append(streams[serial])
        s = streams[serial]
        if sequence != expected.get(serial, 0):  # a page is missing: what was begun is lost
            s.gaps += 1
            partial.pop(serial, None)
        expected[serial] = sequence + 1
        s.pages += 1
        s.begun |= bool(flags & _BEGIN)
        s.ended |= bool(flags & _END)
        held = partial.pop(serial, None)
        skip = bool(flags & _CONTINUED) and held is None
        take, begin = held or [], body_at
        cursor = body_at
        for value in table:
            cursor += value
            if value < 255:
                take.append(data[begin:cursor])
                if not skip:
                    s.packets.append(b"".join(take))
                take, begin, skip = [], cursor, False
        if table and table[-1] == 255 and not skip:
            partial[serial] = [*take, data[begin:cursor]]
        if granule != _NO_GRANULE:
            s.granule = granule
            s.times.append(granule / rate)
        at = data.find(b"OggS", end) if end < len(data) else -1
    return out


_HEADER = struct.Struct("<8sBBIQ")


def store(payload: bytes, unit: int = UNIT) -> bytes:
    """A payload of whole units as a two-stream file of 8-bit samples."""
    parts = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    serial = zlib.crc32(payload)
    return write(
        [
            (serial ^ k, _HEADER.pack(b"pcm8data", 1, k, RATE, sum(map(len, parts[k::2]))), parts[k::2])
            for k in (0, 1)
        ]
    )


def restore(media: Media) -> bytes:
    """The payload of a file made by :func:`store`; raises if it is not whole."""
    lanes: dict[int, list[bytes]] = {}
    for s in media.streams:
        _, _, lane, _, size = _HEADER.unpack(s.packets[0])
        lanes[lane] = s.packets[1:]
        if sum(map(len, lanes[lane])) != size or s.granule != (size if lanes[lane] else 0):
            raise ValueError("samples and granule positions differ")
    if not media.whole or sorted(lanes) != [0, 1]:
        raise ValueError("damaged media")
    left, right = lanes[0], lanes[1]
    out = [p for pair in zip(left, right, strict=False) for p in pair]
    return b"".join(out + left[len(right) :])


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    size = max(1, -(-len(raw) // unit)) * unit
    return raw.ljust(size, b"\xff")


MEDIA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def digest(text: str | None) -> tuple:
    """Stores one text, reads the stored bytes back and describes what was read."""
    raw = (text or "").encode()
    stored = store(pad(raw))
    media = read(stored)
    payload = restore(media)
    seconds = [s.times[-1] for s in media.streams]
    mean = sum(payload) / len(payload)
    feature = (
        f"ogg;pages={media.pages};streams={len(media.streams)};"
        f"packets={sum(len(s.packets) for s in media.streams)};"
        f"seconds={'/'.join(f'{x:.6f}' for x in seconds)};mean={mean:.4f};peak={max(payload)}"
    )
    return (
        len(raw),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-32:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        feature,
    )


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and the stored form's columns for every row; streams batches, keeps nothing."""
    ship(docs.sparkSession)
    names = [part.split()[0] for part in MEDIA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [digest(t.as_py()) for t in part.column(1)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64() if isinstance(c[0], int) else pa.string() for c in cols]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["key", *names])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key long, {MEDIA}").withColumnRenamed("key", key)
