"""Operator 8: media columns in Ogg.

Writing: a payload of 8-bit samples is cut into packets, dealt in turn to two logical streams, laced into pages with
checksums, sequence numbers and granule positions (samples of the stream completed on the page), and the streams' pages
are multiplexed.  Reading: pages are found by their capture pattern, verified by checksum, demultiplexed by serial number,
packets put together from lacing values across pages, and timed by granule position over sample rate.

The checksum (polynomial 0x04C11DB7, most significant bit first, no inversion) is the common reflected CRC-32 of the
bit-reversed bytes, reversed, with both inversions undone; so the C routine of zlib does the work.

Cases.  Null and empty text: 64 zero bytes.  Very long texts: one row at a time.  Equal texts give equal bytes: serial
numbers come from the payload.  Damaged pages: counted and left out, the packets they carried are dropped, others kept.
Null media: no streams.  Rows repeated, extra columns, empty table: as everywhere, each row its result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, id_and_text, texts_of

UNIT, PACKET, SEGMENTS, RATE = 64, 4096, 40, 8000
#: The format's capture pattern, page header and flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Identification packet of our streams: name, version, stream number, streams, rate, samples in all.
MAGIC, IDENT = b"raw8bits", struct.Struct("<8sBBBIQ")
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    reflected = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(REVERSED), "big")


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64; length without them."""
    raw = text.encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = struct.pack("<I", checksum(bytes(page)))
    return bytes(page)


def _pages(serial: int, packets: list[bytes]) -> list[bytes]:
    """Pages of one logical stream; the first packet, which has no samples, has a page of its own."""
    head = packets[0]
    pages = [_page(FIRST | (0 if len(packets) > 1 else LAST), 0, serial, 0, _lacing(len(head)), head)]
    lacing, body, granule, ended, carried, done = bytearray(), bytearray(), 0, False, False, 0
    pieces = [(v, i) for i, p in enumerate(packets[1:], 1) for v in _lacing(len(p))]
    at = {i: 0 for i in range(1, len(packets))}
    for k, (value, i) in enumerate(pieces):
        lacing.append(value)
        body += packets[i][at[i] : at[i] + value]
        at[i] += value
        if value < 255:
            granule += len(packets[i])
            ended = True
        if len(lacing) == SEGMENTS or k == len(pieces) - 1:
            flags = (CONTINUED if carried else 0) | (LAST if k == len(pieces) - 1 else 0)
            done += 1
            pages.append(_page(flags, granule if ended else -1, serial, done, bytes(lacing), bytes(body)))
            carried, ended, lacing, body = value == 255, False, bytearray(), bytearray()
    return pages


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def write(payload: bytes, rate: int = RATE) -> bytes:
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    streams = [_pages(serial + s, [IDENT.pack(MAGIC, 1, s, 2, rate, len(payload)), *packets[s::2]]) for s in (0, 1)]
    firsts, rest = [s[0] for s in streams], [s[1:] for s in streams]
    turns = [p for k in range(max(map(len, rest))) for s in rest for p in s[k : k + 1]]
    return b"".join(firsts + turns)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)  # granule position where a page tells it of its last packet
    pages: int = 0
    lost: int = 0
    late: int = 0
    ended: bool = False
    _part: bytearray | None = None
    _next: int = 0

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number < self._next:
            self.late += 1
            return
        if number != self._next:
            self.lost += number - self._next
            self._part = None
        self._next, self.pages, self.ended = number + 1, self.pages + 1, self.ended or bool(flags & LAST)
        skip = bool(flags & CONTINUED) and self._part is None  # the packet's beginning is lost
        if not flags & CONTINUED:
            self._part = None
        at, last = 0, None
        for value in lacing:
            if not skip:
                self._part = self._part if self._part is not None else bytearray()
                self._part += body[at : at + value]
            at += value
            if value < 255:
                if not skip:
                    self.packets.append(bytes(self._part))
                    self.ends.append(None)
                    last = len(self.packets) - 1
                skip, self._part = False, None
        if last is not None and granule >= 0:
            self.ends[last] = granule


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged pages, which are skipped.

    Later streams of one serial number, in chained files, have 2 ** 32 more each in the key.
    """
    streams: dict[int, Stream] = {}
    now: dict[int, int] = {}  # serial number -> key of its stream at this place
    bad, at = 0, data.find(CAPTURE)
    while 0 <= at <= len(data) - HEADER.size:
        _, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + count]
        start = at + HEADER.size + count
        end = start + sum(lacing)
        page = data[at:end]
        whole = end <= len(data) and version == 0 and len(lacing) == count
        if not whole or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = data.find(CAPTURE, at + 4)
            continue
        key = now.setdefault(serial, serial)
        if key in streams and streams[key].ended and flags & FIRST:
            key = now[serial] = key + (1 << 32)
        streams.setdefault(key, Stream(serial)).take(flags, granule, number, lacing, data[start:end])
        at = end if data.startswith(CAPTURE, end) else data.find(CAPTURE, end)
    return streams, bad


def times(stream: Stream) -> list[float]:
    """End of each data packet in seconds: granule positions told by pages, samples counted between them."""
    rate, now, out = IDENT.unpack(stream.packets[0])[4], 0, []
    for packet, end in zip(stream.packets[1:], stream.ends[1:], strict=True):
        now = end if end is not None else now + len(packet)
        out.append(now / rate)
    return out


def payload_from(streams: dict[int, Stream]) -> bytes:
    """The samples of all our streams, packets in turn."""
    mine = []
    for stream in streams.values():
        if stream.packets and len(stream.packets[0]) == IDENT.size and stream.packets[0].startswith(MAGIC):
            mine.append((IDENT.unpack(stream.packets[0]), stream))
    mine.sort(key=lambda m: m[0][2])
    turns = [s.packets[1:] for _, s in mine]
    data = b"".join(p for k in range(max(map(len, turns), default=0)) for t in turns for p in t[k : k + 1])
    if not mine or len(data) != mine[0][0][5]:
        raise ValueError("streams are missing or incomplete")
    return data


def feature(payload: bytes, streams: dict[int, Stream], bad: int) -> str:
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    length = max(t[-1] if t else 0.0 for t in map(times, streams.values()))
    power = _fixed(float((samples * samples).sum()) / len(samples))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"bad={bad};ms={round(length * 1000)};mean={_fixed(float(samples.sum()) / len(samples))};power={power};peak={int(np.abs(samples).max())}"
    )


def _fixed(x: float) -> str:
    return f"{x:.4f}"


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Per document what is read back from its stored form. One pass, no shuffle, one media file in memory at a time."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch, 1):
                payload, n = payload_of(text)
                media = write(payload)
                streams, bad = read(media)
                back = payload_from(streams)
                rows.append(
                    (
                        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media),
                        hashlib.sha256(media).hexdigest(), feature(back, streams, bad),
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=NAMES)

    return arrow_pass(id_and_text(docs), run, SCHEMA)


def media(docs: DataFrame) -> DataFrame:
    """Per document its stored form: doc_id, media binary."""

    def run(batches):
        for batch in batches:
            files = pa.array([write(payload_of(t)[0]) for t in texts_of(batch, 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), files], names=["doc_id", "media"])

    return arrow_pass(id_and_text(docs), run, "doc_id long, media binary")


def logical_streams(files: DataFrame) -> DataFrame:
    """From doc_id and media binary, any Ogg file: a row for each logical stream, and the file's damaged pages."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                streams, bad = read(data.as_py() or b"")
                for s in streams.values():
                    known = [e for e in s.ends if e is not None]
                    rows.append((doc, s.serial, s.pages, len(s.packets), sum(map(len, s.packets)), max(known, default=None), s.lost, s.late, s.ended, bad))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [*[pa.int64()] * 8, pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "serial", "pages", "packets", "bytes", "granule", "lost_pages", "late_pages", "ended", "bad_pages"],
            )

    return arrow_pass(
        files.select("doc_id", "media"), run,
        "doc_id long, serial long, pages long, packets long, bytes long, granule long, lost_pages long, late_pages long, ended boolean, bad_pages long",
    )
