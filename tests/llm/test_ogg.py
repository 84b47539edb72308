"""Ogg: checksum bit by bit, round trips, damage, lacing at its limits."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from landrank.llm import ogg


def plain_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    r = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = r.randbytes(n)
        assert ogg.checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 4095, 4096, 4097, 8192, 12288, 40 * 255, 100_000])
def test_round_trip(n):
    text = "".join(random.Random(n).choice("abc é") for _ in range(n))
    payload, raw = ogg.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text.encode()) and raw == len(text.encode())
    media = ogg.write(payload)
    streams, bad = ogg.read(media)
    assert bad == 0 and len(streams) == 2 and ogg.payload_from(streams) == payload and ogg.write(payload) == media
    assert all(s.ended and s.lost == 0 for s in streams.values())
    for s in streams.values():
        ends = ogg.times(s)
        assert ends == [sum(map(len, s.packets[1 : k + 2])) / ogg.RATE for k in range(len(ends))]


def test_damaged_page_is_left_out():
    payload = ogg.payload_of("word " * 20000)[0]
    media = bytearray(ogg.write(payload))
    at = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    media[at[5] + 400] ^= 1
    streams, bad = ogg.read(bytes(media))
    assert bad == 1 and sum(s.lost for s in streams.values()) == 1
    whole = ogg.read(ogg.write(payload))[0]
    assert all(set(s.packets) <= set(whole[k].packets) for k, s in streams.items())
    with pytest.raises(ValueError):
        ogg.payload_from(streams)
    assert ogg.read(b"junk" + ogg.write(payload) + b"tail")[1] == 0 and ogg.read(b"")[0] == {} and ogg.read(b"OggS")[0] == {}


def test_repeated_and_late_pages():
    payload = ogg.payload_of("word " * 20000)[0]
    media = ogg.write(payload)
    at = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"] + [len(media)]
    pages = [media[a:b] for a, b in zip(at, at[1:])]
    again, bad = ogg.read(b"".join([*pages[:5], pages[4], *pages[5:], pages[3]]))
    assert bad == 0 and ogg.payload_from(again) == payload
    assert sum(s.late for s in again.values()) == 2 and all(s.lost == 0 for s in again.values())
    # a page that comes after its successor: its packets are lost, none comes twice
    late, _ = ogg.read(b"".join([*pages[:4], pages[6], pages[5], pages[4], *pages[7:]]))
    whole, _ = ogg.read(media)
    assert sum(s.late for s in late.values()) == 1 and sum(s.lost for s in late.values()) == 1
    assert all(set(s.packets) <= set(whole[k].packets) and len(s.packets) < len(whole[k].packets) + 1 for k, s in late.items())


def test_chained_streams_of_one_serial():
    first, second = (ogg.write(ogg.payload_of(t)[0]) for t in ("one " * 3000, "one " * 3000))
    streams, bad = ogg.read(first + second)
    assert bad == 0 and len(streams) == 4 and len({s.serial for s in streams.values()}) == 2
    assert all(s.ended and s.lost == 0 and s.late == 0 for s in streams.values())
    low = {k: s for k, s in streams.items() if k < 1 << 32}
    assert ogg.payload_from(low) == ogg.payload_of("one " * 3000)[0]


def test_foreign_lacing():
    """Packets of 0, 254, 255 and 510 bytes, one that goes over two pages, a page on which no packet ends."""
    body = bytes(range(256)) * 4
    first = ogg._page(ogg.FIRST, 3, 9, 0, bytes([0, 254, 255, 0, 255, 255, 0, 255]), body[:254] + body[:255] + body[:510] + body[:255])
    second = ogg._page(ogg.CONTINUED, -1, 9, 1, b"\xff", body[:255])
    third = ogg._page(ogg.CONTINUED | ogg.LAST, 4, 9, 2, b"\x05", body[:5])
    streams, bad = ogg.read(first + second + third)
    assert bad == 0 and list(map(len, streams[9].packets)) == [0, 254, 255, 510, 515] and streams[9].ends == [None, None, None, 3, 4]


def test_table(odd, odd_more, none, odd_rows, rows_of):
    got = rows_of(ogg.digests(odd), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for r in odd_rows:
        payload, n = ogg.payload_of(r[1] or "")
        want.append((r[0], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == sorted(want, key=str)
    assert rows_of(ogg.digests(odd_more)) == rows_of(ogg.digests(odd)) and ogg.digests(none).collect() == []
    by_text = {}
    for r in ogg.digests(odd).collect():
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_streams_of_files(spark, odd):
    rows = ogg.logical_streams(ogg.media(odd)).collect()
    assert len(rows) == 2 * odd.count() and all(r["bad_pages"] == 0 and r["ended"] for r in rows)
    assert ogg.logical_streams(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect() == []
