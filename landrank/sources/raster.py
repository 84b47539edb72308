"""GeoTIFF to pixel tables.

Of a file in a folder that all nodes see, strips and tiles are the input partitions: the driver reads the tags alone, and
each task seeks the bytes of its blocks.  A file in a store that only Spark reads is one row of ``binaryFile`` in one task.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.storage import importable

# Tags and field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
SCALE, TIEPOINT, KEYS, NODATA = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PROJECTED, GEOGRAPHIC = 3072, 2048
PIXELS_DDL = "row long, col long, x double, y double, z double"
#: Pixels that a task reads.
TASK_PIXELS = 1 << 22


@dataclass
class Header:
    width: int
    height: int
    left: float
    top: float
    resolution: tuple[float, float]
    nodata: float | None
    epsg: int | None
    tags: dict
    order: str


def header(source) -> Header:
    """The tags of the first image; ``source``: the file's bytes, or a function of place and size that reads some."""
    take = source if callable(source) else lambda at, n: source[at : at + n]
    first = take(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    if order is None or struct.unpack_from(order + "H", first, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack_from(order + "I", first, 4)[0]
    count = struct.unpack(order + "H", take(at, 2))[0]
    entries, tags = take(at + 2, 12 * count), {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * i)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * n
        raw = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else take(struct.unpack_from(order + "I", entries, 12 * i + 8)[0], size)
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if code == "s" else struct.unpack(f"{order}{n * len(code)}{code[0]}", raw)
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIEPOINT, (0.0,) * 6)
    keys = tags.get(KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
    text = str(tags.get(NODATA, "")).strip()
    return Header(
        tags[WIDTH][0], tags[HEIGHT][0], tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], (scale[0], scale[1]),
        float(text) if text else None, codes.get(PROJECTED) or codes.get(GEOGRAPHIC), tags, order,
    )


def _lzw(data: bytes) -> bytes:
    """Codes of growing width, most significant bit first; 256 clears the table, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(base), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = list(base), 9, None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def layout(head: Header) -> tuple[int, int, int, int]:
    """Width and height of a strip or tile, how many stand side by side, how many the first band has."""
    tags = head.tags
    tiled = TILE_WIDTH in tags
    wide = tags[TILE_WIDTH][0] if tiled else head.width
    high = tags[TILE_HEIGHT][0] if tiled else tags.get(ROWS, (head.height,))[0]
    across = -(-head.width // wide)
    return wide, min(high, head.height) if not tiled else high, across, across * -(-head.height // high)


def blocks(source, head: Header, first: int = 0, last: int | None = None):
    """(first row, first column, heights) of the strips or tiles of the first band, from ``first`` to before ``last``."""
    take = source if callable(source) else lambda at, n: source[at : at + n]
    tags = head.tags
    bits, form = tags.get(BITS, (8,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    kind = np.dtype(head.order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    unpack = UNPACK.get(tags.get(COMPRESSION, (1,))[0])
    if unpack is None:
        raise ValueError(f"TIFF compression {tags[COMPRESSION][0]} is not read")
    tiled = TILE_WIDTH in tags
    wide, high, across, count = layout(head)
    places, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    for i in range(first, count if last is None else min(last, count)):
        row, col = i // across * high, i % across * wide
        raw = unpack(take(places[i], sizes[i]))
        rows = high if tiled else min(high, head.height - row)
        predictor = tags.get(PREDICTOR, (1,))[0]
        if predictor == 3:  # bytes of floats, sorted by significance, as differences along the row
            step = np.frombuffer(raw, np.uint8)[: rows * wide * kind.itemsize].reshape(rows, -1)
            whole = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, wide)
            block = np.ascontiguousarray(whole.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, wide)
        else:
            block = np.frombuffer(raw, kind)[: rows * wide].reshape(rows, wide)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        yield row, col, block[: head.height - row, : head.width - col].astype(np.float64)


def _pixels(source, head: Header, first: int = 0, last: int | None = None):
    for top, left, z in blocks(source, head, first, last):
        r, c = np.divmod(np.arange(z.size), z.shape[1])
        r, c = r + top, c + left
        x, y = head.left + (c + 0.5) * head.resolution[0], head.top - (r + 0.5) * head.resolution[1]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (r, c, x, y, z.ravel())], names=["row", "col", "x", "y", "z"])


def _seeking(file):
    def take(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return take


class Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self.head = header(_seeking(f))

    def partitions(self):
        wide, high, _, count = layout(self.head)
        step = max(1, TASK_PIXELS // max(wide * high, 1))
        return [Blocks(i, min(i + step, count)) for i in range(0, count, step)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            yield from _pixels(_seeking(f), self.head, partition.first, partition.last)


class GeoTiff(DataSource):
    """format("geotiff"): pixels of a file that all nodes see."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return PIXELS_DDL

    def reader(self, schema):
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of a GeoTIFF: row, col, x and y of the centre, z. Strips and tiles come out one at a time."""
    importable(spark)
    if os.path.exists(path):
        spark.dataSource.register(GeoTiff)
        return spark.read.format("geotiff").load(path)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                yield from _pixels(data, header(data))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PIXELS_DDL)


def read_header(spark: SparkSession, path: str) -> Header:
    """The tags alone, by seeking, from whatever store the path is in."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)

    def take(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        return header(take)
    finally:
        stream.close()


def _directory(kind: np.dtype, width: int, height: int, strip: int, places: list[int], sizes: list[int], left: float, top: float, resolution: float, nodata, epsg: int, at: int) -> bytes:
    """The tags of a file of deflated strips, to stand at ``at``."""
    text = (str(nodata).encode() + b"\0") if nodata is not None else b"\0"
    several = len(places) > 1
    long = {
        SCALE: struct.pack("<3d", resolution, resolution, 0.0), TIEPOINT: struct.pack("<6d", 0, 0, 0, left, top, 0),
        KEYS: struct.pack("<8H", 1, 1, 0, 1, PROJECTED, 0, 1, epsg), NODATA: text.ljust(8, b"\0"),
        OFFSETS: struct.pack(f"<{len(places)}I", *places), COUNTS: struct.pack(f"<{len(sizes)}I", *sizes),
    }
    form = {"f": 3, "i": 2, "u": 1}[kind.kind]
    entries = [
        (WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, kind.itemsize * 8), (COMPRESSION, 3, 1, 8), (262, 3, 1, 1),
        (OFFSETS, 4, len(places), None if several else places[0]), (277, 3, 1, 1), (ROWS, 4, 1, strip), (COUNTS, 4, len(sizes), None if several else sizes[0]),
        (SAMPLE_FORMAT, 3, 1, form), (SCALE, 12, 3, None), (TIEPOINT, 12, 6, None), (KEYS, 3, 8, None), (NODATA, 2, len(long[NODATA]), None),
    ]
    out, tail, place = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, code, count, value in entries:
        if value is None:
            value, tail = place + len(tail), tail + long[tag]
        out += struct.pack("<HHI", tag, code, count) + (struct.pack("<HH", value, 0) if code == 3 and count == 1 else struct.pack("<I", value))
    return out + struct.pack("<I", 0) + tail


def _packed(z: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(z.astype(z.dtype.newbyteorder("<"))).tobytes())


def encode(z: np.ndarray, left: float, top: float, resolution: float, nodata: float | None = None, epsg: int = 2961, strip: int | None = None) -> bytes:
    """A GeoTIFF file of deflated strips of ``strip`` rows (default: one strip) of an array."""
    strip = strip or z.shape[0]
    bodies = [_packed(z[i : i + strip]) for i in range(0, z.shape[0], strip)]
    places = [8 + sum(map(len, bodies[:i])) for i in range(len(bodies))]
    at = 8 + sum(map(len, bodies))
    return b"II*\0" + struct.pack("<I", at) + b"".join(bodies) + _directory(z.dtype, z.shape[1], z.shape[0], strip, places, list(map(len, bodies)), left, top, resolution, nodata, epsg, at)


def write(pixels: DataFrame, column: str, path: str, shape: tuple[int, int], left: float, top: float, resolution: float, nodata: float = -9999.0, kind: str = "f4", epsg: int = 2961) -> None:
    """One GeoTIFF of a column of a pixel table (row, col): tasks pack strips, the driver writes them in order as they come.

    ``shape``: rows and columns; pixels that are missing, or null, get ``nodata``.
    """
    height, width = shape
    strip = max(1, min(height, TASK_PIXELS // max(width, 1) // 16))
    dtype = np.dtype(kind)

    def one(key, part):
        import pandas as pd

        z = np.full((min(strip, height - int(key[0]) * strip), width), nodata, dtype)
        there = part["v"].notna()
        z[part["row"][there] - int(key[0]) * strip, part["col"][there]] = part["v"][there].astype(dtype)
        return pd.DataFrame({"strip": [int(key[0])], "body": [_packed(z)]})

    rows = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col(column).cast("double").alias("v"))
    rows = rows.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    strips = rows.groupBy(F.expr(f"row div {strip}").alias("strip")).applyInPandas(one, "strip long, body binary").orderBy("strip")
    empty, places, sizes = _packed(np.full((strip, width), nodata, dtype)), [], []
    with open(path, "wb") as out:
        out.write(b"II*\0\0\0\0\0")

        def put(body: bytes) -> None:
            places.append(out.tell())
            sizes.append(len(body))
            out.write(body)

        for found in strips.toLocalIterator():
            while len(places) < found["strip"]:
                put(empty)
            put(bytes(found["body"]))
        last = -(-height // strip) - 1
        while len(places) <= last:
            put(empty if len(places) < last else _packed(np.full((height - last * strip, width), nodata, dtype)))
        at = out.tell()
        if at >= 1 << 32:
            raise ValueError(f"{path}: a classic TIFF file holds 4 GB")
        out.write(_directory(dtype, width, height, strip, places, sizes, left, top, resolution, nodata, epsg, at))
        out.seek(4)
        out.write(struct.pack("<I", at))
