"""OpenStreetMap extracts (.pbf): ways with tags and coordinates.

A file is a row of blobs, each compressed on its own, so blobs are the input partitions: the driver reads the headers
between them, a task seeks its blob and unpacks it.  Ways find the places of their nodes by an equi-join on the node id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.storage import importable

# Degrees to a unit of granularity 1, granularity where none is told, kinds of fields on the wire.
UNIT, GRANULARITY = 1e-9, 100
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
NODES_DDL, WAYS_DDL = "id long, lon double, lat double", "id long, tags map<string, string>, refs array<long>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def fields(data: bytes):
    """(number, value) of a message's fields: numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        elif kind == BYTES:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field of unknown kind {kind}")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """Packed varints, all at once."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.nonzero(raw < 128)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    places = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * places).astype(np.uint64), starts)


def signed(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _number(x: int) -> int:
    """A 64-bit field that holds a signed number."""
    return x - (1 << 64) if x >> 63 else x


def blobs(path: str) -> list[tuple[int, int]]:
    """(place, size) of the blobs with data."""
    out = []
    with open(path, "rb") as f:
        while len(head := f.read(4)) == 4:
            found = dict(fields(f.read(struct.unpack(">I", head)[0])))
            size = found[3]
            if found[1] == b"OSMData":
                out.append((f.tell(), size))
            f.seek(size, 1)
    return out


def unpacked(blob: bytes) -> bytes:
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("the blob is compressed otherwise than by zlib")


def _block(data: bytes) -> tuple[list[bytes], list[bytes], tuple[int, int, int]]:
    words, groups, grain, lat, lon = [], [], GRANULARITY, 0, 0
    for number, value in fields(data):
        if number == 1:
            words = [v for n, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number == 19:
            lat = _number(value)
        elif number == 20:
            lon = _number(value)
    return words, groups, (grain, lat, lon)


def nodes(data: bytes):
    """Arrow batches of id, lon, lat of a block."""
    _, groups, (grain, lat0, lon0) = _block(data)
    for group in groups:
        single = []
        for number, value in fields(group):
            if number == 2:
                dense = dict(fields(value))
                ids, lat, lon = (np.cumsum(signed(packed(dense.get(k, b"")))) for k in (1, 8, 9))
                yield ids, UNIT * (lon0 + grain * lon), UNIT * (lat0 + grain * lat)
            elif number == 1:
                node = dict(fields(value))
                turn = lambda x: (x >> 1) ^ -(x & 1)
                single.append((turn(node[1]), UNIT * (lon0 + grain * turn(node[9])), UNIT * (lat0 + grain * turn(node[8]))))
        if single:
            yield tuple(np.array(c) for c in zip(*single, strict=True))


def ways(data: bytes):
    """(id, tags, refs) of a block."""
    words, groups, _ = _block(data)
    for group in groups:
        for number, value in fields(group):
            if number == 3:
                way = dict(fields(value))
                keys, values = (packed(way.get(k, b"")).tolist() for k in (2, 3))
                tags = {words[k].decode("utf-8", "replace"): words[v].decode("utf-8", "replace") for k, v in zip(keys, values, strict=True)}
                yield _number(way[1]), tags, np.cumsum(signed(packed(way.get(8, b"")))).tolist()


class Blob(InputPartition):
    def __init__(self, place: int, size: int):
        self.place, self.size = place, size


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self):
        return [Blob(*b) for b in blobs(self.path)] or [Blob(0, 0)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(partition.place)
            raw = f.read(partition.size)
        data = unpacked(raw) if raw else b""
        if self.kind == "ways":
            yield from ways(data)
        else:
            for ids, lon, lat in nodes(data):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lon, pa.float64()), pa.array(lat, pa.float64())], names=["id", "lon", "lat"])


class OpenStreetMap(DataSource):
    """format("osm_pbf"), option kind: nodes (default) or ways."""

    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return WAYS_DDL if self.options.get("kind") == "ways" else NODES_DDL

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("kind", "nodes"))


def lines(spark: SparkSession, path: str, tag: str = "highway") -> DataFrame:
    """feature_id, name, the tag, and parts in degrees, of the ways that have the tag and two known nodes at least."""
    importable(spark)
    spark.dataSource.register(OpenStreetMap)
    load = lambda kind: spark.read.format("osm_pbf").option("kind", kind).load(path)
    kept = load("ways").withColumn(tag, F.col("tags")[tag]).where(F.col(tag).isNotNull())
    steps = kept.select(F.col("id").alias("feature_id"), F.posexplode("refs").alias("at", "node"))
    placed = steps.join(load("nodes").withColumnRenamed("id", "node"), "node")
    points = F.transform(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    drawn = placed.groupBy("feature_id").agg(points.alias("points")).where(F.size("points") > 1)
    named = kept.select(F.col("id").alias("feature_id"), F.col("tags")["name"].alias("name"), tag)
    return named.join(drawn, "feature_id").select("feature_id", "name", tag, F.array("points").alias("parts"))
