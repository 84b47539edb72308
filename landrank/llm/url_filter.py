"""Operator 3: URL filters, host and path rules over a Bloom filter cascade.

Rules decide first, the longest that fits.  For all other urls the listed domains decide: a url is blocked if its host or
a parent domain of it is listed.  Membership is exact without a join: level 0 is a Bloom filter of the listed keys, level
1 one of the corpus's other keys that level 0 lets through, level 2 of the listed keys that level 1 lets through, and so
on until none is let through.  The levels are built over the complete key universe (of all hosts of the corpus the ends
of as many labels as some listed key has, since no other can be listed, and the listed keys) by aggregation into bitmap
pieces; only bitmaps, whose total ``CASCADE_BYTES`` bounds, come to the driver and go out to the tasks.

Cases.  Null url or one without ``://``: host and path empty, no rule, not listed.  Host with port or user part: taken as
it is.  Empty labels and a final dot stay.  Rows repeated: each gets its verdict.  Empty table: empty result.  Very long
urls and hosts: whole, at a cost in proportion to their length.  Listed keys that repeat or are empty: count once, or are
dropped; of more than ``LABELS`` labels, which no domain has: an error, as are bitmaps beyond ``CASCADE_BYTES`` and two
keys that no level can tell apart (of equal 64-bit hash, one listed).  Extra columns are not read.
"""

from __future__ import annotations

import math
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, stored

#: (host, path, verdict); the text of a rule is host and path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: False positive rate of a level, at most; bytes of all levels together; bits of a bitmap piece (as bitmap_construct_agg has them).
RATE, CASCADE_BYTES, PIECE = 0.05, 128 << 20, 32768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOSTS_KEPT = 200_000
#: Labels of a listed key, and levels, at most.
LABELS, LEVELS = 127, 200


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """After the first ``://``: up to ``/``, ``?``, ``#``; from there up to ``?``, ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """Text and verdict of the longest rule that fits; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def depth_of(listed: list[str]) -> int:
    """The most labels of a listed key."""
    depth = max((k.count(".") + 1 for k in listed), default=1)
    if depth > LABELS:
        raise ValueError(f"a listed key has over {LABELS} labels")
    return depth


def domains(host: str, depth: int) -> list[str]:
    """The ends of a host of up to ``depth`` labels: parent domains, and itself if it has no more."""
    parts = host.rsplit(".", depth)
    if len(parts) > depth:
        parts = parts[1:]
    return [".".join(parts[i:]) for i in range(len(parts))]


class Cascade:
    """Levels as (bits, hashes per key, bitmap)."""

    def __init__(self):
        self.levels: list[tuple[int, int, bytes]] = []

    def passes(self, key: str) -> int:
        """Number of levels, from the first on, that let the key through without a break."""
        base = xxhash.xxh64_intdigest(key, 42)  # Spark's xxhash64 of a string
        for level, (bits, hashes, bitmap) in enumerate(self.levels):
            a, b = (_signed(xxhash.xxh64_intdigest(struct.pack("<q", 2 * level + i), base)) % bits for i in (0, 1))
            for i in range(hashes):
                at = (a + i * b) % bits
                if not bitmap[at >> 3] >> (at & 7) & 1:
                    return level
        return len(self.levels)

    def lists(self, key: str) -> bool:
        """Exact for keys of the universe."""
        return self.passes(key) % 2 == 1

    def size(self) -> int:
        return sum(len(b) for _, _, b in self.levels)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _let_through(cascade: Cascade):
    def run(batches):
        for batch in batches:
            held = [cascade.passes(k) == len(cascade.levels) for k in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(held, pa.bool_()))

    return run


def universe(hosts: DataFrame, listed: list[str]) -> DataFrame:
    """key, listed: the ends of distinct hosts, of as many labels as a listed key has at most, and the listed keys."""
    ends = F.array(*(F.substring_index("host", ".", -i) for i in range(1, depth_of(listed) + 1)))
    every = F.explode(F.array_distinct(ends))
    keys = hosts.select("host").distinct().select(every.alias("key"))
    own = hosts.sparkSession.createDataFrame([(k,) for k in sorted({k for k in listed if k})], "key string")
    both = keys.withColumn("listed", F.lit(False)).unionByName(own.withColumn("listed", F.lit(True)))
    return both.where("key <> ''").groupBy("key").agg(F.max("listed").alias("listed"))


def build(keys: DataFrame) -> Cascade:
    """The cascade of a universe (key, listed)."""
    keys, cascade = stored(keys, "url-keys"), Cascade()
    listed, others = (keys.where(F.col("listed") == F.lit(b)).count() for b in (True, False))
    while True:
        level = len(cascade.levels)
        if level == LEVELS:
            raise ValueError("a listed key and another have one hash, so no level parts them")
        # the first level lets through about as many other keys as there are listed ones, so later ones stay small
        rate = min(RATE, max(listed, 1) / max(others, 1)) if not level else RATE
        own = arrow_pass(keys.where(F.col("listed") == F.lit(level % 2 == 0)).select("key"), _let_through(cascade), "key string")
        own = stored(own, "url-level")
        n = own.count()
        if not n:
            return cascade
        bits = -(-int(max(64, -n * math.log(rate) / math.log(2) ** 2)) // 64) * 64
        hashes = max(1, round(bits / n * math.log(2))) if n > 8 else 5
        if cascade.size() + bits // 8 > CASCADE_BYTES:
            raise ValueError(f"{n} keys take a level beyond {CASCADE_BYTES} bytes: split the list by host")
        a, b = (F.pmod(F.xxhash64("key", F.lit(2 * level + i).cast("long")), F.lit(bits)) for i in (0, 1))
        at = own.select(F.explode(F.array(*((a + i * b) % bits for i in range(hashes)))).alias("at"))
        pieces = at.groupBy(F.expr(f"at div {PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias("bitmap"))
        bitmap = bytearray(-(-bits // PIECE) * PIECE // 8)
        for row in pieces.collect():  # of bounded size: CASCADE_BYTES
            bitmap[row["piece"] * PIECE // 8 : (row["piece"] + 1) * PIECE // 8] = row["bitmap"]
        cascade.levels.append((bits, hashes, bytes(bitmap[: bits // 8])))


def judged(pages: DataFrame, listed: list[str], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (whether the host or a parent domain is)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    cascade, depth = build(universe(rows, listed)), depth_of(listed)
    shared = pages.sparkSession.sparkContext.broadcast(cascade)
    schema = T.StructType([*rows.schema.fields, T.StructField("listed", T.BooleanType())])

    def run(batches):
        held, known = shared.value, {}
        for batch in batches:
            out = []
            for h in batch.column(1).to_pylist():
                found = known.get(h)
                if found is None:
                    if len(known) >= HOSTS_KEPT:
                        known.clear()
                    found = known[h] = any(held.lists(d) for d in domains(h, depth) if d)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "listed"])

    found = arrow_pass(rows, run, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
