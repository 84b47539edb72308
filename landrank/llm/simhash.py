"""Operator 6: SimHash near-dedup by tiled exact comparison.

A fingerprint has one bit for each bit of the shingles' 64-bit hashes, set where over half the hashes have it set; wider
fingerprints use further hashes mixed from the first.  Only distinct fingerprints are compared.  They are dealt out by
keys, sorted by key and population count, and cut into tiles; a tile is compared with itself and with those after it by
exclusive-or and bit counts, except where the keys part or the population counts differ by more than the radius.  A task
emits the forest of its links, at most one row a fingerprint, so a group of many near copies never becomes all its pairs;
components of the forests are found by star contraction with tables in the shared folder.

``components`` (the contract's query) takes the fingerprints themselves as the texts' likeness.  Its keys are bands of the
bits, one more than the radius, so linked fingerprints agree on one and no link is lost.  A band value that very many
fingerprints share is dealt out again by bands over all bits, by the same rule.

``representatives`` (the pipeline's stage) links texts by the Jaccard similarity of their shingle sets.  Its keys are
min-hash bands: two sets of similarity s agree on a band with probability s ** ``ROWS``, so a pair of just 0.8 shares one
of ``BANDS`` with probability 0.9996, whatever the size of the corpus.  Tiles then leave out what the fingerprints put
beyond the radius.  A key that very many texts share is tight, if they are near copies, or dealt out again by more keys.  The links found only say which texts to hold against each other: each component of them is verified
on the shingle sets, where a pair is left out only if verified links join it already.  A large component is cut into
blocks, each with a few pivots of the component: what the pivots join to its main part, as in a family of copies of any
size, is not compared any further with that part, and only the rest is held against all other members.

Cases.  Null text: as empty.  Texts without words: fingerprint zero, linked like any other; for ``representatives`` their
empty sets are equal.  Fewer words than a shingle has: the whole sequence is the one shingle.  Ties: exactly half the bits
leave the bit 0; of a component the smallest doc_id names it or stays (null last, then the place in the files).  Rows
repeated: same component.  Empty table: empty result.  Extra columns, whatever their names, are handed on by
``representatives`` and ignored by ``components``.
"""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE, arrow_pass, field_of, handed_on, placed, stored, texts_of

SEED = 42
#: Fingerprints to a tile, and to a band value before it is dealt out again.
TILE, HOT = 128, 4096
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64, seed 42, of every shingle, repeats included; A-Z lower-cased, words parted by U+0020 and U+0009-U+000D."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(parts, i, None) for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash: a bijective mix of the first; the 0-th is the hash itself."""
    if not k:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes. Eight byte-wide counters share a word, so 255 hashes are added at a time."""
    n = len(h)
    if not n:
        return 0
    starts = np.arange(0, n, 255)
    counts = np.empty((8, 8), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & LANES, starts)
        counts[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts.reshape(-1) * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int, wide: int = 1) -> list[int]:
    h = shingle_hashes(text, words)
    return [majority(mixed(h, k)) for k in range(wide)]


def _names(wide: int) -> list[str]:
    return [f"__f{k}" for k in range(wide)]


def _texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, place and text of the placed rows of ``docs``."""
    doc_id, text = (F.col(f"row.{field_of(docs, n)}") for n in ("doc_id", "text"))
    return rows.select(doc_id.cast("long").alias("doc_id"), *PLACE, text.cast("string").alias("text"))


#: Digest of a text's shingle set.
SET = ["__d0", "__d1"]


def fingerprints(rows: DataFrame, words: int, wide: int) -> DataFrame:
    """doc_id, place and fingerprint words of every row of doc_id, place and text, stored; the texts stay in the worker."""
    names = ["doc_id", *PLACE, *_names(wide)]

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words, wide) for t in texts_of(batch, 3)], np.uint64).reshape(-1, wide).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[:, k]) for k in range(wide))], names=names)

    return stored(arrow_pass(rows, run, ", ".join(f"{n} long" for n in names)), "simhash-rows")


#: Min-hash rows to a band, and bands: a pair of similarity 0.8 shares a band with probability 0.9996.
ROWS, BANDS = 5, 20
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each min-hash band of a set of hashes, which is not empty. A hash function multiplies by an odd number."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 2048):
        least = np.minimum(least, (MULTIPLIERS[:, None] * h[None, at : at + 2048]).min(axis=1))
    raw, size = least.tobytes(), 8 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[b * size : (b + 1) * size], b) for b in range(BANDS)]


def set_fingerprints(rows: DataFrame, words: int, wide: int) -> DataFrame:
    """The same of distinct shingles, with a digest of their set (128 bits), which names it, its size and min-hash keys (none of an empty set)."""
    names = ["doc_id", *PLACE, *_names(wide), *SET, "__n"]

    def run(batches):
        for batch in batches:
            found, keys = [], []
            for t in texts_of(batch, 3):
                h = np.unique(shingle_hashes(t, words))
                digest = xxhash.xxh3_128_intdigest(h.tobytes(), SEED)
                found.append([*(majority(mixed(h, k)) for k in range(wide)), digest & (2**64 - 1), digest >> 64, len(h)])
                keys.append(np.array(band_keys(h), np.uint64).view(np.int64) if len(h) else np.empty(0, np.int64))
            found = np.array(found, np.uint64).reshape(-1, wide + 3).view(np.int64)
            columns = [*batch.columns[:3], *(pa.array(found[:, k]) for k in range(wide + 3)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__keys"])

    return stored(arrow_pass(rows, run, ", ".join(f"{n} long" for n in names) + ", __keys array<long>"), "simhash-rows")


def exact_bands(bits: int, radius: int) -> list[list[int]]:
    """radius + 1 bands that share out the bits: fingerprints within the radius agree on one of them."""
    return [list(range(bits * k // (radius + 1), bits * (k + 1) // (radius + 1))) for k in range(radius + 1)]


def striped_bands(bits: int, radius: int, run: int = 1) -> list[list[int]]:
    """The same with runs of bits in turn, for fingerprints that share a value of an outer band."""
    return [[i for i in range(bits) if i // run % (radius + 1) == k] for k in range(radius + 1)]


def expected_share(similarity: float) -> float:
    """Share of bits in which two texts of this Jaccard similarity of shingles are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _extract(words: list[np.ndarray], positions: list[int]) -> np.ndarray:
    out = np.zeros(len(words[0]), np.uint64)
    for i, p in enumerate(positions):
        out |= ((words[p >> 6] >> np.uint64(p & 63)) & np.uint64(1)) << np.uint64(i)
    return out


def _key(band: int, value: np.ndarray) -> np.ndarray:
    """A band and its value as one 64-bit key; bands have up to 32 bits. Distinct pairs give distinct keys."""
    return (np.uint64(band) << np.uint64(32)) | value


def _banded(bands, names: list[str], into: str):
    """A row for every fingerprint and band, with the band and its value in the column ``into`` before all others."""

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            words = [batch.column(at[n]).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]
            for b, positions in enumerate(bands):
                key = pa.array(_key(b, _extract(words, positions)).view(np.int64))
                yield pa.RecordBatch.from_arrays([key, *batch.columns], names=[into, *batch.schema.names])

    return run


def tile_links(key: np.ndarray, words: np.ndarray, radius: int):
    """Index pairs (i, j) within the radius and their distances, tile by tile; rows are sorted by key and population count.

    Tiles whose keys part, or whose population counts differ by more than the radius, are skipped.
    """
    n = len(key)
    pops = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    for a in range(0, n, TILE):
        a_end = min(a + TILE, n)
        for b in range(a, n, TILE):
            b_end = min(b + TILE, n)
            if key[b] > key[a_end - 1]:
                break
            if key[a] == key[b_end - 1] and pops[b] - pops[a_end - 1] > radius:
                break  # one key throughout, so counts rise: all further tiles of this key are too far
            far = np.zeros((a_end - a, b_end - b), np.uint16)
            for k in range(words.shape[1]):
                far += np.bitwise_count(words[a:a_end, k, None] ^ words[None, b:b_end, k])
            i, j = np.nonzero(far <= radius)
            if a == b:
                later = j > i
                i, j = i[later], j[later]
            yield i + a, j + b, far[i, j]


def _forest(nodes: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
    """Star rows (node, smallest node of its part) of what the links join, at most one for each row compared."""
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, _ in found:
        if not len(i):
            continue
        rows = np.unique(np.concatenate([i, j]))
        top = np.array([root(x) for x in rows.tolist()])
        a, b = top[np.searchsorted(rows, i)], top[np.searchsorted(rows, j)]
        for x, y in np.unique(np.stack([a, b], axis=1)[a != b], axis=0).tolist():
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    top = np.array([root(x) for x in range(len(nodes))], np.int64)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, top, nodes)
    least = least[top]
    below = nodes != least
    return nodes[below], least[below]


#: Rows that a task compares at a time, unless one band value has more; such values are dealt out again before.
RUN_ROWS = 200_000


def _linked(radius: int, wide: int, by: list[str]):
    """Rows (u, v) of a forest of each run's links: stars around the smallest node."""
    names = _names(wide)

    def flush(table: pa.Table):
        key = np.zeros(table.num_rows, np.int64)
        for c in by:  # equal keys get equal numbers, in order
            v = table.column(c).to_numpy()
            key = key + np.concatenate([[0], np.cumsum(v[1:] != v[:-1])]) if len(v) else key
        words = np.stack([table.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
        nodes, found = table.column("__node").to_numpy(), tile_links(key, words, radius)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _forest(nodes, found)], names=["u", "v"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if rows >= RUN_ROWS:
                table = pa.Table.from_batches(held)
                # cut before the first row of the last key, which may go on
                ends = [table.column(c).to_numpy() for c in by]
                same = np.logical_and.reduce([e == e[-1] for e in ends])
                cut = int(np.argmax(same))
                if cut:
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = table.num_rows - cut
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield flush(pa.Table.from_batches(held))

    return run


def links(prints: DataFrame, wide: int, radius: int, families) -> DataFrame:
    """Rows (u, v) that join every two fingerprints within the radius; ``prints``: __node and the words, distinct.

    ``families``: sets of bands, of each of which linked fingerprints agree on one.  What agrees with too many others is
    dealt out by the next family within its group, so what one task compares is small, whatever is crowded.
    """
    names, out, by = _names(wide), None, []
    rows, fields = prints.select("__node", *names), [T.StructField(n, T.LongType()) for n in ("__node", *names)]
    pops = sum((F.bit_count(n) for n in names), F.lit(0))

    def add(part: DataFrame) -> DataFrame:
        found = arrow_pass(part.repartition(*by).sortWithinPartitions(*by, pops), _linked(radius, wide, by), "u long, v long")
        return found if out is None else out.unionByName(found)

    for level, bands in enumerate(families):
        key = f"__key{level}"
        fields = [T.StructField(key, T.LongType()), *fields]
        rows, by = arrow_pass(rows.select(*(f.name for f in fields[1:])), _banded(bands, names, key), T.StructType(fields)), [*by, key]
        if level + 1 == len(families):
            return add(rows)
        crowds = stored(rows.groupBy(*by).count().where(F.col("count") > HOT).select(*by), "simhash-crowds")
        if crowds.isEmpty():
            return add(rows)
        out = add(rows.join(crowds, by, "left_anti"))
        rows = rows.join(crowds, by, "left_semi")
    return out


#: Rows of a key beyond which what is known of the key is sent to all tasks, and such keys at most; beyond, they are joined.
STAR, SENT = 1000, 50_000


def joined_to(rows: DataFrame, known: DataFrame, key: str, crowded: int) -> DataFrame:
    """``rows`` with the columns of ``known``, which has a row for each key, with the number ``n`` of the key's rows.

    ``crowded``: keys of over ``STAR`` rows.  Their rows are not brought together, as long as ``SENT`` bounds such keys.
    """
    if not 0 < crowded <= SENT:
        return rows.join(known, key)
    large = F.broadcast(known.where(F.col("n") > STAR))
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(known.where(F.col("n") <= STAR), key))


#: Rows of a few numbers that are sent to all tasks, so that texts need not move to meet them; beyond, they are joined.
SENT_ROWS = 300_000


def sent_if_few(known: DataFrame) -> DataFrame:
    """A stored table, sent to all tasks if its rows are counted as few."""
    return F.broadcast(known) if known.count() <= SENT_ROWS else known


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link, by alternating large and small stars.

    It ends when all that has a smaller neighbour has no other one: then what is left are stars.  Each round is tables in the
    shared folder; only two numbers of it come to the driver.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "components")
        crowded, unlike = least.agg(F.count_if(F.col("n") > STAR), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not unlike:
            break
        large = joined_to(both.where("v > u"), least.select("u", "m", "n"), "u", crowded)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "components")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _prints(rows: DataFrame, wide: int) -> DataFrame:
    """Distinct fingerprints, numbered (__node), with the smallest doc_id of their rows and its place (__best)."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), *PLACE)
    found = rows.groupBy(*_names(wide)).agg(F.min(order).alias("__best"))
    return stored(found.withColumn("__node", F.monotonically_increasing_id()), "simhash-prints")  # stored, so numbered once


def _groups(prints: DataFrame, wide: int, edges: DataFrame) -> DataFrame:
    """Fingerprint words with the smallest doc_id of their component (__low) and the place of its row."""
    parts = connected(edges)
    named = stored(prints.join(parts.withColumnRenamed("node", "__node"), "__node").select("__node", "__best", "component"), "simhash-parts")
    best = stored(named.groupBy("component").agg(F.min("__best").alias("__top"), F.count("*").alias("n")), "simhash-best")
    tops = joined_to(named, best, "component", best.where(F.col("n") > STAR).count()).select("__node", "__top")
    joined = prints.join(tops, "__node", "left").withColumn("__top", F.coalesce("__top", "__best"))
    return joined.select(*_names(wide), F.col("__top.d").alias("__low"), *(F.col(f"__top.{p}").alias(p) for p in PLACE))


def components(docs: DataFrame, words: int = 3, radius: int = 2, wide: int = 1) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits for each word), component_id. Finds every link, radius to 3."""
    if radius > 3:
        raise ValueError("exact bands are for a radius of 3 at most")
    names, bits = _names(wide), 64 * wide
    rows = fingerprints(_texts(placed(docs), docs), words, wide)
    prints = _prints(rows, wide)
    families = [exact_bands(bits, radius), striped_bands(bits, radius), striped_bands(bits, radius, 5)]
    groups = _groups(prints, wide, links(prints, wide, radius, families)).drop(*PLACE)
    hexed = F.lower(F.concat(*(F.lpad(F.hex(n), 16, "0") for n in names)))
    return rows.join(groups, names).select("doc_id", hexed.alias("fingerprint"), F.col("__low").alias("component_id"))


def _members(rows: DataFrame, wide: int) -> DataFrame:
    """Distinct shingle sets, numbered (__member), with fingerprint, size, min-hash keys, smallest doc_id and its place (__best)."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), *PLACE)
    found = rows.groupBy(*SET).agg(F.min(order).alias("__best"), *(F.first(n).alias(n) for n in (*_names(wide), "__n", "__keys")))
    return stored(found.withColumn("__member", F.monotonically_increasing_id()), "simhash-members")  # stored, so numbered once


#: Texts of up to so many shingles, whose fingerprints are coarse, are held against each other within a wider radius.
SHORT, SHORT_RADIUS = 32, 80
#: Times that rows of a crowded key are dealt out by further keys, and the share of a key's rows near the first that makes it tight.
LEVELS, TIGHT = 4, 0.9


def candidates(members: DataFrame, wide: int, radius: int, similarity: float) -> DataFrame:
    """Rows (u, v) that join all members which share a min-hash key and lie within the radius, or that for short ones."""
    longest = int(SHORT / similarity + 1e-9)
    long, short = members.where(F.col("__n") > SHORT), members.where(F.col("__n") <= longest)
    return _meetings(long, wide, radius).unionByName(_meetings(short, wide, SHORT_RADIUS))


def _meetings(members: DataFrame, wide: int, radius: int) -> DataFrame:
    """The same of members of one radius, whatever keys are crowded.

    A key of over ``HOT`` members is tight if most of them lie near its first, as copies of one text do: they are joined
    to that, all of them, which joins more, never less.  Otherwise, as where unlike texts share a passage, its members are
    dealt out again by each two of their keys, then by each three, and so on: similar ones share many keys, others few.
    """
    names, out, last = _names(wide), None, LEVELS - 1
    pops = sum((F.bit_count(n) for n in names), F.lit(0))
    key = F.explode("__keys").alias("__key")
    rows = members.select(key, F.col("__member").alias("__node"), *names, "__keys").withColumn("__used", F.array("__key"))

    def joined(more: DataFrame) -> DataFrame:
        return more if out is None else out.unionByName(more)

    for level in range(LEVELS):
        first = F.min(F.struct("__node", *names)).alias("__first")
        crowds = stored(rows.groupBy("__key").agg(F.count("*").alias("n"), first).where(F.col("n") > HOT), "simhash-crowds")
        few = crowds.count()
        known = F.broadcast(crowds) if few <= SENT else crowds
        calm = rows.join(known.select("__key"), "__key", "left_anti") if few else rows
        dealt = calm.select("__key", "__node", *names).repartition("__key").sortWithinPartitions("__key", pops)
        out = joined(arrow_pass(dealt, _linked(radius, wide, ["__key"]), "u long, v long"))
        if not few:
            break
        hot = rows.join(known.select("__key", "__first"), "__key")
        far = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"__first.{n}"))) for n in names), F.lit(0))
        shares = hot.groupBy("__key").agg(F.avg((far <= radius).cast("double")).alias("share"))
        tight = stored(shares.select("__key", (F.lit(level == last) | (F.col("share") >= TIGHT)).alias("__tight")), "simhash-tight")
        hot = hot.join(F.broadcast(tight) if few <= SENT else tight, "__key")
        out = joined(hot.where("__tight").select(F.col("__node").alias("u"), F.col("__first.__node").alias("v")).where("u <> v"))
        if level == last or tight.where("not __tight").isEmpty():
            break
        again = hot.where("not __tight").select("__key", "__node", *names, "__keys", "__used", F.explode(F.array_except("__keys", "__used")).alias("__other"))
        again = again.withColumns({"__key": F.xxhash64("__key", "__other"), "__used": F.concat("__used", F.array("__other"))})
        rows = stored(again.drop("__other"), "simhash-again")
    return out


#: Members of a candidate component, and shingles of theirs, to a block; larger components are cut into blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 2_000_000
#: Members that are held against all others, and of those others, to a group, at most.
ASK_MEMBERS = 4_000
#: Pivots of a large component, about.
PIVOTS = 16
#: Shingles that are looked up at a time.
LOOKED_UP = 1_000_000


def similar_pairs(
    words: list[np.ndarray], sets: list[np.ndarray], radius: int, similarity: float, label: np.ndarray | None = None, asks: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Index pairs that join whatever all pairs within the radius and of the similarity join, all of them such pairs.

    A pair is left out only if verified pairs join it already, so no link is lost to one that fails.  ``label``: parts
    that are joined from the start; ``asks``: rows that are held against all that do not ask (default: all against all).
    Where one set is short, the wider radius holds.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    seen, label, out = np.zeros(len(names), bool), np.arange(n) if label is None else np.unique(label, return_inverse=True)[1], []
    small, told = sizes <= SHORT, None if asks is None else np.nonzero(~asks)[0]
    for i in range(n - 1) if asks is None else np.nonzero(asks)[0].tolist():
        later, size = np.arange(i + 1, n) if told is None else told, sizes[i]
        others = sizes[later]
        near = (label[later] != label[i]) & (np.minimum(others, size) >= similarity * np.maximum(others, size) - 1e-9) & (others > 0)
        todo = later[near]
        if not len(todo):
            continue
        far = np.zeros(len(todo), np.uint16)
        for w in words:
            far += np.bitwise_count(w[todo] ^ w[i])
        near = far <= np.where(small[todo] | small[i], max(radius, SHORT_RADIUS), radius)
        todo, far = todo[near], far[near]
        todo = todo[np.argsort(far, kind="stable")]
        mine, step = flat[starts[i] : starts[i + 1]], 16
        seen[mine] = True
        while len(todo):
            at = todo[: max(1, min(step, int(np.searchsorted(np.cumsum(sizes[todo[:step]]), LOOKED_UP))))]
            todo, step, counts = todo[len(at) :], step * 2, sizes[at]
            firsts = np.cumsum(counts) - counts
            places = np.repeat(starts[at] - firsts, counts) + np.arange(int(counts.sum()))
            both = np.add.reduceat(seen[flat[places]], firsts, dtype=np.int64)
            good = at[both >= similarity * (size + counts - both) - 1e-9]
            if len(good):
                parts, one = np.unique(label[good], return_index=True)
                out += [(i, int(j)) for j in good[one]]
                label[np.isin(label, parts)] = label[i]
                todo = todo[label[todo] != label[i]]
        seen[mine] = False
    return out


def _compared(wide: int, radius: int, similarity: float, asking: bool = False):
    """Rows (u, v) of verified links for rows of __group, __member, fingerprint words and shingles, sorted by __group.

    ``asking``: two more columns, the part that the row is in and whether it asks; other pairs are known not to matter.
    """

    def flush(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        member = table.column(1).to_numpy()
        words = [table.column(2 + k).to_numpy().view(np.uint64) for k in range(wide)]
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column(2 + wide)]
        part, asks = (table.column(3 + wide).to_numpy(), table.column(4 + wide).to_numpy(zero_copy_only=False)) if asking else (None, None)
        pairs = np.array(similar_pairs(words, sets, radius, similarity, part, asks), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(member[pairs[:, k]]) for k in range(2)], names=["u", "v"])

    def run(batches):
        held, group = [], None
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if held and key[a] != group:
                    yield flush(held)
                    held = []
                group = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(held)

    return run


def shingle_sets(rows: DataFrame, members: DataFrame, edges: DataFrame, words: int, wide: int) -> DataFrame:
    """component, __member, fingerprint words and shingles of every member of a candidate component, stored; made once for each set."""
    names = _names(wide)
    places = members.join(connected(edges).withColumnRenamed("node", "__member"), "__member")
    places = stored(places.select("component", "__member", *names, *(F.col(f"__best.{p}").alias(p) for p in PLACE)), "simhash-places")
    texts = rows.select(*PLACE, "text").join(sent_if_few(places), PLACE).select("component", "__member", *names, "text")

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)).tobytes() for t in texts_of(batch, 2 + wide)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 2 + wide], pa.array(found, pa.binary())], names=[*batch.schema.names[: 2 + wide], "shingles"])

    return stored(arrow_pass(texts, sets, ", ".join(f"{n} long" for n in ["component", "__member", *names]) + ", shingles binary"), "simhash-sets")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("__group").sortWithinPartitions("__group")


def verified(known: DataFrame, wide: int, radius: int, similarity: float) -> DataFrame:
    """Rows (u, v) of links between members, all of the similarity, that join whatever all such pairs of one component join."""
    names = _names(wide)
    columns = ["__group", "__member", *names, "shingles"]
    sizes = known.groupBy("component").agg(F.count("*").alias("n"), (F.sum(F.length("shingles")) / 8).cast("long").alias("s"))
    # a block of a large component is a group; pivots, a part of the members chosen by hash, are in all its blocks
    blocks = F.expr(f"1 + greatest(n div {BLOCK_MEMBERS}, s div {BLOCK_SHINGLES})").alias("__blocks")
    large = stored(sizes.select("component", "n", "s", blocks).where("__blocks > 1"), "simhash-large")
    few = large.count()
    if not few:
        return arrow_pass(_dealt(known.withColumnRenamed("component", "__group").select(*columns)), _compared(wide, radius, similarity), "u long, v long")
    big = F.broadcast(large) if few <= SENT else large
    block = F.pmod(F.xxhash64("__member"), "__blocks")
    cut = known.join(big, "component").withColumn("__block", block)
    pivot = F.pmod(F.xxhash64("__member", F.lit("pivot")), F.greatest(F.lit(1).cast("long"), F.expr(f"n div {PIVOTS}"))) == 0
    others = cut.where(pivot).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).where("__other <> __block")
    grouped = lambda other: F.xxhash64("component", F.lit(-1).cast("long"), other).alias("__group")
    first = cut.select(grouped(F.col("__block")), *columns[1:]).unionByName(others.select(grouped(F.col("__other")), *columns[1:]))
    small = known.join(big, "component", "left_anti").select(F.xxhash64("component").alias("__group"), *columns[1:])
    found = stored(arrow_pass(_dealt(small.unionByName(first)), _compared(wide, radius, similarity), "u long, v long"), "simhash-verified")

    # the main part of each large component, and what is outside of it
    parts = connected(found).withColumnRenamed("node", "__member").withColumnRenamed("component", "__part")
    named = stored(cut.join(parts, "__member", "left").withColumn("__part", F.coalesce("__part", "__member")), "simhash-parts")
    sums = named.groupBy("component", "__part").agg(F.count("*").alias("m"))
    main = sums.groupBy("component").agg(F.max(F.struct("m", "__part")).alias("top"), F.sum("m").alias("n"))
    loose = main.select("component", F.col("top.__part").alias("__main"), F.expr("n - top.m").alias("__loose")).where("__loose > 0")
    if loose.isEmpty():
        return found
    rest = named.join(F.broadcast(loose) if few <= SENT else loose, "component").withColumn("__asks", F.col("__part") != F.col("__main"))
    # the rest in groups of up to ASK_MEMBERS meets all members, in groups that are as large as there is of the rest
    asked = F.expr(f"1 + greatest(__loose div {ASK_MEMBERS}, __loose * (s div n) div {BLOCK_SHINGLES})")
    told_in = F.expr(f"1 + greatest(n div least(greatest(__loose, {BLOCK_MEMBERS}), {ASK_MEMBERS}), s div {BLOCK_SHINGLES})")
    rest = rest.withColumns({"__asked": asked, "__told": told_in})
    turn = lambda name, n: F.pmod(F.xxhash64("__member", F.lit(name)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = rest.where("__asks").withColumn("__a", turn("ask", F.col("__asked"))).withColumn("__b", each("__told"))
    told = rest.withColumn("__a", each("__asked")).withColumn("__b", turn("told", F.col("__told")))
    met = lambda rows, ask: rows.select(F.xxhash64("component", "__a", "__b").alias("__group"), *columns[1:], "__part", ask.alias("__asks"))
    # a member that asks and is told in one group is there twice, of one part, so it does not meet itself
    second = met(asks, F.lit(True)).unionByName(met(told, F.lit(False)))
    return found.unionByName(arrow_pass(_dealt(second), _compared(wide, radius, similarity, asking=True), "u long, v long"))


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, wide: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps the one with the smallest doc_id.

    ``similarity`` is the Jaccard similarity of shingle sets, so the fingerprints are of distinct shingles.  Texts that have it differ in some share of bits on average;
    the radius is that share and three standard deviations, at which unrelated texts, which differ in half the bits, still
    lie nine standard deviations beyond it.
    """
    bits, share = 64 * wide, expected_share(similarity)
    radius = int(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    rows = placed(docs)
    texts = _texts(rows, docs)
    found = set_fingerprints(texts, words, wide)
    members = _members(found, wide)
    near = candidates(members, wide, radius, similarity)
    same = verified(shingle_sets(texts, members, near, words, wide), wide, radius, similarity)
    parts = connected(same).withColumnRenamed("node", "__member")
    named = members.join(parts, "__member", "left").groupBy(F.coalesce("component", "__member")).agg(F.min("__best").alias("__top"))
    stay = named.select(*(F.col(f"__top.{p}").alias(p) for p in PLACE))
    gone = stored(found.select(*PLACE).join(stay, PLACE, "left_anti"), "simhash-gone")  # far fewer than stay, and without texts
    return handed_on(rows.join(sent_if_few(gone), PLACE, "left_anti"), docs)
