"""Operator 9: mixing sources to target weights by blocks, shard draws and index permutations.

1. Every source's words, in a fixed order of its documents, are packed into blocks of ``block`` words.
2. A source's target is its weight's share of all words, at most ``most`` times its own words, the excess shared again by
   weight among the others until none is above.
3. A source fills as many slots as its target takes blocks, counted at their mean length (its last block may be short), so
   that tiny sources come near their targets too.  The slots of all sources are cut into shards.  Each shard draws its
   sources' counts: the draws of all shards are one multinomial draw for each, conditional on the sources' totals, so
   each shard is random and the totals are met.  Such counts are drawn by halves: of the counts of a run of shards, those
   of its first half are a multivariate hypergeometric draw, seeded by the run; a shard's counts, and where its slots
   begin among its sources' slots, follow from the few runs that hold it, without a look at other shards.
4. The j-th slot of a source takes block ``permutation(j mod blocks)`` of pass ``j div blocks``; the permutation is a keyed
   four-round Feistel network on the index, walked until it falls within the source.  Slots and blocks are joined by index.

Rows, words and slots are never gathered: documents get their offsets from sums over bins of rows and sums over groups of
bins; slots are dealt by block, of which each has at most ``most`` + 1 slots.  Only one row a source comes to the driver,
which ``SOURCES`` bounds.  A source's slots never exceed ``most`` passes over its blocks.

Cases.  Null or empty text: size 0, takes 0.  Null source: a source of its own, last.  Empty source name: a source like
any other.  Rows repeated: each has its own words.  Null doc_id: handed on.  Empty table, or no words at all: targets and
counts of 0.  Extra columns, whatever their names, are not read, and handed on by ``mixed_documents``.  Ties in the order
of documents are between rows of one doc_id, text and size; where very many such rows share a bin, all rows of the bin go
by their places in the files.  Over ``SOURCES`` sources: an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, field_of, handed_on, importable, placed, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of a block, slots of a shard, rows of a bin, bins of a group, sources at most (its row has some 100 bytes).
BLOCK, SHARD, BIN_ROWS, GROUP, SOURCES = 32, 4096, 500, 1000, 100_000
#: A bin of so many times its rows is split, into so many parts at most.
CROWD, SPLIT = 20, 1 << 20
#: Shards of a task that draws.
DRAWN = 64
SEED = 7


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    left, weight = total, float(sum(weights))
    for i in order:  # those that reach their limit first come first; the rest share by weight what is left
        share = left * weights[i] / weight if weight > 0 else 0.0
        out[i] = float(min(most * sizes[i], share))
        left -= out[i]
        weight -= weights[i]
    return out


def slot_totals(sizes: list[int], wanted: list[float], most: float, block: int) -> list[int]:
    """Slots of each source: its target in blocks of the mean length of its own, ``most`` passes at most."""
    return [min(int(most) * -(-s // block), round(t * -(-s // block) / s)) if s else 0 for s, t in zip(sizes, wanted, strict=True)]


#: Above this, numpy's hypergeometric draw is not defined; counts so large are drawn from the normal law of the same mean and variance.
LARGE = 500_000_000


def halved(counts: np.ndarray, first: int, seed: list[int]) -> np.ndarray:
    """How many of ``counts`` fall into the first ``first`` of all their slots: a multivariate hypergeometric draw."""
    rng, total = np.random.Generator(np.random.PCG64(seed)), int(counts.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(counts, first, method="marginals")
    out, left, room = np.zeros(len(counts), np.int64), total, first
    for k, c in enumerate(counts.tolist()):  # each source in turn, of what the ones before have left
        if left < LARGE:
            out[k:] = rng.multivariate_hypergeometric(counts[k:], room, method="marginals")
            break
        share = c / left
        spread = (room * share * (1 - share) * (left - room) / max(left - 1, 1)) ** 0.5
        out[k] = min(max(round(room * share + spread * rng.standard_normal()), 0, room - (left - c)), c, room)
        left, room = left - c, room - int(out[k])
    return out


def shard_counts(low: int, high: int, slots: np.ndarray, shard: int):
    """(shard, sources, counts, first) of the shards from ``low`` to before ``high``; ``slots``: totals of all sources.

    ``first``: the place of the shard's first slot among each source's slots.
    """
    total = int(slots.sum())
    held = np.nonzero(slots)[0]
    todo = [(0, -(-total // shard), held, slots[held], np.zeros(len(held), np.int64))]
    while todo:
        a, b, names, counts, before = todo.pop()
        if b <= low or a >= high or a >= b:
            continue
        if b - a == 1:
            yield a, names, counts, before
            continue
        middle = (a + b) // 2
        left = halved(counts, (middle - a) * shard, [SEED, a, b])
        some, rest = left > 0, counts > left
        todo.append((middle, b, names[rest], (counts - left)[rest], (before + left)[rest]))
        todo.append((a, middle, names[some], left[some], before[some]))


def permuted(index: np.ndarray, size, key) -> np.ndarray:
    """Pseudorandom permutations of range(size), at ``index``; size and key are numbers, or one for each index."""
    size, key = (np.broadcast_to(np.asarray(x, np.int64), index.shape) for x in (size, key))
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.int64)
    bits += (np.int64(1) << bits) < size  # where the logarithm fell short
    half = np.maximum(1, (bits + 1) // 2).astype(np.uint64)
    mask, out = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            mix = (right + ((k * 4 + r + 1) & 0xFFFFFFFF).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mix >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sized(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words, hash of the text and place of every placed row; one pass over the texts, stored without them."""
    doc_id, source, text = (F.col(f"row.{field_of(docs, n)}").cast(t) for n, t in (("doc_id", "long"), ("source", "string"), ("text", "string")))
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return stored(rows.select(doc_id.alias("doc_id"), source.alias("source"), words.alias("size"), F.xxhash64(text).alias("hash"), *PLACE), "mix-sizes")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Per document doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return _taken(_sized(placed(docs), docs), **options).drop(*PLACE, "at")


def mix_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, a row for each slot: shard, slot (of its source), source, block, pass."""
    return _taken(_sized(placed(docs), docs), blocks=True, **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, all columns: each as often as the mix takes its words on average.

    A document of which the mix takes ``taken`` of ``size`` words comes ``taken div size`` times, and once more where the
    rest, as a share of its size, exceeds a number hashed from its doc_id and its place in the source, which differs
    between rows of one doc_id.  Documents without words take part in no draw; they stay once.
    """
    rows = placed(docs)
    drawn = F.pmod(F.xxhash64("doc_id", "at", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rest = F.expr("(taken % size) / size") > drawn
    times = F.when(F.col("size") == 0, 1).otherwise(F.expr("taken div size").cast("int") + rest.cast("int"))
    copies = _taken(_sized(rows, docs), **options).select(*PLACE, times.alias("__times")).where("__times > 0")
    every = F.explode(F.sequence(F.lit(1), F.col("__times")))
    return handed_on(rows.join(copies, PLACE).select("row", every), docs)


def _taken(rows: DataFrame, weights=WEIGHTS, most: int = 3, block: int = BLOCK, shard: int = SHARD, blocks: bool = False) -> DataFrame:
    spark = rows.sparkSession
    importable(spark)
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"over {SOURCES} sources: group them first")
    # UTF-8 bytes sort as code points do; null comes last
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    n_blocks = np.array([-(-s // block) for s in sizes], np.int64)
    totals = np.array(slot_totals(sizes, wanted, most, block), np.int64)
    known = spark.createDataFrame(
        [(i, r["source"], max(1, r["n"] // BIN_ROWS), s, t) for i, (r, s, t) in enumerate(zip(found, sizes, wanted, strict=True))],
        "__s int, __name string, __bins long, source_size long, target double",
    )

    # where each document's words begin in its source: sums of rows before it in its bin, of bins in its group, of groups
    named = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__name")))
    named = named.withColumn("__bin", F.pmod(F.xxhash64("doc_id", "hash", "size"), "__bins") * SPLIT)
    # a bin of very many rows, as of one that is repeated, is split by the rows' places; there are few such bins by their size
    crowded = named.groupBy("__s", "__bin").agg(F.count("*").alias("__n")).where(F.col("__n") > CROWD * BIN_ROWS)
    named = named.join(F.broadcast(crowded), ["__s", "__bin"], "left")
    split = F.pmod(F.xxhash64(*PLACE), F.least(F.lit(SPLIT).cast("long"), F.expr(f"__n div {BIN_ROWS}")))
    named = named.withColumn("__bin", F.col("__bin") + F.when(F.col("__n").isNotNull(), split).otherwise(0))
    sums = named.groupBy("__s", "__bin").agg(F.sum("size").alias("__sum")).withColumn("__group", F.expr(f"__bin div {GROUP * SPLIT}"))
    before = lambda column, order, *by: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("__s", "__group").agg(F.sum("__sum").alias("__all"))
    groups = groups.select("__s", "__group", before("__all", ["__group"], "__s").alias("__first"))
    starts = sums.withColumn("__start", before("__sum", ["__bin"], "__s", "__group")).join(groups, ["__s", "__group"])
    starts = starts.select("__s", "__bin", (F.col("__first") + F.col("__start")).alias("__start"))
    offsets = named.withColumn("__within", before("size", ["doc_id", "hash", "size", *PLACE], "__s", "__bin")).join(starts, ["__s", "__bin"])
    offsets = offsets.select(*PLACE, "doc_id", "size", "source_size", "target", "__s", (F.col("__start") + F.col("__within")).alias("at"))

    # slots: counts of each shard, and the blocks that they map to
    shards = -(-int(totals.sum()) // shard)
    shared = spark.sparkContext.broadcast((totals, n_blocks))  # two numbers a source: SOURCES bounds them

    def mapped(batches):
        slots, blocks_of = shared.value
        for batch in batches:
            for low in batch.column(0).to_pylist():
                for h, names, counts, first in shard_counts(low * DRAWN, min(shards, low * DRAWN + DRAWN), slots, shard):
                    source = np.repeat(names, counts)
                    j = np.repeat(first, counts) + np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
                    rounds, at = j // blocks_of[source], j % blocks_of[source]
                    index = permuted(at, blocks_of[source], source * 1009 + rounds)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(j), h)), pa.array(j), pa.array(source.astype(np.int32)), pa.array(index), pa.array(rounds)],
                        names=["shard", "slot", "__s", "__block", "pass"],
                    )

    runs = -(-shards // DRAWN)
    slots = spark.range(0, runs, 1, max(1, min(runs, 100_000))).mapInArrow(mapped, "shard long, slot long, __s int, __block long, pass long")
    if blocks:
        return slots.join(F.broadcast(known), "__s").select("shard", "slot", F.col("__name").alias("source"), F.col("__block").alias("block"), "pass")
    times = slots.groupBy("__s", "__block").agg(F.count("*").alias("__times"))

    first, last = F.expr(f"at div {block}"), F.expr(f"greatest(at, at + size - 1) div {block}")
    parts = offsets.withColumn("__block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("__block") + 1) * block) - F.greatest(F.col("at"), F.col("__block") * block)
    # slots are made in Python of a few rows, so their size is not seen when the join is planned: it must not be broadcast
    hit = parts.withColumn("__words", overlap).join(times.hint("merge"), ["__s", "__block"], "left")
    whole = F.sum(F.col("__words") * F.coalesce("__times", F.lit(0))).cast("long")
    return hit.groupBy(*PLACE, "doc_id", "size", "source_size", "target", "at").agg(whole.alias("taken"))
