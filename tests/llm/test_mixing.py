"""Targets, draws, permutations and the mix as a whole."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import xxhash

from landrank.llm import mixing

DOCS = "doc_id long, text string, source string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, most):
    """Shares by weight; what is above the limit is shared again by weight among the rest, until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 10, 1000, 100000]) for _ in range(r.randint(1, 9))]
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 3)
    assert got == pytest.approx(plain_targets(sizes, weights, 3)) and sum(got) == pytest.approx(sum(sizes))


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 5):
            assert sorted(mixing.permuted(np.arange(n), n, key)) == list(range(n))
    assert list(mixing.permuted(np.arange(100), 100, 1)) != list(mixing.permuted(np.arange(100), 100, 2))


def test_permutations_of_many_sizes_at_once():
    sizes = np.repeat([1, 2, 5, 33, 1000], [1, 2, 5, 33, 1000])
    index = np.concatenate([np.arange(n) for n in (1, 2, 5, 33, 1000)])
    got = mixing.permuted(index, sizes, sizes * 3)
    for n in (1, 2, 5, 33, 1000):
        assert sorted(got[sizes == n]) == list(range(n)) and list(got[sizes == n]) == list(mixing.permuted(np.arange(n), n, 3 * n))


def test_draws():
    """Counts of shards are whole, meet the totals, spread as multinomial ones do, and do not depend on who draws them."""
    totals = np.array([20000, 0, 9000, 2993, 7])
    every = list(mixing.shard_counts(0, 400, totals, 80))
    counts, before = np.zeros((401, 5), np.int64), np.zeros(5, np.int64)
    for h, names, n, first in every:
        counts[h, names] = n
        assert (first == before[names]).all() and (n > 0).all()
        before[names] += n
    assert [h for h, *_ in every] == list(range(400)) and (before == totals).all()
    assert (counts[:400].sum(axis=1) == 80).all()
    p = totals / totals.sum()
    assert counts[:400].std(axis=0) == pytest.approx((80 * p * (1 - p)) ** 0.5, rel=0.15)
    some = list(mixing.shard_counts(123, 125, totals, 80))
    assert [(h, n.tolist(), c.tolist(), f.tolist()) for h, n, c, f in some] == [(h, n.tolist(), c.tolist(), f.tolist()) for h, n, c, f in every[123:125]]


def test_draws_of_very_many_slots():
    totals = np.array([3_000_000_000, 40_000_000_000, 5, 0, 700_000_000])
    left = mixing.halved(totals, int(totals.sum()) // 2, [7, 0, 9])
    assert int(left.sum()) == int(totals.sum()) // 2 and (left <= totals).all() and (left >= 0).all()
    assert left[:2] == pytest.approx(totals[:2] / 2, rel=1e-3)
    shards = -(-int(totals.sum()) // 4096)
    got = list(mixing.shard_counts(shards - 3, shards, totals, 4096))
    assert len(got) == 3 and got[0][2].sum() == 4096 and (got[-1][3] + got[-1][2] <= totals[got[-1][1]]).all()


def test_table(odd, odd_more, none, odd_rows, rows_of):
    got = rows_of(mixing.mixed(odd))
    assert sorted((r[:2] for r in got), key=str) == sorted(((r[0], size(r[1])) for r in odd_rows), key=str)
    assert rows_of(mixing.mixed(odd_more)) == got == rows_of(mixing.mixed(odd.repartition(5)))
    own = {}
    for r in odd_rows:
        own[r[3]] = own.get(r[3], 0) + size(r[1])
    order = [*sorted((s for s in own if s is not None)), None]
    want = dict(zip(order, plain_targets([own[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 3), strict=True))
    assert sorted({(r[2], round(r[3], 6)) for r in got}) == sorted({(own[s], round(want[s], 6)) for s in order})
    assert all(0 <= r[4] <= 3 * r[1] for r in got)
    assert mixing.mixed(none).collect() == [] and mixing.mixed_documents(none).collect() == []
    empty = odd.where("text is null")
    assert [r["taken"] for r in mixing.mixed(empty).collect()] == [0, 0]


def test_taken_words_come_near_targets(spark):
    r = random.Random(12)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(1500)]
    rows += [(9000 + i, "w " * 40, "tiny") for i in range(5)]
    found = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    sums = {}
    for x in found:
        sums.setdefault((x["source_size"], x["target"]), []).append(x)
    assert len(sums) == 6
    for (_, target), members in sums.items():
        assert sum(x["taken"] for x in members) == pytest.approx(target, rel=0.02, abs=64)
        assert all(x["taken"] <= 3 * x["size"] for x in members)


def test_mix_blocks_are_joined_by_index(spark):
    rows = [(i, "w " * 100, s) for i, s in enumerate("aabbcc")]
    got = mixing.mix_blocks(spark.createDataFrame(rows, DOCS), block=8, shard=10).collect()
    for s in "abc":
        mine = sorted((x["slot"], x["pass"], x["block"]) for x in got if x["source"] == s)
        assert [m[0] for m in mine] == list(range(len(mine)))
        for p in {m[1] for m in mine}:
            blocks = [m[2] for m in mine if m[1] == p]
            assert len(set(blocks)) == len(blocks) and max(blocks) < 25
            assert len(blocks) == 25 or p == max(m[1] for m in mine)


def test_documents_of_the_mix(spark, odd_more):
    rows = [(i, "w " * 50, s, "x") for i, s in enumerate("a" * 30 + "b" * 300 + "c" * 60)]
    df = spark.createDataFrame(rows, DOCS + ", extra string")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    want = dict(zip("abc", plain_targets([1500, 15000, 3000], [5, 2, 1], 3), strict=True))
    assert all(n[s] * 50 == pytest.approx(want[s], rel=0.15) for s in "abc")
    assert mixing.mixed_documents(odd_more).columns == odd_more.columns
    zero = mixing.mixed_documents(odd_more.where("text is null or text = ''"))
    assert zero.count() == 3


def plain_hash(*values):
    """Spark's xxhash64 of longs and strings."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_mix(rows, block=mixing.BLOCK):
    """taken of each (doc_id, text, source): words in order, slots one after another, every word counted."""
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in order]
    wanted = plain_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(order))], 3)
    taken = {}
    for k, s in enumerate(order):
        mine = [r for r in rows if r[2] == s]
        bins = max(1, len(mine) // mixing.BIN_ROWS)
        hashed = lambda r: plain_hash(r[1]) if r[1] is not None else 42
        mine.sort(key=lambda r: (plain_hash(r[0], hashed(r), size(r[1])) % bins, r[0] is not None, r[0] or 0, hashed(r), size(r[1])))
        words = [r[0] for r in mine for _ in range(size(r[1]))]
        blocks = [words[i : i + block] for i in range(0, len(words), block)]
        for slot in range(min(3 * len(blocks), round(wanted[k] * len(blocks) / sizes[k])) if sizes[k] else 0):
            turn, at = divmod(slot, len(blocks))
            for d in blocks[int(mixing.permuted(np.array([at]), len(blocks), k * 1009 + turn)[0])]:
                taken[d] = taken.get(d, 0) + 1
    return taken


def test_taken_of_each_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 20)
    monkeypatch.setattr(mixing, "GROUP", 3)
    r = random.Random(14)
    rows = [(i, " ".join(["w"] * r.randint(0, 90)) or None, r.choice(["a", "a", "a", "b", "", "d", None])) for i in range(700)]
    got = {x["doc_id"]: x["taken"] for x in mixing.mixed(spark.createDataFrame(rows, DOCS), shard=64).collect()}
    want = plain_mix(rows)
    assert got == {i: want.get(i, 0) for i, *_ in rows}


def test_tiny_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 400, "big") for i in range(50)] + [(100, "one two three four five", "tiny"), (101, "w " * 33, "small"), (102, "w " * 100, "some")]
    for x in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect():
        if x["doc_id"] >= 100:
            assert x["taken"] == pytest.approx(x["target"], abs=32) and x["taken"] <= 3 * x["size"]
            assert x["doc_id"] != 100 or x["taken"] == 15


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 50), f"host{i // 2}") for i in range(6000)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6000 and all(x["taken"] <= 3 * x["size"] for x in got)
    assert sum(x["taken"] for x in got) == pytest.approx(sum(x["size"] for x in got), rel=0.05)


def test_rows_of_one_to_many_plans(spark, tmp_path):
    """Rows that come of explode or a join have no place in a file of their own; none is lost."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(i, "w " * 40, "ab"[i % 2]) for i in range(60)], DOCS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for many in (docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("n"), docs.crossJoin(spark.range(3)).drop("id"), docs.unionByName(docs)):
        got = mixing.mixed(many).collect()
        assert len(got) == many.count() and all(0 <= x["taken"] <= 3 * x["size"] for x in got)
        out = mixing.mixed_documents(many).count()
        assert out == pytest.approx(many.count(), rel=0.1)


def test_null_ids_are_drawn_apart(spark):
    rows = [(None, f"w{i} " * 40, "ab"[i % 4 == 0]) for i in range(600)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, DOCS)).count()
    assert got == pytest.approx(600, rel=0.06)


def test_a_row_repeated_very_often(spark, monkeypatch):
    """Bins that hold very many rows are split; words are still packed without a gap."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 10)
    rows = [(7, "w " * 10, "a")] * 3000 + [(i, "w " * 10, "a") for i in range(200)] + [(None, None, None)] * 500
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df, most=1).collect()
    assert len(got) == 3700 and all(x["taken"] == x["size"] for x in got)  # one pass over one source takes every word once
    offsets = sorted(x["at"] for x in mixing._taken(mixing._sized(mixing.placed(df), df)).where("size > 0").collect())
    assert offsets == list(range(0, 32000, 10))
