"""Exact dedup against grouping by the normalised text; tries with and without spill."""

from __future__ import annotations

import hashlib
import random

import pytest

from landrank.llm import exact_dedup
from landrank.llm.exact_dedup import PatriciaTrie, preference


def normal(text):
    return (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")


def brute(rows):
    """doc_id, keep_id, group_size, kept, digest; of rows alike in all that counts any may stay."""
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(normal(r[1]), []).append((len(r[1] or ""), r[0], i))
    out = []
    for key, members in groups.items():
        owner = min(members, key=preference)
        out += [(m[1], owner[1], len(members), m[2] == owner[2], hashlib.sha256(key).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_table(odd, odd_more, none, odd_rows, rows_of):
    assert rows_of(exact_dedup.membership(odd)) == brute(odd_rows)
    assert rows_of(exact_dedup.membership(odd_more)) == brute(odd_rows)
    assert exact_dedup.membership(none).collect() == [] and exact_dedup.survivors(none).collect() == []


def test_survivors_are_the_kept_rows(odd, odd_more, odd_rows, rows_of):
    kept = sorted(((r[0], r[2]) for r in brute(odd_rows) if r[3]), key=str)
    got = exact_dedup.survivors(odd_more)
    assert got.columns == odd_more.columns
    assert len(got.collect()) == len(kept) and sorted((str(r["doc_id"]) for r in got.collect())) == sorted(str(k[0]) for k in kept)
    assert rows_of(exact_dedup.survivors(odd), "doc_id") == sorted(((k[0],) for k in kept), key=str)


def test_large_group_over_many_batches(spark, rows_of, monkeypatch):
    rows = [(i, ["same text", "same  text", "sametext"][i % 3] if i % 2 else f"own {i}", "en", "s", 1) for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr("landrank.llm.common.BATCH_ROWS", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert rows_of(exact_dedup.membership(df)) == brute(rows)
    assert exact_dedup.survivors(df).count() == len({normal(r[1]) for r in rows})


@pytest.mark.parametrize("limit", [1 << 30, 3000, 600, 250])
def test_trie_with_spill(limit):
    r = random.Random(limit)
    keys = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 12))) for _ in range(500)]
    rows = sorted(((r.randint(0, 3), r.choice([None, *range(9)]), i, k) for i, k in enumerate(keys)), key=preference)
    trie, got = PatriciaTrie(limit), {}
    for row in rows:
        owner = trie.place(row[3], row)
        if owner is not None:
            got[row[2]] = owner[2]
    got |= {row[2]: owner[2] for row, owner in trie.waiting()}
    first = {}
    for row in rows:
        first.setdefault(row[3], row[2])
    assert got == {row[2]: first[row[3]] for row in rows}


def test_trie_keeps_the_best_in_any_order():
    trie = PatriciaTrie()
    for row in ((3, 9, 0), (5, 9, 1), (5, 2, 2), (5, None, 3)):
        owner = trie.place(b"abc", row)
    assert owner == (5, 2, 2) and trie.place(b"abd", (1, 1, 4)) == (1, 1, 4) and trie.place(b"", (0, 0, 5)) == (0, 0, 5)


def test_copies_of_many_batches_are_thinned_in_a_task():
    """Of a text that every batch of a task holds, few rows go on: the first, and better ones after it."""
    import pyarrow as pa

    kind = pa.struct([("c0", pa.int64()), ("c1", pa.string())])

    def batch(rows):
        row = pa.array([{"c0": i, "c1": t} for i, t in rows], kind)
        ids, points = pa.array([i for i, _ in rows]), pa.array([len(t) for _, t in rows], pa.int32())
        return pa.RecordBatch.from_arrays([row, ids, ids, points], names=["row", "doc_id", "__rid", "__points"])

    batches = [batch([(10 * k + j, "same text" if j < 8 else f"own {k} {j}") for j in range(10)]) for k in range(50)] + [batch([(900, "same  text")])]
    got = [r["c1"] for b in exact_dedup._thinned("c1")(iter(batches)) for r in b.column(0).to_pylist()]
    assert got.count("same text") == 1 and got.count("same  text") == 1 and len(got) == 102
