"""SimHash against bits counted one by one and links found pair by pair."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from landrank.llm import simhash


def plain_fingerprint(text, words=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    prints = [plain_fingerprint(r[1]) for r in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                part[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        low[root(i)] = min(low.get(root(i), key), key)
    return sorted(((r[0], f"{prints[i]:016x}", None if low[root(i)][0] else low[root(i)][1]) for i, r in enumerate(rows)), key=str)


def test_sparks_hash_is_the_same(spark):
    texts = ["", "a", "one two three", "é ñ 漢字", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()
    assert all(r["h"] % 2**64 == xxhash.xxh64_intdigest(r["t"].encode(), 42) for r in rows)


def test_table(odd, odd_more, none, odd_rows, rows_of):
    got = rows_of(simhash.components(odd))
    assert got == plain_components(odd_rows)
    assert rows_of(simhash.components(odd_more)) == got
    assert simhash.components(none).collect() == [] and simhash.representatives(none).collect() == []


def test_majority_of_many():
    r = np.random.default_rng(1)
    for n in (1, 2, 254, 255, 256, 511, 2000):
        h = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
        assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def _prints(spark, values):
    return spark.createDataFrame([(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)], "__node long, __f0 long")


def _parts(edges):
    part = {}

    def root(x):
        while part.get(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return root


def _links_agree(spark, values, radius=2):
    edges = [(r["u"], r["v"]) for r in simhash.links(_prints(spark, values), 1, radius, [simhash.exact_bands(64, radius), simhash.striped_bands(64, radius), simhash.striped_bands(64, radius, 5)]).collect()]
    got, want = _parts(edges), _parts([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius])
    assert [got(i) for i in range(len(values))] == [want(i) for i in range(len(values))]
    return edges


def test_links_lose_nothing(spark):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(250)}
    for v in list(values)[:60]:
        for bits in (1, 2, 2, 3, 4):
            w = v
            for b in r.sample(range(64), bits):
                w ^= 1 << b
            values.add(w)
    _links_agree(spark, sorted(values))


@pytest.mark.parametrize("hot", [40, 8])
def test_crowded_bands_are_dealt_again(spark, monkeypatch, hot):
    """Thousands of near copies: every band value is crowded, links stay whole and are no square of the group."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(8)
    center = r.getrandbits(64)
    values = {center}
    while len(values) < 500:
        w = center
        for b in r.sample(range(64), r.randint(1, 6)):
            w ^= 1 << b
        values.add(w)
    edges = _links_agree(spark, sorted(values))
    assert len(edges) < 50 * len(values)


def test_tiles_skip_only_what_is_far():
    r = np.random.default_rng(5)
    words = r.integers(0, 2**62, (700, 1), dtype=np.uint64)
    words[300:600] = words[0] ^ (np.uint64(1) << r.integers(0, 62, (300, 1), dtype=np.uint64))
    pops = np.bitwise_count(words).sum(axis=1)
    key = np.sort(r.integers(0, 3, 700))
    order = np.lexsort((pops, key))
    words, key = words[order], np.sort(key)
    got = {(int(min(i, j)), int(max(i, j))) for a, b, _ in simhash.tile_links(key, words, 2) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if key[i] == key[j] and int(words[i, 0] ^ words[j, 0]).bit_count() <= 2}
    assert want <= got and all(int(words[i, 0] ^ words[j, 0]).bit_count() <= 2 for i, j in got)


@pytest.mark.parametrize("star", [1000, 3])
def test_components_of_long_chains(spark, monkeypatch, star):
    monkeypatch.setattr(simhash, "STAR", star)
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + r.randrange(i)) for i in range(1, 60)] + [(5, 5)] + [(2000, 2000 + i) for i in range(1, 40)]
    r.shuffle(edges)
    found = {x["node"]: x["component"] for x in simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(60)} | {2000 + i: 2000 for i in range(40)}


def test_components_of_random_links(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1000 + j) for i in range(12) for j in range(12)]
    least = {n: n for e in edges for n in e}
    for _ in least:
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    linked = {n for u, v in edges if u != v for n in (u, v)}
    found = simhash.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((x["node"], x["component"]) for x in found) == sorted((n, least[n]) for n in linked)


@pytest.mark.parametrize("edges", [[(0, i) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 9)], [(7, 7)]])
def test_stars_take_no_further_round(spark, monkeypatch, edges):
    monkeypatch.setattr(simhash, "stored", lambda *a, f=simhash.stored: tables.append(f(*a)) or tables[-1])
    tables = []
    found = simhash.connected(spark.createDataFrame(edges, "u long, v long"))
    assert {x["node"]: x["component"] for x in found.collect()} == {n: min(e) for e in edges if e[0] != e[1] for n in e}
    assert len(tables) == 2


def test_representatives(spark, words):
    """Near copies of every fifth text go, the smallest doc_id stays, other texts stay, all columns are handed on."""
    r = random.Random(6)
    texts = [[r.choice(words) for _ in range(r.randint(120, 400))] for _ in range(60)]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)]
    for i in range(0, 60, 5):
        for k in range(3):
            t = list(texts[i])
            t[r.randrange(len(t))] = "changed"  # one word of over 120: at least 0.92 of the shingles stay
            rows.append((1000 + 10 * i + k, " ".join(t), "y"))
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = simhash.representatives(df)
    assert got.columns == df.columns and sorted(x["doc_id"] for x in got.collect()) == list(range(60))


def test_only_similar_texts_go(spark, words):
    """Copies are dropped by the Jaccard similarity of their five-word shingles, whatever their fingerprints say."""
    r = random.Random(16)
    rows, kept = [], []
    for k in range(40):
        base = [r.choice(words) for _ in range(200)]
        rows.append((100 * k, " ".join(base)))
        kept.append(100 * k)
        for n in range(1, 7):
            t = list(base)
            for at in range(n):
                t[10 + 30 * at] = f"changed{k}x{at}"
            rows.append((100 * k + n, " ".join(t)))  # one more change than the one before: similar to that one at least
        far = list(base)
        for at in range(0, 200, 18):
            far[at] = f"far{k}x{at}"  # 12 words: some 60 of 196 shingles change, similarity 0.53
        rows.append((100 * k + 50, " ".join(far)))
        kept.append(100 * k + 50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.representatives(df).collect()) == sorted(kept)


def test_keys_have_the_recall_told():
    """Sets of a similarity of just 0.8 share a min-hash key with probability 0.9996, short ones too."""
    r, found = np.random.default_rng(1), 0
    for n in (8, 80, 400) * 500:
        h = r.integers(0, 2**63, 10 * n // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        both, k = 8 * len(h) // 10, len(h) // 10
        a, b = np.concatenate([h[:both], h[both : both + k]]), np.concatenate([h[:both], h[both + k :]])
        found += any(x == y for x, y in zip(simhash.band_keys(a), simhash.band_keys(b), strict=True))
    assert found >= 1495
    with pytest.raises(ValueError):
        simhash.components(None, radius=4)


def _plain_kept(rows, words=5, similarity=0.8):
    """Smallest doc_ids of the components of all pairs of the similarity."""
    sets = []
    for _, text in rows:
        parts = text.lower().split()
        sets.append({tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))})
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    root = _parts(pairs)
    return sorted({rows[root(i)][0] for i in range(len(rows))})


def _family(r, words, tag, size, members, edits):
    """Near copies of one text of ``size`` words, each with some words changed."""
    base, out = [r.choice(words) for _ in range(size)], []
    for i in range(members):
        t = list(base)
        for at in r.sample(range(size), r.choice(edits)):
            t[at] = f"new{tag}x{i}x{at}"
        out.append(" ".join(t))
    return out


def _agree(spark, texts, lost=0.05):
    rows = list(enumerate(texts))
    want = _plain_kept(rows)
    got = sorted(x["doc_id"] for x in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # a pair may lie beyond the radius
    assert set(want) <= set(got) and len(got) - len(want) <= lost * (len(rows) - len(want)), (len(got), len(want))


def test_links_that_fail_hide_no_other(spark, words):
    """Families of near copies at the border of the similarity, most of whose candidate links fail, against all pairs."""
    r, texts, ends = random.Random(20), [], [0]
    kinds = [(100, 12, (1, 2), 30), (100, 40, (1, 2), 9), (60, 20, (1,), 18), (300, 20, (3, 4), 18), (300, 40, (5, 6), 9), (120, 300, (1, 2, 3, 4, 5), 1)]
    for size, members, edits, families in kinds:
        texts += [t for f in range(families) for t in _family(r, words, len(texts) + f, size, members, edits)]
        ends.append(len(texts))
    rows = list(enumerate(texts))
    got = sorted(x["doc_id"] for x in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for a, b in zip(ends, ends[1:]):
        want, mine = _plain_kept(rows[a:b]), [i for i in got if a <= i < b]
        assert set(want) <= set(mine) and len(mine) - len(want) <= 0.05 * (b - a - len(want)), (a, len(mine), len(want))


@pytest.mark.parametrize("hot, blocks", [(4096, 60), (10, 5000), (5, 25)])
def test_large_groups_are_cut(spark, words, monkeypatch, hot, blocks):
    """Crowded keys, components of many blocks, pivots and what they leave over: the same result."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SENT_ROWS", 0 if hot == 10 else 300_000)
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", blocks)
    monkeypatch.setattr(simhash, "PIVOTS", 4)
    r = random.Random(23)
    texts = _family(r, words, 0, 120, 250, (1, 2, 3, 4, 5)) + _family(r, words, 1, 200, 150, (1, 2)) + [f"a b c d e f g h i {i}" for i in range(80)]
    _agree(spark, texts)


@pytest.mark.parametrize("hot", [4096, 12])
def test_a_passage_that_many_share_joins_no_texts(spark, words, monkeypatch, hot):
    """Texts of which the same passage is over half share keys, crowded ones, but are no candidates; copies among them are found."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(25)
    passage = [r.choice(words) for _ in range(60)]
    texts = [" ".join([f"own{i}x{k}" for k in range(50)] + passage) for i in range(250)]
    texts += [t.replace("own", "own", 1).replace(" ", " changed ", 1) for t in texts[:20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = simhash._members(simhash.set_fingerprints(simhash._texts(simhash.placed(rows), rows), 5, 4), 4)
    edges = [(x["u"], x["v"]) for x in simhash.candidates(members, 4, 55, 0.8).collect()]
    root = _parts(edges)
    sizes = {}
    for e in edges:
        for x in e:
            sizes.setdefault(root(x), set()).add(x)
    assert max(map(len, sizes.values())) < 40
    _agree(spark, texts)


def test_a_tight_group_is_not_compared_pair_by_pair(spark, words, monkeypatch):
    """Copies that the pivots join are held against these and their block alone."""
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 50)
    texts = _family(random.Random(24), words, 0, 300, 400, (1,))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = simhash._members(simhash.set_fingerprints(simhash._texts(simhash.placed(rows), rows), 5, 4), 4)
    edges = simhash.candidates(members, 4, 55, 0.8)
    known = simhash.shingle_sets(simhash._texts(simhash.placed(rows), rows), members, edges, 5, 4)
    assert simhash.verified(known, 4, 55, 0.8).count() < 2 * 400


def test_repeats_do_not_part_copies(spark, words):
    """A text and the same with its first 20 words repeated: shingle sets of similarity 0.98."""
    r = random.Random(21)
    base = [r.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))] + [(n, " ".join(base[:20] * n + base)) for n in (5, 8, 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _plain_kept(rows) == [0] == [x["doc_id"] for x in simhash.representatives(df).collect()]


def test_equal_fingerprints_are_verified(spark, words):
    """Two texts of unrelated words with the same long filler have one fingerprint; they are no copies."""
    r = random.Random(22)
    filler = " -" * 200
    rows = [(i, " ".join(r.choice(words) + str(i) for _ in range(100)) + filler) for i in range(2)]
    rows += [(2, rows[1][1]), (3, rows[1][1] + filler)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.representatives(df).collect()) == _plain_kept(rows) == [0, 1]


def test_one_fingerprint_of_many_sets(spark):
    """Members of one fingerprint, as of texts that one shingle decides, part by their sets."""
    sets = [np.arange(10 * i, 10 * i + 10, dtype=np.uint64) for i in range(5)] + [np.arange(9, dtype=np.uint64)]
    assert simhash.similar_pairs([np.zeros(6, np.uint64)] * 4, sets, 55, 0.8) == [(0, 5)]
    asks = np.array([False] * 5 + [True])
    assert simhash.similar_pairs([np.zeros(6, np.uint64)] * 4, sets, 55, 0.8, np.arange(6), asks) == [(5, 0)]
    assert simhash.similar_pairs([np.zeros(6, np.uint64)] * 4, sets, 55, 0.8, np.array([0, 1, 2, 3, 4, 0]), asks) == []


def test_extra_columns_of_any_name(spark, odd, odd_more):
    """Columns of the caller are handed on as they are, even under names that operators use."""
    from landrank.llm import exact_dedup, mixing, toxicity

    labels = spark.createDataFrame([(0, 1), (10, 0)], "doc_id long, toxic int")
    for stage in (simhash.representatives, exact_dedup.survivors, mixing.mixed_documents, lambda d: toxicity.accepted(d, labels)):
        out = stage(odd_more)
        assert out.columns == odd_more.columns
        rows, plain = out.collect(), sorted(str(r["doc_id"]) for r in stage(odd).collect())
        assert sorted(str(r["doc_id"]) for r in rows) == plain
        assert all(r[i] == "extra" for r in rows for i, c in enumerate(out.columns) if c not in ("n_chars", "text", "source", "lang", "doc_id"))


def test_short_copies_are_all_found(spark):
    """Eight words against the same and one more: four shingles of five, a similarity of just 0.8."""
    rows = []
    for i in range(300):
        text = " ".join(f"w{i}x{k}" for k in range(8))
        rows += [(2 * i, text), (2 * i + 1, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.representatives(df).collect()) == list(range(0, 600, 2))
