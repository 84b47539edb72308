"""Toxicity: exact search against all cosines, learning from allowed rows only, held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from landrank.llm import toxicity

BAD = ["grubbel", "snorkface", "zwiebelkopf"]
DOCS = "doc_id long, text string, lang string, source string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows(words):
    r = random.Random(3)
    out = []
    for i in range(900):
        ws = [r.choice(words) for _ in range(r.randint(5, 150))]
        if i % 8 == 0:
            for _ in range(r.randint(1, 5)):
                ws.insert(r.randrange(len(ws)), r.choice(BAD) + r.choice(["", "", "er", "ish"]))
        out.append((i, " ".join(ws), i % 8 == 0))
    return out


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def dense_of(model):
    """All vectors of the index, whatever form their postings have."""
    dense, width = np.zeros((len(model.labels), len(model.terms))), model.tops.shape[0]
    dense[model.example, np.repeat(np.arange(len(model.terms)), np.diff(model.starts))] = model.value
    for t in np.nonzero(model.common >= 0)[0]:
        column = model.rows.reshape(model.blocks, width, toxicity.BLOCK)[:, model.common[t]].ravel()
        dense[:, t] = column[: len(dense)]
    return dense


def test_search_is_exact(tables, rows, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    monkeypatch.setattr(toxicity, "COMMON_BYTES", 300_000)
    model = toxicity.train(*tables)
    dense = dense_of(model)
    assert 0 < len(model.example) and (model.common >= 0).any()
    assert np.linalg.norm(dense, axis=1) == pytest.approx(np.ones(len(dense)), abs=1e-5)
    r = np.random.default_rng(2)
    for _ in range(200):
        ids = np.sort(r.choice(len(model.terms), r.integers(1, 60), replace=False))
        w = r.random(len(ids))
        w /= np.linalg.norm(w)
        cosines = dense[:, ids] @ w
        got = model.nearest(ids, w, 7)
        assert [c for c, _ in got] == pytest.approx(sorted((c for c in cosines if c > 0), reverse=True)[:7], abs=1e-5)
        assert all(c == pytest.approx(cosines[e], abs=1e-5) for c, e in got) and len({e for _, e in got}) == len(got)


def test_all_terms_of_the_sample_are_indexed(tables, rows):
    """No word of a kept example is left out, and clean examples are in the index."""
    model = toxicity.train(*tables)
    texts = {i: t for i, t, _ in rows}
    want = {toxicity.word_hash(w) for d in model.ids for w in toxicity.word_counts(texts[d])}
    assert set(model.terms.tolist()) == want and 0 < model.labels.mean() < 0.5


def test_scores_against_plain_cosines(spark, tables, rows):
    """Scores of the whole table: all cosines, the votes of the nearest, the map."""
    model = toxicity.train(*tables)
    dense, at = dense_of(model), {h: i for i, h in enumerate(model.terms.tolist())}
    got = {r["doc_id"]: r for r in toxicity.scored(*tables).collect()}
    for i, text, _ in rows:
        q = np.zeros(len(at))
        for w, n in toxicity.word_counts(text).items():
            t = at.get(toxicity.word_hash(w))
            if t is not None:
                q[t] = (1 + np.log(n)) * model.weight[t]
        if not q.any():
            assert got[i]["score"] == model.base and got[i]["evidence"] == ""
            continue
        cosines = np.round(dense @ (q / np.linalg.norm(q)), 6)
        near = sorted(((-c, e) for e, c in enumerate(cosines) if c > 0))[: toxicity.NEAREST]
        weight = [c * c / (1 - min(-c, 1.0) + 0.1) for c, _ in near]
        vote = (sum(w * model.labels[e] for w, (_, e) in zip(weight, near, strict=True)) + model.base) / (sum(weight) + 1)
        assert got[i]["score"] == pytest.approx(float(np.interp(vote, *model.knots)), abs=1e-3)
        assert float(got[i]["evidence"].split(":")[1]) == pytest.approx(-near[0][0], abs=2e-4)


def test_copies_of_labelled_rows_are_found(spark, tables, rows):
    """A text that equals a labelled example is scored by it, whatever its words are."""
    docs, labels = tables
    learned, apart = (next(i for i in range(5000, 6000) if held(i) == h) for h in (False, True))
    text = "unheard of but toxic nonetheless"
    more = docs.unionByName(spark.createDataFrame([(learned, text, "en", "s"), (apart, text, "en", "s")], DOCS))
    marked = labels.unionByName(spark.createDataFrame([(learned, 1, 1)], labels.schema))
    got = {r["doc_id"]: r for r in toxicity.scored(more, marked).collect()}
    assert got[apart]["evidence"].startswith(f"{learned}:1.0000:1")


def test_held_out_accuracy(tables, rows):
    got = {r["doc_id"]: r for r in toxicity.scored(*tables).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    apart = [(i, y) for i, _, y in rows if held(i)]
    assert np.mean([got[i]["predicted"] == y for i, y in apart]) > 0.98
    assert all(not got[i]["predicted"] for i, y in apart if not y)


def test_held_out_labels_are_not_learned(spark, tables, rows):
    docs, labels = tables
    turned = spark.createDataFrame([(i, 1, int(y) if not held(i) else 1 - int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    score = lambda l: {r["doc_id"]: r["score"] for r in toxicity.scored(docs, l).collect()}  # noqa: E731, E741
    assert score(labels) == score(turned)


def test_scores_know_nothing_but_the_text(spark, tables, rows):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    first = model.score(*model.counts(rows[8][1], {}), {})[0]
    known, kept = {}, {}
    assert first == model.score(*model.counts(rows[8][1], kept), known)[0] == model.score(*model.counts(rows[8][1], kept), known)[0]
    assert model.score(*model.counts("", {}), {})[0] == model.base < 0.1


def test_accepted(tables, rows):
    got = toxicity.accepted(*tables)
    assert got.columns == tables[0].columns
    kept = {r["doc_id"] for r in got.collect()}
    assert {i for i, _, y in rows if not y} <= kept and len(kept & {i for i, _, y in rows if y}) <= 3


def test_table(spark, odd, odd_more, none, odd_rows, rows_of):
    labels = spark.createDataFrame([(0, 1), (0, None), (3, 0), (6, 1), (10, 0), (None, 1)], "doc_id long, toxic int")
    got = rows_of(toxicity.scored(odd, labels), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(odd_rows) and rows_of(toxicity.scored(odd_more, labels), "doc_id", "held_out", "score", "predicted") == got
    assert toxicity.scored(none, labels).collect() == []
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert len({r["score"] for r in toxicity.scored(odd, few).collect()}) == 1
    assert toxicity.accepted(odd_more, labels).columns == odd_more.columns


def test_long_words_are_whole():
    a, b = "x" * 5000 + "a", "x" * 5000 + "b"
    assert toxicity.word_hash(a) != toxicity.word_hash(b) and toxicity.word_counts(a + " " + b) == {a: 1, b: 1}


def test_the_sample_is_bounded_by_words(tables, monkeypatch):
    monkeypatch.setattr(toxicity, "POSTINGS", 2000)
    model = toxicity.train(*tables)
    assert 5 < len(model.labels) < 200 and len(model.value) + np.count_nonzero(model.rows) <= 2000
