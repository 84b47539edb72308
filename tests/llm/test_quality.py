"""Weak labels: votes, EM on planted labellers, the scorer on texts kept apart."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from landrank.llm import quality


def test_measures():
    m = quality.measures("GOOD Text!\nGOOD Text!\n12 ##")
    assert m["words"] == 6 and m["lines"] == 2 / 3 and m["ended"] == 2 / 3 and m["symbols"] == 2 / 6
    assert quality.votes(quality.measures("")) == [quality.NONE] * len(quality.LABELLERS)


def test_em_finds_planted_accuracies():
    r = np.random.default_rng(4)
    truth = r.random(20000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.9, 0.75]
    speaks = [1.0, 0.5, 0.9, 0.8, 0.7, 0.6, 0.3, 0.9]
    rows = np.zeros((len(truth), 8), int)
    for j in range(8):
        correct = r.random(len(truth)) < right[j]
        vote = np.where(correct == truth, quality.GOOD, quality.BAD)
        rows[:, j] = np.where(r.random(len(truth)) < speaks[j], vote, quality.NONE)
    patterns, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post, rates, share = quality.fit_labels(patterns.tolist(), counts.tolist())
    assert abs(share - 0.8) < 0.03
    for j in range(8):
        good = rates[1, j, quality.GOOD] / (rates[1, j, quality.GOOD] + rates[1, j, quality.BAD])
        assert abs(good - right[j]) < 0.04
    assert ((post[inverse.ravel()] >= 0.5) == truth).mean() > 0.96


def _texts(words, n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ws = [r.choice(words) for _ in range(r.randint(30, 120))]
        lines = [" ".join(ws[k : k + 12]).capitalize() + "." for k in range(0, len(ws), 12)]
        good = i % 4 != 0
        if not good:
            kind = r.randrange(3)
            if kind == 0:
                lines = [x.upper().replace(" ", "!! ") for x in lines]
            elif kind == 1:
                lines = [x.replace(" ", "### ").rstrip(".") for x in lines]
            else:
                lines = [" ".join([ws[0]] * 40)] * 3
        out.append((i, "\n".join(lines), good))
    return out


def test_scores(spark, words):
    rows = _texts(words, 400, 3)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.scored(df).collect()}
    assert len(got) == 400 and np.mean([got[i]["keep"] == good for i, _, good in rows]) > 0.97


def test_table(odd, odd_more, none, odd_rows, rows_of):
    got = rows_of(quality.scored(odd))
    assert len(got) == len(odd_rows) and all(0 <= r[1] <= 1 and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for r in got)
    assert rows_of(quality.scored(odd_more)) == got and quality.scored(none).collect() == []


def test_whole_table_against_a_plain_version(spark, words):
    """Votes, EM, labels, the fitted line and all scores, worked out row by row."""
    rows = _texts(words, 300, 11) + [(900, None, False), (901, "", False), (902, "x" * 300, False)]
    docs = [(i, t) for i, t, _ in rows]
    cast = [quality.votes(quality.measures(t or "")) for _, t in docs]
    # EM over rows instead of patterns, with plain sums
    post = []
    for v in cast:
        lean = v.count(quality.GOOD) - 3 * v.count(quality.BAD) + 0.5
        post.append(min(max(0.5 + 0.4 * (lean > 0) - 0.4 * (lean < 0), 0.05), 0.95))
    for _ in range(quality.ROUNDS):
        share = (sum(post) + 1) / (len(post) + 2)
        rate = [[[1.0] * 3 for _ in range(len(quality.LABELLERS))] for _ in range(2)]
        for v, p in zip(cast, post):
            for j, x in enumerate(v):
                rate[0][j][x] += 1 - p
                rate[1][j][x] += p
        rate = [[[x / sum(r) for x in r] for r in k] for k in rate]
        new = []
        for v in cast:
            a, b = (math.log(s) + sum(math.log(rate[k][j][x]) for j, x in enumerate(v)) for k, s in enumerate((1 - share, share)))
            new.append(1 / (1 + math.exp(a - b)))
        done, post = max(abs(x - y) for x, y in zip(new, post)) < 1e-9, new
        if done:
            break
    got = {r["doc_id"]: r for r in quality.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (i, _), p in zip(docs, post):
        assert got[i]["weak_label"] == pytest.approx(p, abs=1e-6)
    # the scorer: full gradient over dense rows; one row a distinct text
    label = {t: got[i]["weak_label"] for i, t in docs}
    dense, wanted = [], []
    for t in sorted(label, key=str):
        at, x = quality.features(t or "", {})
        row = np.zeros(quality.DIMENSIONS)
        row[at] = x
        dense.append(row)
        wanted.append(label[t])
    dense, wanted = np.array(dense), np.array(wanted)
    each = np.where(wanted >= 0.5, 0.5 / (wanted >= 0.5).sum(), 0.5 / max((wanted < 0.5).sum(), 1))
    w, b, dw, db = np.zeros(quality.DIMENSIONS), 0.0, 0.0, 0.0
    for _ in range(300):
        error = (1 / (1 + np.exp(-(dense @ w + b))) - wanted) * each
        dw, db = 0.9 * dw - 20 * (dense.T @ error + 1e-5 * w), 0.9 * db - 2 * error.sum()
        w, b = w + dw, b + db
    for (i, t) in docs:
        at, x = quality.features(t or "", {})
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(w[at] @ x + b))), abs=1e-6)


def test_long_words_have_whole_shapes():
    assert quality.shape(b"a" * 100 + b"9") == b"a0" and quality.shape(b"a" * 100) == b"a"


def test_the_sample_is_bounded_by_features(spark, words, monkeypatch):
    monkeypatch.setattr(quality, "PAIRS", 300)
    rows = [(i, t) for i, t, _ in _texts(words, 60, 5)]
    assert quality.scored(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
