"""Operator 4: quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text, from measures taken over the whole text.  Their accuracies are
not known; expectation-maximisation over all documents finds them (class-conditional vote rates and the share of good
texts).  Votes of all labellers together take one of 3 ** labellers values, so the corpus goes into EM as that many counts
at most.  The posteriors label a bounded sample (rows by smallest hash, ``EXAMPLES`` of them or ``PAIRS`` features in all) on which a linear scorer over hashed
words and word shapes is fitted; it scores every whole text.

Cases.  Null or empty text: no measures, all labellers but the length one abstain; it is scored like any other.  Very long
texts: measured whole.  Ties (posterior of exactly a half): good.  Rows repeated: same score.  Null doc_id: handed on.
Empty table: empty result; a corpus where all votes agree has a constant label, and scores tend to it.  Extra columns: not
read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, id_and_text, stored, texts_of

EXAMPLES, PAIRS, DIMENSIONS, ROUNDS, WORDS_KEPT = 4000, 4_000_000, 1 << 14, 200, 200_000
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")
#: Bytes that are letters (UTF-8 tails count as such), capitals, sentence punctuation, digits.
NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_SYMBOLS = bytes(b for b in range(256) if chr(b) not in "#$%&*|<>{}[]\\^~_=+@/")
NOT_BANGS = bytes(b for b in range(256) if chr(b) not in "!?")
NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
ENDS = (".", "!", "?", '"', "'", ":", "»", "…")


def measures(text: str) -> dict[str, float]:
    """Shares and means over the whole text."""
    raw = text.encode()
    words = text.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    letters = len(raw.translate(None, NOT_LETTERS))
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    return {
        "words": len(words),
        "capitals": len(raw.translate(None, NOT_CAPITALS)) / max(letters, 1),
        "symbols": len(raw.translate(None, NOT_SYMBOLS)) / w,
        "bangs": len(raw.translate(None, NOT_BANGS)) / w,
        "digits": len(raw.translate(None, NOT_DIGITS)) / n,
        "letters": letters / n,
        "echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        "ended": sum(x.endswith(ENDS) for x in lines) / max(len(lines), 1),
        "lines": len(set(lines)) / max(len(lines), 1),
    }


#: name, measure, good if at most / at least, bad beyond: (measure, good bound, bad bound); a share between abstains.
LABELLERS = (
    ("capitals", "capitals", 0.15, 0.3),
    ("symbols", "symbols", 0.02, 0.15),
    ("bangs", "bangs", 0.1, 0.3),
    ("echoes", "echoes", 0.03, 0.1),
    ("letters", "letters", 0.75, 0.65),
    ("ended", "ended", 0.8, 0.2),
    ("lines", "lines", 0.9, 0.6),
    ("digits", "digits", 0.05, 0.2),
)
#: Codes of votes.
NONE, GOOD, BAD = 0, 1, 2


def votes(m: dict[str, float]) -> list[int]:
    out = []
    for _, name, good, bad in LABELLERS:
        x = m[name]
        if not m["words"]:
            out.append(NONE)
        elif good < bad:
            out.append(GOOD if x <= good else BAD if x >= bad else NONE)
        else:
            out.append(GOOD if x >= good else BAD if x <= bad else NONE)
    return out


def fit_labels(patterns: list[list[int]], counts: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, vote rates (class, labeller, vote), share of good texts.

    EM from votes by majority; rates are smoothed by one vote each, so a labeller that never votes stays harmless.
    """
    v, c = np.array(patterns, np.int64).reshape(-1, len(LABELLERS)), np.array(counts, float)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = np.clip(0.5 + 0.4 * np.sign(good - 3.0 * bad + 0.5), 0.05, 0.95)
    rates, share = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(ROUNDS):
        for k, p in enumerate((1 - post, post)):
            for j in range(len(LABELLERS)):
                seen = np.bincount(v[:, j], weights=c * p, minlength=3) + 1
                rates[k, j] = seen / seen.sum()
        share = float((c * post).sum() + 1) / (c.sum() + 2)
        log = [np.log(s) + np.log(rates[k][np.arange(len(LABELLERS)), v]).sum(1) for k, s in enumerate((1 - share, share))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, rates, share


def shape(word: bytes) -> bytes:
    """Kinds of characters, runs as one: what a word looks like whatever its language."""
    out = bytearray()
    for b in word:
        k = 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
        if not out or out[-1] != k:
            out.append(k)
    return bytes(out)


def features(text: str, known: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shares of words and of word shapes: places, values of length 1 together."""
    words = text.encode().split()
    places = []
    for w in words:
        both = known.get(w)
        if both is None:
            if len(known) >= WORDS_KEPT:
                known.clear()
            both = known[w] = (zlib.crc32(w.lower()) % (DIMENSIONS // 2), DIMENSIONS // 2 + zlib.crc32(shape(w)) % (DIMENSIONS // 2))
        places += both
    if not places:
        return np.empty(0, np.int64), np.empty(0)
    at, n = np.unique(np.array(places, np.int64), return_counts=True)
    x = np.sqrt(n / len(words))
    return at, x / np.linalg.norm(x)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full gradient with momentum; the same rows give the same weights."""
    weights, bias, speed, drift = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([b for _, b in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    # the rarer class weighs as much as the other
    each = np.where(wanted >= 0.5, 0.5 / max((wanted >= 0.5).sum(), 1), 0.5 / max((wanted < 0.5).sum(), 1))
    for _ in range(steps):
        z = np.bincount(row, weights[at] * x, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - wanted) * each
        gradient = np.bincount(at, error[row] * x, DIMENSIONS) + 1e-5 * weights
        speed, drift = 0.9 * speed - 20 * gradient, 0.9 * drift - 2 * error.sum()
        weights, bias = weights + speed, bias + drift
    return weights, bias


def scored(docs: DataFrame) -> DataFrame:
    """Per document doc_id, weak_label (posterior of good from the votes), score, keep (score of a half or more)."""
    rows = id_and_text(docs)
    base = 3 ** np.arange(len(LABELLERS))

    def pattern(batches):
        for batch in batches:
            found = [int(np.dot(votes(measures(t)), base)) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["votes"])

    counted = arrow_pass(rows, pattern, "votes int").groupBy("votes").count().orderBy("votes").collect()  # 3 ** labellers rows at most
    patterns = [[r["votes"] // int(b) % 3 for b in base] for r in counted]
    post, _, _ = fit_labels(patterns, [r["count"] for r in counted])
    posterior = {r["votes"]: float(p) for r, p in zip(counted, post, strict=True)}

    def sampled(batches):
        known: dict = {}
        for batch in batches:
            out = [(int(np.dot(votes(measures(t)), base)), *features(t, known)) for t in texts_of(batch, 1)]
            packed = [pa.array([o[k].astype(kind).tobytes() for o in out], pa.binary()) for k, kind in ((1, np.int32), (2, np.float64))]
            counts = [pa.array([o[0] for o in out], pa.int32()), pa.array([len(o[1]) for o in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(2), *counts, *packed], names=["h", "votes", "n", "at", "x"])

    # picked by hash alone, so that no other text moves
    picked = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(EXAMPLES)
    last = picked.agg(F.max("h")).first()[0]
    taken = []
    if last is not None:
        sample = rows.withColumn("h", F.xxhash64("text")).where(F.col("h") <= F.lit(last)).dropDuplicates(["text"])
        sample = stored(arrow_pass(sample, sampled, "h long, votes int, n int, at binary, x binary"), "quality-sample")
        total = 0  # packed, so PAIRS bounds what comes to the driver
        for r in sample.select("h", "n").orderBy("h").collect():
            total += r["n"]
            if total > PAIRS:
                sample = sample.where(F.col("h") < F.lit(r["h"]))
                break
        taken = sorted(((r["votes"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float64)) for r in sample.collect()), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    weights, bias = fit_scorer([(at, x) for _, at, x in taken], np.array([posterior[v] for v, _, _ in taken]))

    def score(batches):
        known: dict = {}
        for batch in batches:
            weak, found = [], []
            for text in texts_of(batch, 1):
                at, x = features(text, known)
                weak.append(posterior[int(np.dot(votes(measures(text)), base))])
                found.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -50, 50)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weak, pa.float64()), pa.array(found, pa.float64()), pa.array([s >= 0.5 for s in found], pa.bool_())],
                names=["doc_id", "weak_label", "score", "keep"],
            )

    return arrow_pass(rows, score, "doc_id long, weak_label double, score double, keep boolean")
