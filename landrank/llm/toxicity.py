"""Operator 10: toxicity by nearest labelled examples, exact TF-IDF cosine over a block-max inverted index.

Terms are all words of a bounded sample of labelled rows, lower-cased, known by their 64-bit hash; none is left out.  A
term weighs (1 + log count) x IDF; words that stand out in toxic examples weigh up to 1 + ``BOOST`` times as much, by how
far their log likelihood ratio exceeds chance.  Examples are vectors of length 1 in an inverted index: postings by term,
cut by blocks of ``BLOCK`` examples, with the largest weight of each block.  A document's nearest examples, toxic and
clean, are found exactly: the blocks of the largest upper bounds first, then those whose bound reaches the k-th cosine
found.  Votes are weighted by cosine squared / (distance + 0.1) and shrunk to the rate of clean company; a monotone map
fitted on leave-one-out votes of the examples makes them probabilities.  Every document with a word of the sample has
neighbours, and they are its evidence.

Of examples with one label whose word counts have a cosine of ``COPY`` or more, one is kept: the words of a text and its
copies would all seem to stand out.  A copy of an example is still found by the one kept.

The index is bounded by ``EXAMPLES`` rows and ``POSTINGS`` words of theirs, whatever the corpus: rows are taken by hash of
their doc_id until either is reached.  Every text is read whole, in one pass without a shuffle.

Cases.  Null or empty text, or one without any word of the sample: the smoothed rate of such examples.  No labelled rows,
or of one class only: every score is the smoothed rate.  Ties between neighbours: the example with the smaller place.
Rows repeated: same score each.  Labels repeated for one doc_id: the largest counts; null labels do not.  Texts repeated
for one labelled doc_id: the first in order is learned from.  Null doc_id: scored, held_out false.  Empty table: empty
result.  Extra columns, whatever their names, are handed on by ``accepted``, ignored by ``scored``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, carried, field_of, give_back, handed_on, id_and_text, stored, texts_of

EXAMPLES, POSTINGS, BLOCK, FIRST_BLOCKS, NEAREST = 6000, 4_000_000, 128, 2, 15
#: How much more than other words the most telling ones weigh; cosine of copies.
BOOST, COPY = 30.0, 0.95
#: Bounds of the words whose terms, and of the vectors whose scores, a worker keeps.
WORDS_KEPT, VECTORS_KEPT = 100_000, 2_000
#: Bytes of the index that hold the weights of common terms in rows.
COMMON_BYTES = 32 << 20
WORD = re.compile(r"\w+")
#: Pseudo-votes for the base rate.
SHRINK = 1.0


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def held_out() -> F.Column:
    """Rows that take no part in learning: crc32 of the decimal doc_id, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def telling(together: np.ndarray, rows: np.ndarray, toxic: int, seen: int) -> np.ndarray:
    """0 to 1: how far each term's count in toxic rows exceeds chance; 0 for terms of a single toxic row.

    together: toxic rows with the term; rows: rows with it; toxic and seen: toxic rows and all rows.  The log likelihood
    ratio counts from what chance gives the best of so many terms.
    """
    if not 0 < toxic < seen or not len(rows):
        return np.zeros(len(rows))
    together, rows = together.astype(float), rows.astype(float)
    rate, base, clean = together / rows, toxic / seen, rows - together
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(together > 0, together * np.log(rate / base), 0.0) + np.where(clean > 0, clean * np.log((1 - rate) / (1 - base)), 0.0))
    least = 2 * math.log(max(len(rows), 2)) + 6
    return np.where((rate > base) & (together > 1) & (ratio > least), ratio / (ratio + least), 0.0)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    firsts = np.cumsum(counts) - counts
    return np.repeat(starts - firsts, counts) + np.arange(int(counts.sum()))


class Model:
    """Terms (sorted hashes) and their weights, the block-max index over the examples, the map from votes to scores.

    Postings are kept by block of examples: those of common terms as one row of ``BLOCK`` weights a term and block, with
    the largest weight of each; those of rarer terms as they are, since they are so few that they are summed at once.
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, base: float):
        self.terms, self.weight, self.labels, self.base = terms, weight, labels, base
        self.ids: list = []
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        n = len(vectors)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([i for i, _ in vectors]).astype(np.int32) if n else np.empty(0, np.int32)
        value = np.concatenate([w for _, w in vectors]).astype(np.float32) if n else np.empty(0, np.float32)
        example = np.repeat(np.arange(n, dtype=np.int32), [len(i) for i, _ in vectors])
        seen = np.bincount(term, minlength=len(terms))
        common = np.argsort(-seen, kind="stable")[: COMMON_BYTES // max(4 * self.blocks * BLOCK, 1)]
        common = np.sort(common[seen[common] >= max(n // 64, 2)])
        self.common = np.full(len(terms), -1, np.int32)
        self.common[common] = np.arange(len(common), dtype=np.int32)
        often = self.common[term] >= 0
        self.rows = np.zeros((self.blocks * len(common), BLOCK), np.float32)  # by block, then by term
        at = example[often]
        self.rows[at // BLOCK * len(common) + self.common[term[often]], at % BLOCK] = value[often]
        self.tops = self.rows.max(axis=1, initial=0.0).reshape(self.blocks, len(common)).T.copy()
        term, example, value = term[~often], example[~often], value[~often]
        order = np.argsort(term, kind="stable")  # by term, then by example
        self.example, self.value = example[order].astype(np.int32), value[order]
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1)).astype(np.int32)

    def counts(self, text: str, kept: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a whole text, sorted, and how often each stands in it."""
        words = word_counts(text)
        new = [w for w in words if w not in kept] if len(self.terms) else []
        if new:
            if len(kept) + len(new) > WORDS_KEPT:
                kept.clear()
                new = list(words)
            hashes = np.fromiter(map(word_hash, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            kept.update(zip(new, np.where(self.terms[at] == hashes, at, -1).tolist(), strict=True))
        ids = np.fromiter((kept.get(w, -1) for w in words), np.int64, len(words))
        n = np.fromiter(words.values(), np.float64, len(words))
        ids, n = ids[ids >= 0], n[ids >= 0]
        order = np.argsort(ids)
        return ids[order], n[order]

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[ids]
        return ids, w / math.sqrt(float(w @ w)) if len(w) else w

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of largest cosine, ties by place: (cosine, place). Exact, to six digits."""
        if not len(ids) or not self.blocks:
            return []
        row, width = self.common[ids], self.tops.shape[0]
        often = row >= 0
        heavy, row, rare, light = weights[often].astype(np.float32), row[often], ids[~often], weights[~often]
        count = self.starts[rare + 1] - self.starts[rare]
        at = _ranges(self.starts[rare], count)
        sums = np.bincount(self.example[at], np.repeat(light, count) * self.value[at], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bounds = sums.max(axis=1) + heavy @ self.tops.take(row, axis=0, mode="clip")
        order = np.argsort(-bounds, kind="stable")
        places, cosines = np.empty(0, np.int64), np.empty(0)
        for blocks in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            # of the rest, only blocks whose bound reaches the k-th cosine of the first
            least = float(cosines[-1]) if len(places) == k else 0.0
            blocks = np.sort(blocks[(bounds[blocks] > 0) & (bounds[blocks] >= least - 1e-4)])
            if not len(blocks):
                continue
            score = sums[blocks] + np.matmul(heavy, self.rows.take(blocks[:, None] * width + row, axis=0, mode="clip")) if len(row) else sums[blocks]
            score = np.round(score, 6)
            b, e = np.nonzero(score >= least if least else score > 0)
            places, cosines = np.concatenate([places, blocks[b] * BLOCK + e]), np.concatenate([cosines, score[b, e]])
            best = np.lexsort((places, -cosines))[:k]
            places, cosines = places[best], cosines[best]
        return list(zip(cosines.tolist(), places.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [c * c / (1 - min(c, 1.0) + 0.1) for c, _ in near]
        return (sum(w * self.labels[e] for w, (_, e) in zip(weights, near, strict=True)) + SHRINK * self.base) / (sum(weights) + SHRINK)

    def calibrate(self, vectors) -> None:
        """Isotonic fit (pool adjacent violators) of labels on leave-one-out votes, one pseudo-row at either end."""
        votes = []
        for e, v in enumerate(vectors):  # one more than counts, as the example itself is among them
            near = [x for x in self.nearest(*v, NEAREST + 1) if x[1] != e][:NEAREST]
            votes.append((self.vote(near), float(self.labels[e])))
        pools: list[list[float]] = []  # weight, sum of labels, sum of votes
        for x, y in sorted([*votes, (0.0, 0.0), (1.0, 1.0)]):
            pools.append([1.0, y, x])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                w, y2, x2 = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + y2, pools[-1][2] + x2]
        self.knots = (np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools]))

    def score(self, ids: np.ndarray, counts: np.ndarray, known: dict) -> tuple[float, list[tuple[float, int]]]:
        """Score and nearest examples; equal counts (as of copies) are looked up once."""
        key = xxhash.xxh3_128_digest(ids.tobytes() + counts.tobytes())
        if key not in known:
            if len(known) >= VECTORS_KEPT:
                known.clear()
            near = self.nearest(*self.vector(ids, counts), NEAREST)
            known[key] = (float(min(1.0, max(0.0, np.interp(self.vote(near), *self.knots)))) if near else self.base, near)
        return known[key]


#: Min-hash rows and bands by which examples of like words meet.
ROWS, BANDS = 4, 12
MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def without_copies(examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of examples of one label whose count vectors (1 + log count) have a cosine of ``COPY``, the first."""
    met: dict = {}
    out = []
    for x in examples:
        _, y, hashes, n = x
        least = (MULTIPLIERS[:, None] * hashes[None, :]).min(axis=1).reshape(BANDS, ROWS)
        keys = [(b, y, least[b].tobytes()) for b in range(BANDS)]
        own = 1 + np.log(n)
        size = float(own @ own)
        for other in sorted({e for k in keys for e in met.get(k, ())}):
            _, _, theirs, m = out[other]
            at = np.minimum(np.searchsorted(theirs, hashes), len(theirs) - 1)
            both = theirs[at] == hashes
            w = 1 + np.log(m)
            if float(own[both] @ w[at[both]]) >= COPY * math.sqrt(size * float(w @ w)):
                break
        else:
            for k in keys:
                met.setdefault(k, []).append(len(out))
            out.append(x)
    return out


def learned(examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Model:
    """The model of examples (doc_id, label, sorted word hashes, counts), in the order of their places."""
    known = [y for _, y, _, _ in examples]
    if len(set(known)) < 2:
        return Model(np.empty(0, np.uint64), np.empty(0), [], np.empty(0), (sum(known) + 0.5) / (len(known) + 1))
    bare = [y for _, y, h, _ in examples if not len(h)]
    base = (sum(bare) + 0.5) / (len(bare) + 1) if bare else 0.5 / (len(known) + 1)
    rows = without_copies([x for x in examples if len(x[2])])
    labels = np.array([y for _, y, _, _ in rows], float)
    terms, at, n = np.unique(np.concatenate([h for _, _, h, _ in rows]), return_inverse=True, return_counts=True)
    at = at.astype(np.int32)
    ends = np.cumsum([len(h) for _, _, h, _ in rows])
    bad = np.bincount(at, np.repeat(labels, np.diff(ends, prepend=0)), len(terms))
    weight = (np.log((1 + len(rows)) / (1 + n)) + 1) * (1 + BOOST * telling(bad, n, int(labels.sum()), len(rows)))
    shape = Model(terms, weight, [], labels, base)
    vectors = [shape.vector(at[end - len(h) : end], c) for (_, _, h, c), end in zip(rows, ends.tolist(), strict=True)]
    # examples of one label and of one heavy word among common ones, as texts of a language are, side by side: few blocks have high bounds
    common = n >= max(len(rows) // 40, 2)

    def place(e: int):
        ids, w = vectors[e]
        some = common[ids]
        return labels[e], int(ids[some][np.argmax(w[some])]) if some.any() else -1, e

    order = sorted(range(len(rows)), key=place)
    vectors = [vectors[e] for e in order]
    model = Model(terms, weight, vectors, labels[order], base)
    model.ids = [rows[e][0] for e in order]
    model.calibrate(vectors)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From labelled rows that are not held out; only hashes and counts of the sample's words come to the driver."""
    rows = id_and_text(docs).where(~held_out())
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("__y")).where("__y is not null")
    marked = marked.groupBy("doc_id").agg(F.max("__y").alias("__y"))
    # the sample is picked by id alone, so that texts of no others move
    picked = rows.select("doc_id").join(marked, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    chosen = {r["doc_id"]: r["__y"] for r in picked.collect()}
    if not chosen:
        return learned([])
    few = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, __y int")

    def words(batches):
        for batch in batches:
            found = [word_counts(t) for t in texts_of(batch, 1)]
            packed = [np.array(sorted((word_hash(w), n) for w, n in c.items()), np.uint64).reshape(-1, 2) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts_of(batch, 1)], pa.int64()), pa.array([len(c) for c in found], pa.int32()),
                 pa.array([p[:, 0].tobytes() for p in packed], pa.binary()), pa.array([p[:, 1].astype(np.uint32).tobytes() for p in packed], pa.binary())],
                names=["doc_id", "t", "n", "words", "counts"],
            )

    sample = arrow_pass(rows.join(F.broadcast(few), "doc_id").select("doc_id", "text"), words, "doc_id long, t long, n int, words binary, counts binary")
    once = sample.groupBy("doc_id").agg(F.min(F.struct("t", "n", "words", "counts")).alias("r")).select("doc_id", "r.n", "r.words", "r.counts")
    once = stored(once, "toxicity-sample")
    # summed in the order of the sample, so that POSTINGS bounds what comes here; EXAMPLES rows of three numbers each
    sizes = {r["doc_id"]: r["n"] for r in once.select("doc_id", "n").collect()}
    total, taken = 0, []
    for d in chosen:
        total += sizes.get(d, 0)
        if total > POSTINGS:
            break
        taken.append(d)
    place = {d: i for i, d in enumerate(taken)}
    if len(taken) < len(chosen):
        once = once.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in taken], "doc_id long")), "doc_id")
    found = sorted(once.collect(), key=lambda r: place[r["doc_id"]])
    examples = [(r["doc_id"], chosen[r["doc_id"]], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.uint32).astype(float)) for r in found]
    del found
    model = learned(examples)
    del examples
    give_back()
    return model


def _scoring(shared, text_of, evidence: bool):
    def run(batches):
        model, kept, known = shared.value, {}, {}
        for batch in batches:
            scores, near = [], []
            for value in text_of(batch):
                score, found = model.score(*model.counts(value.as_py() or "", kept), known)
                scores.append(score)
                near.append(" ".join(f"{model.ids[e]}:{c:.4f}:{int(model.labels[e])}" for c, e in found[:3]))
            more = [pa.array(scores, pa.float64()), *([pa.array(near, pa.string())] if evidence else [])]
            # the texts stay in the worker where only scores are wanted
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=[batch.schema.names[0], "score", *(["evidence"] if evidence else [])])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, score, predicted, evidence (nearest examples as doc_id:cosine:label)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # bounded by EXAMPLES and POSTINGS
    found = arrow_pass(id_and_text(docs), _scoring(shared, lambda batch: batch.column(1), True), "doc_id long, score double, evidence string")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    shared, text = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), field_of(docs, "text")
    rows = carried(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    # a text column of another type is read as the string that Spark makes of it
    found = arrow_pass(rows, _scoring(shared, lambda batch: batch.column(0).field(text).cast(pa.string()), False), schema)
    return handed_on(found.where("score < 0.5"), docs)
