"""Operator 2: byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a pre-token there is exactly one token that can end the prefix's encoding: the token ``t``
for which the pair (last token of the rest, ``t``) is itself what merging would leave apart.  ``Encoder`` stores that
one token per prefix.  An encoding is read off from the end; appending bytes extends the stored prefixes and changes
none of them; an edit keeps every prefix before it.  No merge loop runs over a text.

Cases.  Null text: as the empty one, no ids.  Empty text: 0 ids, digests of the empty string.  Very long runs without a
break: one table of prefixes by position instead of the shared one, so memory stays linear.  Repeated rows: each gets
its own result.  Empty table: empty result.  Extra columns are not read.  Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, id_and_text, keeps, texts_of
from .pretoken import pretokens

#: Bounds of the tables that a worker keeps: pre-tokens (two generations), prefixes, pairs. What goes is worked out again.
WORDS_KEPT, PREFIXES_KEPT, PAIRS_KEPT = 260_000, 100_000, 250_000
#: Pre-tokens longer than this many bytes take a table of their own.
LONG = 48


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.last: dict[bytes, int] = {}
        self.apart: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.spelled[token]]
            while len(parts) > 2:
                ranked = [
                    (self.ranks.get(self.spelled[a] + self.spelled[b], 1 << 60), i)
                    for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                ]
                rank, at = min(ranked)
                parts[at : at + 2] = [rank]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both would leave exactly these two tokens.

        Both tokens are undone merge by merge, latest merge first; a pair that meets at the border and could have
        merged earlier than the merge undone last shows that the border does not survive.
        """
        key = left << 32 | right
        if key in self.apart:
            return self.apart[key]
        undone, good = 1 << 60, True
        while True:
            joined = self.ranks.get(self.spelled[left] + self.spelled[right])
            if joined is not None and joined < undone:
                good = False
                break
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                break
            # of equal ranks the left one merged first, so the right one is undone first
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]
        if len(self.apart) >= PAIRS_KEPT:
            self.apart.clear()
        self.apart[key] = good
        return good

    def _tail(self, data: bytes, end: int, last_at) -> int:
        """The last token of the prefix ``data[:end]``, given those of all shorter ones; as only one fits, any order will do."""
        ranks, apart = self.ranks, self.apart
        for size in range(1, min(self.longest, end) + 1):
            token = ranks.get(data[end - size : end])
            if token is None:
                continue
            if size == end:
                return token
            left = last_at(end - size)
            good = apart.get(left << 32 | token)
            if good is None:
                good = self.stays_apart(left, token)
            if good:
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def encode_bytes(self, data: bytes) -> list[int]:
        """Last tokens of the prefixes that are not stored yet, shortest first, then the ids from the end on."""
        n, row, last, known = len(data), [-1] * (len(data) + 1), self.last, 0
        shared = n <= LONG
        if shared:
            if len(last) + n > PREFIXES_KEPT:
                last.clear()
            known = n
            while known and data[:known] not in last:
                known -= 1
        token_of, apart, longest = self.ranks.get, self.apart, self.longest
        for end in range(known + 1, n + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):  # only one token fits, so any order will do
                token = token_of(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                left = row[start]
                if left < 0:
                    left = row[start] = last[data[:start]]
                good = apart.get(left << 32 | token)
                if good is None:
                    good = self.stays_apart(left, token)
                if good:
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            row[end] = token
            if shared:
                last[data[:end]] = token
        ids, end, spelled = [], n, self.spelled
        while end:
            token = row[end]
            if token < 0:
                token = last[data[:end]]
            ids.append(token)
            end -= len(spelled[token])
        ids.reverse()
        return ids

    def word(self, word: str) -> tuple[int, str, bytes]:
        """Of a pre-token: number of its ids, the ids as decimals joined by spaces, the bytes decoded from them."""
        found = self.words.get(word) or self.older.get(word)
        if found is None:
            ids = self.encode_bytes(word.encode())
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(word) <= 256:
            if len(self.words) >= WORDS_KEPT // 2:  # words in use pass on to the next generation, others go with theirs
                self.words, self.older = {}, self.words
            self.words[word] = found
        return found

    def pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        """``word`` of all pre-tokens of a text."""
        words = pretokens(text)
        found = list(map(self.words.get, words))
        return [f or self.word(w) for f, w in zip(found, words, strict=True)] if None in found else found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(int, ids.split()) for _, ids, _ in self.pieces(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class Growing:
    """An encoding that takes appended bytes and edits: prefixes before the change are kept as they are."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.table = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.table), len(self.data) + 1):
            self.table.append(self.encoder._tail(self.data, end, self.table.__getitem__))

    def edit(self, start: int, end: int, put: bytes) -> None:
        rest = self.data[end:]
        self.data, self.table = self.data[:start], self.table[: start + 1]
        self.append(put + rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.table[end])
            end -= len(self.encoder.spelled[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary; every node has the tokenizer files, their place is a parameter."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


keeps(encoder.cache_clear)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes decoded from them. One pass, no shuffle."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for text in texts_of(batch, 1):
                words = enc.pieces(text)
                counts.append(sum([w[0] for w in words]))
                ids_hex.append(hashlib.sha256(" ".join([w[1] for w in words]).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(b"".join([w[2] for w in words])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_pass(id_and_text(docs), run, SCHEMA)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per document the ids themselves: doc_id, ids array<int>."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = pa.array([enc.encode(t) for t in texts_of(batch, 1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return arrow_pass(id_and_text(docs), run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """From doc_id and ids array<int> back to bytes: doc_id, bytes binary. Null ids: no bytes."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            data = pa.array([enc.decode(v.as_py() or []) for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["doc_id", "bytes"])

    return arrow_pass(ids.select("doc_id", "ids"), run, "doc_id long, bytes binary")
