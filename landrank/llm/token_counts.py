"""Operator 1: token counts of a unigram model, by dynamic programming shared in a trie.

Pieces are the tokens of a public byte-level vocabulary.  Such files have ranks and no probabilities, and tokenizers are
not trained here, so a piece of rank r has the fixed cost round(1000000 * ln(r + 2)): Zipf's law.  A pre-token's count is
the number of pieces of its cheapest segmentation, fewest pieces among equally cheap ones.

Distinct pre-tokens go into a trie of their bytes.  A node's forward score, the least cost of its prefix, is computed when
the node is made, from the scores of the nodes above it and the pieces that end there (found in a trie of reversed
pieces), so prefixes that pre-tokens share are scored once; terminals store the counts.  Cost and count share one integer,
cost in the high part, so one minimum settles both.  Tries live in the Python workers and are emptied when full, which
costs time and changes no result; no row is shuffled.

Cases.  Null and empty text: 0 and 0.  Very long pre-tokens: scored in a row of their own, outside the trie.  Ties: fewest
pieces.  Rows repeated: each its counts.  Null doc_id: handed on.  Empty table: empty result.  Extra columns: not read.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, id_and_text, keeps, texts_of
from .pretoken import pretokens

#: Nodes and terminals that a worker keeps; bytes of a pre-token beyond which it stays out of the trie.
NODES, TERMINALS, LONG = 400_000, 400_000, 512
COUNT_BITS = 32
COUNT_MASK = (1 << COUNT_BITS) - 1


def piece_cost(rank: int) -> int:
    return (round(1_000_000 * math.log(rank + 2)) << COUNT_BITS) + 1


class SharedTrie:
    def __init__(self, ranks: dict[bytes, int]):
        # reversed pieces: (state << 8 | byte) -> state; cost of the piece that a state spells, or None
        self.back: dict[int, int] = {}
        self.cost: list[int | None] = [None]
        for piece, rank in ranks.items():
            state = 0
            for b in reversed(piece):
                key = state << 8 | b
                state = self.back.get(key, 0)
                if not state:
                    state = self.back[key] = len(self.cost)
                    self.cost.append(None)
            self.cost[state] = piece_cost(rank)
        self.clear()

    def clear(self) -> None:
        self.kids: dict[int, int] = {}
        self.best: list[int] = [0]
        self.counts: dict[str, int] = {}

    def _score(self, word: bytes, end: int, score_at) -> int:
        """Least cost of ``word[:end]`` from those of its shorter prefixes."""
        back, cost, state, least = self.back, self.cost, 0, None
        for at in range(end - 1, -1, -1):
            state = back.get(state << 8 | word[at])
            if state is None:
                break
            own = cost[state]
            if own is not None:
                own += score_at(at)
                if least is None or own < least:
                    least = own
        return least

    def insert(self, word: bytes) -> int:
        """Number of pieces of a pre-token."""
        if len(word) > LONG:
            row = [0]
            for end in range(1, len(word) + 1):
                row.append(self._score(word, end, row.__getitem__))
            return row[-1] & COUNT_MASK
        if len(self.best) > NODES:
            self.clear()
        kids, best, node, above = self.kids, self.best, 0, [0]
        for end, b in enumerate(word, 1):
            key = node << 8 | b
            node = kids.get(key)
            if node is None:
                node = kids[key] = len(best)
                best.append(self._score(word, end, lambda at: best[above[at]]))
            above.append(node)
        return best[node] & COUNT_MASK

    def count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is None:
            if len(self.counts) >= TERMINALS:
                self.clear()
            found = self.insert(word.encode())
            if len(word) <= LONG:
                self.counts[word] = found
        return found


@lru_cache(maxsize=2)
def trie(path: str) -> SharedTrie:
    with open(path, "rb") as f:
        return SharedTrie({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


keeps(trie.cache_clear)


def counted(docs: DataFrame, path: str) -> DataFrame:
    """Per document doc_id, n_pretokens, n_tokens."""

    def run(batches):
        shared = trie(path)
        for batch in batches:
            words, pieces = [], []
            for text in texts_of(batch, 1):
                found = Counter(pretokens(text))
                words.append(found.total())
                pieces.append(sum(n * shared.count(w) for w, n in found.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"]
            )

    return arrow_pass(id_and_text(docs), run, "doc_id long, n_pretokens long, n_tokens long")
