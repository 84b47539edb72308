"""Counts of the shared trie against one plain dynamic programme for each pre-token."""

from __future__ import annotations

import public_tokenizers as P
import pytest

from landrank.llm import bpe, token_counts
from landrank.llm.pretoken import pretokens

PATH = P.path("byte_bpe_50k.tiktoken")


def plain(word: bytes, ranks) -> int:
    """Least (cost, pieces) over all segmentations."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - 128), end):
            rank = ranks.get(word[start:end])
            if rank is not None:
                cost, n = best[start]
                options.append((cost + (token_counts.piece_cost(rank) >> token_counts.COUNT_BITS), n + 1))
        best.append(min(options))
    return best[-1][1]


@pytest.fixture(scope="module")
def ranks():
    return bpe.encoder(PATH).ranks


def test_words(ranks, words):
    shared = token_counts.SharedTrie(ranks)
    for w in [*words, "internationalisation", "été", "a" * 700, "漢字", " the", "x"]:
        assert shared.count(w) == plain(w.encode(), ranks), w


def test_prefixes_are_scored_once(ranks):
    shared, seen = token_counts.SharedTrie(ranks), []
    score = shared._score
    shared._score = lambda word, end, at: seen.append(word[:end]) or score(word, end, at)
    for w in ("the", "then", "there", "them", "the"):
        shared.count(w)
    assert len(seen) == len(set(seen)) == len({w[:i] for w in ("then", "there", "them") for i in range(1, len(w) + 1)})


def test_full_trie_changes_nothing(ranks, words, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 30)
    monkeypatch.setattr(token_counts, "TERMINALS", 10)
    small, large = token_counts.SharedTrie(ranks), token_counts.trie(PATH)
    assert [small.count(w) for w in words] == [large.count(w) for w in words]


def test_table(odd, odd_more, none, odd_rows, ranks, rows_of):
    want = []
    for row in odd_rows:
        found = pretokens(row[1] or "")
        want.append((row[0], len(found), sum(plain(w.encode(), ranks) for w in found)))
    got = rows_of(token_counts.counted(odd, PATH))
    assert got == sorted(want, key=str) and rows_of(token_counts.counted(odd_more, PATH)) == got
    assert token_counts.counted(none, PATH).collect() == []
