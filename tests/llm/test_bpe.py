"""BPE against the tokenizer library; appends, edits and decoding against a fresh encoding."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from landrank.llm import bpe
from landrank.llm.pretoken import pretokens

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH)


@pytest.fixture(scope="module")
def library(enc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_random_texts(enc, library):
    r = random.Random(2)
    pool = "abeinrst  '  \n\t0123\x1c\x1f\x85\xa0éßñ漢字かな한글😀 　​﻿²½ªʰ\U0003f836\U00032485\U0001e900.,!?-_|#"
    for _ in range(1500):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 60)))
        assert enc.encode(text) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(text):
    enc = bpe.encoder(PATH)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    assert enc.encode(text) == whole.encode_ordinary(text)
    assert enc.decode(enc.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 5000, "=-" * 1000, "the" * 700, "don't we'll I'd", "<|endoftext|>"])
def test_runs(enc, library, text):
    assert enc.encode(text) == library.encode_ordinary(text)


def test_every_token_encodes_to_itself_or_is_unreachable(enc):
    r = random.Random(0)
    for token in r.sample(sorted(enc.ranks), 2000):
        assert enc.decode(enc.encode_bytes(token)) == token


def test_appends_and_edits(enc):
    r = random.Random(7)
    growing = bpe.Growing(enc)
    for _ in range(150):
        growing.append(bytes(r.choice(b"abcdetn ") for _ in range(r.randint(0, 5))))
        assert growing.ids() == enc.encode_bytes(growing.data)
    for _ in range(100):
        a, b = sorted(r.randrange(len(growing.data)) for _ in range(2))
        growing.edit(a, min(b, a + 6), bytes(r.choice(b"xyzthe") for _ in range(r.randint(0, 4))))
        assert growing.ids() == enc.encode_bytes(growing.data)


def test_full_tables_change_nothing(enc, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "PREFIXES_KEPT", 60)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    own = bpe.Encoder(enc.ranks)
    text = "the quick brown foxes jumped over internationalisation and then themselves " * 3
    assert own.encode(text) == library.encode_ordinary(text)


def test_table(odd, odd_more, none, odd_rows, library, rows_of):
    want = []
    for row in odd_rows:
        text = row[1] or ""
        ids = library.encode_ordinary(text)
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = rows_of(bpe.digests(odd, PATH))
    assert got == sorted(want, key=str) and rows_of(bpe.digests(odd_more, PATH)) == got
    assert bpe.digests(none, PATH).collect() == []
    back = bpe.decoded(bpe.encoded(odd, PATH), PATH)
    assert rows_of(back) == sorted(((r[0], bytearray((r[1] or "").encode())) for r in odd_rows), key=str)


def test_pretokens_are_the_patterns():
    import regex

    pattern = regex.compile(P.PATTERN)
    for text in ("It's 12 o'clock!\n\n  Next  line ", "a b", "x_y", "été ß"):
        assert pretokens(text) == pattern.findall(text)


def test_workers_let_go_between_passes():
    from landrank.llm import common

    gone = []
    common.keeps(lambda: gone.append(1))
    common.entered("a")
    n = len(gone)
    common.entered("a")
    assert len(gone) == n
    common.entered("b")
    assert len(gone) == n + 1
    common._kept.pop()
