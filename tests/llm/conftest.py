"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import random

import pytest

#: Names that an operator might use for itself.
CLASHING = ["row", "at", "hash", "__rid", "__len", "__hash", "__plain", "__points", "__file", "__row", "__times", "__copy", "__score", "__y", "_metadata", "c0", "c1"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    r = random.Random(9)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in every column, empty and long texts, ties, repeated rows, texts of other alphabets."""
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(60)
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base.replace(" ", "\n "), "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, "  \t\r\n ", "en", "", 6), (None, "one two", "de", "a", 7), (None, None, "de", None, 7), (6, "One TWO", "de", "b", 7), (6, "One TWO", "de", "b", 7),
        (7, text(9000), "en", "a", 1), (8, "x" * 5000, "en", None, 1), (9, "漢字 かな 한글 😀 é ñ ß ½ ² 　 \x1c", "ja", "c", 1), (10, "a b c", "en", "c", 5),
        (11, "a b c d", "en", "c", 7), (12, base + " more", "en", "a", 1),
    ]
    rows += [(100 + i, text(r.randint(1, 80)), "en", r.choice("aaab"), 1) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def odd_more(odd):
    """The same with extra columns, some named as results are."""
    from pyspark.sql import functions as F

    names = ["size", "taken", "score", "kept", "fingerprint", "component_id", "ids", "host", "n", "target", "h", "key", "label", "evidence", *CLASHING]
    return odd.select("n_chars", "text", *[F.lit("extra").alias(n) for n in names], "source", "lang", "doc_id")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows_of():
    """Rows as comparable tuples in order of their text."""

    def found(df, *columns):
        return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)

    return found
