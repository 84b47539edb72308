"""URL rules and the Bloom cascade against plain sets."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from landrank.llm import url_filter

LISTED = ["bad.com", "casino.example.com", "x.org", "bad.com", ""]


def plain(url, listed=LISTED, rules=url_filter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)
    domains = [".".join(host.split(".")[i:]) for i in range(len(host.split(".")))]
    own = bool(set(domains) & ({*listed} - {""}))
    return host, path, best and best[0] + best[1], best[2] if best else "block" if own else "allow", own


URLS = [
    "http://a.example.net/en/1?x=/de/", "http://example.net/en", "HTTP://EXAMPLE.NET/en/", "http://net/", "http://net", "http://b.net?x", "http://sub.b.net/a#/en/",
    "https://example.com/de/x", "https://w.example.com/de/", "https://example.com/de", "http://wiki.org/fr/x", "http://wiki.org/FR/x", "http://x.org/fr/", "http://x.org/", "http://y.x.org/a",
    "http://notx.org/", "http://casino.example.com/en/", "http://a.casino.example.com", "http://example.com.evil/", "http://bad.com:80/", "http://u@bad.com/", "http://bad.com./", "mailto:a@b",
    None, "", "://", "http://", "http://É.com/", "a://b://c/d", "http://bad.com/\nx", "http://..//", "http://h/" + "p" * 3000, "http://bad.com", "http://bad.com",
]


def test_table(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://bad.com/"), (3, "http://net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"html": F.lit(None).cast("string"), "host": F.lit("x"), "verdict": F.lit("y"), "rule": F.lit("z")})
    got = sorted([tuple(r) for r in url_filter.judged(df, LISTED).collect()], key=str)
    assert got == sorted([(i, *plain(u)) for i, u in rows], key=str)
    assert url_filter.judged(df.limit(0), LISTED).collect() == []
    assert {r["verdict"] for r in url_filter.judged(df.where("url like '%bad.com/' and page_id is null"), []).collect()} == {"allow"}


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_cascade_is_exact(spark, n):
    r = random.Random(n)
    keys = list({f"{r.getrandbits(40):x}.com" for _ in range(6000)})
    listed = set(keys[:n])
    df = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = url_filter.build(df)
    assert {k for k in keys if cascade.lists(k)} == listed
    assert cascade.size() < 40 + 3 * max(n, 60)


def test_universe_holds_all_ends_that_can_be_listed(spark):
    hosts = spark.createDataFrame([("a.b.c",), ("a.b.c",), ("c",), ("",)], "host string")
    got = {r["key"]: r["listed"] for r in url_filter.universe(hosts, ["b.c", "z"]).collect()}
    assert got == {"b.c": True, "c": False, "z": True}
    got = {r["key"]: r["listed"] for r in url_filter.universe(hosts, ["x.b.c", ""]).collect()}
    assert got == {"a.b.c": False, "b.c": False, "c": False, "x.b.c": True}
    assert url_filter.domains("a.b.c", 2) == ["b.c", "c"] and url_filter.domains("a.b.c", 9) == ["a.b.c", "b.c", "c"] and url_filter.domains("", 3) == [""]
    with pytest.raises(ValueError, match="labels"):
        url_filter.universe(hosts, ["." * 200])


def test_very_long_hosts(spark):
    """Hosts of 200,000 labels take seconds, listed and not."""
    long = "l." * 200_000
    rows = [(0, f"http://{long}bad.com/x"), (1, f"http://{long}good.com/"), (2, "http://" + "x" * 500_000 + ".x.org")]
    start = time.time()
    got = {r["page_id"]: r["listed"] for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), LISTED).collect()}
    assert got == {0: True, 1: False, 2: True} and time.time() - start < 60


def test_keys_that_no_level_parts(spark, monkeypatch):
    """Two keys of one hash, one listed, end in an error, not in levels for ever."""
    monkeypatch.setattr(url_filter, "LEVELS", 6)
    same = spark.createDataFrame([("a", True), ("a", False)], "key string, listed boolean")
    with pytest.raises(ValueError, match="hash"):
        url_filter.build(same)


def test_bound_of_the_levels(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CASCADE_BYTES", 4)
    with pytest.raises(ValueError, match="split the list"):
        url_filter.build(spark.createDataFrame([("a", True), ("b", False)], "key string, listed boolean"))
