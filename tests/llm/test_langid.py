"""Language identification: trigram counts, fusion of evidence, held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest

from landrank.llm import langid

STEMS = {"en": "the and ing tion of with er", "fr": "le des que eux tion ment re", "de": "der und sch keit ung ver ein"}
PAGES = "page_id long, url string, html string"


def _text(lang, r, n=40):
    parts = STEMS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, _text(lang, r), lang, f"s{i % 4}") for i, lang in enumerate(["en", "fr", "de"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_trigrams():
    assert len(langid.trigrams("ab")) == 0 and len(langid.trigrams("ABCD")) == 2
    assert (langid.trigrams("Abcd") == langid.trigrams("abcd")).all() and langid.trigrams("é" * 5).max() < langid.SLOTS


def test_model_counts_every_trigram(docs):
    langs, table = langid.fit(docs)
    assert langs == ["de", "en", "fr"] and np.allclose(np.exp(table).sum(axis=0), 1)
    en = [r["text"] for r in docs.collect() if r["lang"] == "en"]
    counts = sum(np.bincount(langid.trigrams(t), minlength=langid.SLOTS) for t in en) + 0.5
    assert np.allclose(table[:, 1], np.log(counts / counts.sum()))


def test_held_out_accuracy(spark, docs):
    r = random.Random(77)
    truth = {i: lang for i, lang in enumerate(["en", "fr", "de"] * 40)}
    pages = [(i, f"http://h{i % 7}.example.com/x", f'<html lang="{lang}"><script>var der und sch;</script><p>{_text(lang, r, 15)}</p></html>') for i, lang in truth.items()]
    got = {x["page_id"]: x for x in langid.identified(spark.createDataFrame(pages, PAGES), docs).where("page_id is not null").collect()}
    assert np.mean([got[i]["lang"] == lang for i, lang in truth.items()]) > 0.97


def test_evidence_decides_where_text_does_not(spark, docs):
    """Pages without words: the declared language decides, then the host's habit; a wrong declaration yields to a long text."""
    r = random.Random(5)
    rows = [(i, "http://fr-site.example.fr/", f'<html lang="fr">{_text("fr", r)}</html>') for i in range(40)]
    rows += [(100 + i, "http://de-site.example.de/", f'<html lang="de">{_text("de", r)}</html>') for i in range(40)]
    rows += [(900, "http://fr-site.example.fr/empty", "<html><p></p></html>"), (901, "http://new.example.com/", '<html lang="de"></html>')]
    rows += [(902, "http://fr-site.example.fr/wrong", f'<html lang="en">{_text("de", r, 300)}</html>'), (903, None, None), (None, "nonsense", "")]
    got = {x["page_id"]: x for x in langid.identified(spark.createDataFrame(rows, PAGES), docs).where("host is null or host not like 'source%'").collect()}
    assert got[900]["lang"] == "fr" and got[901]["lang"] == "de" and got[902]["lang"] == "de"
    assert got[903]["lang"] in langid.fit(docs)[0] and 0 < got[903]["confidence"] <= 1 and got[902]["declared"] == "en"


def test_table(spark, odd, odd_more, none, odd_rows, rows_of):
    pages = spark.createDataFrame([], PAGES)
    got = rows_of(langid.identified(pages, odd))
    assert len(got) == len(odd_rows) and rows_of(langid.identified(pages, odd_more)) == got
    assert rows_of(langid.identified(None, odd)) == got
    assert langid.identified(pages, none).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/", "<html lang=en>x</html>")], PAGES)
    assert [x["lang"] for x in langid.identified(one, none).collect()] == [None]


HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def test_scanners_against_patterns():
    r = random.Random(8)
    bits = ["<", ">", "<html ", "lang=", " lang = ' fr'", "en", "<script", "</script>", "</script >", "<STYLE>", "</style>", "<!--", "-->", "--", "<p>", "text", " ", "\n", "<scripted>", "İ"]
    for _ in range(4000):
        html = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert langid.visible(html) == HIDDEN.sub(" ", html), html
        said = DECLARED.search(html)
        assert langid.declared_language(html) == (said[1].lower() if said else None), html


@pytest.mark.parametrize("bit", ["<", "<script>", "<!--", "<html ", "<style></script>", "<html lang=   ", "lang=  ", "</script ", "<!-->"])
def test_long_pages_take_seconds(bit):
    html = "<html>" + bit * (5_000_000 // len(bit))
    start = time.time()
    langid.visible(html)
    langid.declared_language(html)
    assert time.time() - start < 20


@pytest.mark.parametrize("large", [100_000, 20])
def test_fusion_against_plain_arithmetic(spark, docs, monkeypatch, large):
    """Posteriors of the whole table, evidence put together one row at a time."""
    monkeypatch.setattr(langid, "LARGE", large)
    r = random.Random(31)
    pages = [(i, f"http://h{i % 5}.example.{'fr' if i % 3 else 'com'}/x", f'<html lang="{r.choice(["en", "fr", "de", "xx"])}">{_text(r.choice(["en", "fr"]), r, r.randint(0, 6))}</html>') for i in range(60)]
    pages += [(60, None, "bare"), (61, "http://h1.example.com/", None)]
    langs, table = langid.fit(docs)
    rows = []

    def likelihood(text):
        logs = [sum(float(table[t, k]) for t in langid.trigrams(text)) / langid.INDEPENDENT for k in range(len(langs))]
        return [x - max(logs) for x in logs]

    for i, url, html in pages:
        host = (url or "").partition("://")[2].partition("/")[0]
        logs = likelihood(langid.visible(html or ""))
        rows.append((("page", i), f"page {host}", host.rpartition(".")[2], langid.declared_language(html or ""), logs))
    for d in docs.collect():
        rows.append((("doc", d["doc_id"]), f"doc {d['source']}", "source", None, likelihood(d["text"])))
    posts = [[math.exp(x) / sum(map(math.exp, logs)) for x in logs] for *_, logs in rows]
    n, ks = len(rows), range(len(langs))
    overall = [(sum(p[k] for p in posts) + 1) / (n + len(langs)) for k in ks]
    claims = [*langs, "other"]
    said = [None if d is None else d if d in langs else "other" for *_, d, _ in rows]
    want = {}
    for at, (key, host, suffix, _, logs) in enumerate(rows):
        own = posts[at]
        in_host = [j for j in range(n) if rows[j][1] == host]
        in_suffix = [j for j in range(n) if rows[j][2] == suffix]
        z = []
        for k in ks:
            rest = (sum(posts[j][k] for j in in_suffix) - own[k] + langid.SUFFIX_ROWS * overall[k]) / (len(in_suffix) - 1 + langid.SUFFIX_ROWS)
            prior = (sum(posts[j][k] for j in in_host) - own[k] + langid.HOST_ROWS * rest) / (len(in_host) - 1 + langid.HOST_ROWS)
            told = 0.0
            if said[at] is not None:
                seen = sum(posts[j][k] for j in range(n) if said[j] == said[at])
                total = sum(posts[j][k] for j in range(n) if said[j] is not None)
                told = math.log((seen + (said[at] == langs[k]) + 0.1) / (total + 1 + 0.1 * len(claims)))
            z.append(logs[k] + told + math.log(max(prior, 1e-9)))
        best = max(z)
        want[key] = (langs[z.index(best)], 1 / sum(math.exp(x - best) for x in z))
    got = langid.identified(spark.createDataFrame(pages, PAGES), docs).collect()
    assert len(got) == n
    for x in got:
        lang, sure = want[("page", x["page_id"]) if x["page_id"] is not None else ("doc", x["doc_id"])]
        assert x["confidence"] == pytest.approx(sure, rel=1e-6) and (x["lang"] == lang or sure < 0.51)
