"""The pipeline and the registered queries against plain versions of their stages."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_toxicity import dense_of

import __spark_entry__ as entry
import corpus_pipeline
from landrank.llm import bpe, mixing, queries, toxicity

BAD = ["grubbel", "snorkface", "zwiebelkopf"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """Documents with toxic rows, exact copies, near copies and sources of several sizes; labels; pages."""
    r = random.Random(31)
    rows, labels = [], []
    for i in range(500):
        ws = [r.choice(words) for _ in range(r.randint(60, 160))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                ws.insert(r.randrange(len(ws)), r.choice(BAD))
        rows.append([i, " ".join(ws), "en", r.choice(["a", "a", "b", "c", None]), 1])
        labels.append((i, 1, int(toxic)))
    for k, i in enumerate(range(1, 200, 7)):
        rows.append([1000 + k, rows[i][1].replace(" ", "\n", 3), "en", "b", 1])
    for k, i in enumerate(range(2, 300, 11)):
        ws = rows[i][1].split(" ")
        ws[5], ws[-6] = "changed", "other"
        rows.append([2000 + k, " ".join(ws), "en", "c", 1])
    rows += [[3000, None, None, None, None], [3001, "", "en", "a", 0]]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    pages = [(0, "http://a.example.net/en/x", "<html lang='en'>the</html>"), (1, None, None), (2, "http://free-bets.example.com/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out)


def plain_toxic(model, text):
    """The score from all cosines, without the index."""
    if not hasattr(model, "dense"):
        model.dense, model.at = dense_of(model), {h: i for i, h in enumerate(model.terms.tolist())}
    q = np.zeros(len(model.terms))
    for w, n in toxicity.word_counts(text or "").items():
        if toxicity.word_hash(w) in model.at:
            q[model.at[toxicity.word_hash(w)]] = (1 + np.log(n)) * model.weight[model.at[toxicity.word_hash(w)]]
    if not q.any():
        return model.base
    cosines = np.round(model.dense @ (q / np.linalg.norm(q)), 6)
    near = sorted((-c, e) for e, c in enumerate(cosines) if c > 0)[: toxicity.NEAREST]
    return float(np.clip(np.interp(model.vote([(-c, e) for c, e in near]), *model.knots), 0, 1)) if near else model.base


def plain_near(rows):
    """Smallest doc_id of each group of texts joined by a Jaccard similarity of 0.8 of five-word shingles."""
    sets = []
    for row in rows:
        ws = (row[1] or "").encode().lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                part[root(i)] = root(j)
    best = {}
    for i, row in enumerate(rows):
        best[root(i)] = min(best.get(root(i), row), row, key=lambda x: x[0])
    return sorted(best.values(), key=lambda x: x[0])


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(queries.BYTE_BPE).ranks, special_tokens={})

    def kept(found):
        return sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])

    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS, name
        if i == 0:
            rows = [r for r in rows if plain_toxic(model, r[1]) < 0.5]
            assert 450 < len(rows) < 570
        elif i == 1:
            best = {}
            for r in rows:
                key = (r[1] or "").encode().translate(None, b" \t\n\x0b\x0c\r")
                best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1] or ""), x[0]))
            rows = sorted(best.values(), key=lambda x: x[0])
        elif i == 2:
            rows = plain_near(rows)
        elif i == 3:
            taken = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
            got = Counter(r["doc_id"] for r in out.collect())
            for r in rows:
                size, words_taken = taken[r[0]]["size"], taken[r[0]]["taken"]
                assert got[r[0]] in ((words_taken // size, words_taken // size + 1) if size else (1,))
            assert set(got) <= {r[0] for r in rows}
            rows = sorted((r for r in rows for _ in range(got[r[0]])), key=lambda r: r[0])
        if i < 4:
            assert kept(out) == rows, name
        else:
            want = []
            for r in rows:
                ids = library.encode_ordinary(r[1] or "")
                want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
            assert kept(out) == want
        docs = out
    again = corpus_pipeline.run(spark, folder)
    assert kept(again) == kept(docs)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, folder, name):
    found = entry.queries()[name](spark, folder)
    rows = found.collect()
    n = {"op3_url_filter": 3, "op7_language_id": 3 + spark.read.parquet(f"{folder}/documents.parquet").count()}
    assert len(rows) == n.get(name, spark.read.parquet(f"{folder}/documents.parquet").count())
    sql = entry.oracle_sql().get(name)
    if sql:
        duckdb = pytest.importorskip("duckdb")
        db = duckdb.connect()
        for t in ("documents", "pages", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        cursor = db.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        text = lambda rs, of: sorted([[str(r[of(c)]) for c in sorted(columns)] for r in rs])
        assert text(rows, lambda c: c) == text(cursor.fetchall(), columns.index)


def test_the_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {"llm", *(f"op{i}" for i in range(1, 11))} and "pipeline" in names
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_copies", "drop_near_copies", "mix_sources", "encode"]
