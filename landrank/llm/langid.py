"""Operator 7: language identification by Bayesian fusion of evidence.

Evidence of a row: likelihood of its whole text under byte-trigram models; the language that its markup declares; the
suffix of its address; its host (for documents without an address, their source stands for the host).

Trigram models are fitted on a bounded sample of documents (``EXAMPLES``, by smallest hash).  All other statistics are
grouped sums of the text posteriors over all rows: how often each language is declared as which (so that a habitual wrong
declaration counts for little), and priors of hosts, smoothed towards their suffix's, smoothed towards the corpus's.  A
row's own share is taken out of its priors.  Posterior = text likelihood x P(declared | language) x host prior.

Cases.  Null or empty text or page: likelihoods equal, the other evidence decides.  No declaration, or one of a language
without a model: that of "other", resp. none.  Null url or host: a group of its own.  Ties: the language that sorts first.
Rows repeated: each its result.  Empty table: empty result.  No labelled document at all: language null.  Over
``LANGUAGES`` languages in the sample: an error.  Very long pages: whole, in one pass even where tags do not close; script,
style and comments are not text.  Extra columns: not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, stored
from .url_filter import host_and_path

EXAMPLES, SLOTS, LANGUAGES = 4000, 1 << 15, 200
#: Trigrams overlap, so a text of n of them holds about a third as much independent evidence.
INDEPENDENT = 3.0
#: Rows that a suffix borrows from the corpus, and a host from its suffix.
SUFFIX_ROWS, HOST_ROWS = 20.0, 10.0
#: Rows of a group whose priors are sent to all tasks; there is at most one such group in as many rows of the corpus.
LARGE = 100_000
OPENED = re.compile(r"(script|style)\b", re.I)
CLOSED = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style")}
HTML = re.compile(r"<html\b", re.I)
LANG = re.compile(r"\blang\s*+=\s*+(?:[\"']\s*+)?([A-Za-z]+)", re.I)


def visible(html: str) -> str:
    """The text of a page: without tags, comments, and the content of script and style; a ``<`` that nothing closes is text.

    One pass: what is not found from one place on is not looked for again.
    """
    out, at, gone = [], 0, set()

    def end_of(kind: str, start: int) -> int:
        if kind in gone:
            return -1
        if kind in CLOSED:
            found = CLOSED[kind].search(html, start)
            end = found.end() if found else -1
        else:
            end = html.find(kind, start)
            end = end + len(kind) if end >= 0 else -1
        if end < 0:
            gone.add(kind)
        return end

    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        opened = OPENED.match(html, start + 1)
        end = end_of(opened[1].lower(), opened.end()) if opened else -1
        if end < 0 and html.startswith("<!--", start):
            end = end_of("-->", start + 4)
        if end < 0:
            end = end_of(">", start + 1)
        out.append(" " if end >= 0 else "<")
        at = end if end >= 0 else start + 1
    out.append(html[at:])
    return "".join(out)


def declared_language(html: str) -> str | None:
    """What the first ``<html`` tag that has a ``lang`` says, lower-cased; no character is looked at twice."""
    at = 0
    while tag := HTML.search(html, at):
        at = html.find(">", tag.end())
        end = at if at >= 0 else len(html)
        if said := LANG.search(html, tag.end(), end):
            return said[1].lower()
        if at < 0:
            return None
    return None


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probability of each trigram slot (rows) in each language (columns)."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    picked = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(EXAMPLES)
    last = picked.agg(F.max("h")).first()[0]
    if last is None:
        return [], np.zeros((SLOTS, 0))

    def count(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                row = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                row += np.bincount(trigrams(text.as_py() or ""), minlength=SLOTS)
            for lang, row in sums.items():
                at = np.nonzero(row)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "at", "n"])

    sample = rows.where(F.xxhash64("text") <= F.lit(last)).dropDuplicates(["text"])
    sums = arrow_pass(sample, count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # SLOTS rows a language at most
    langs = sorted(found["lang"].unique())
    if len(langs) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    counts = np.full((SLOTS, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        counts[mine["at"].to_numpy(), k] += mine["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0))


def _evidence(model: tuple[list[str], np.ndarray], page: bool):
    langs, table = model

    def run(batches):
        for batch in batches:
            out, declared = np.zeros((batch.num_rows, len(langs))), []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                if page:
                    declared.append(declared_language(text))
                    text = visible(text)
                at = trigrams(text)
                if len(at):
                    for start in range(0, len(at), 1 << 16):
                        out[i] += table[at[start : start + (1 << 16)]].sum(axis=0)
            out /= INDEPENDENT
            out -= out.max(axis=1, initial=0 if not len(langs) else -math.inf, keepdims=True) if len(langs) else 0
            own = [pa.array(out[:, k]) for k in range(len(langs))]
            said = pa.array(declared if page else [None] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), said, *own], names=["id", "host", "declared", *(f"l{k}" for k in range(len(langs)))])

    return run


def identified(pages: DataFrame | None, docs: DataFrame) -> DataFrame:
    """A row for every page and every document: page_id or doc_id, lang, confidence, text_lang, declared, host."""
    langs, table = model = fit(docs)
    n = len(langs)
    ddl = "id long, host string, declared string" + "".join(f", l{k} double" for k in range(n))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.concat(F.lit("source "), F.col("source").cast("string")).alias("host"))
    rows = arrow_pass(texts, _evidence(model, False), ddl).withColumn("page", F.lit(False))
    if pages is not None:
        host = host_and_path(F.col("url").cast("string"))[0]
        sites = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").cast("string").alias("html"), host.alias("host"))
        rows = rows.unionByName(arrow_pass(sites, _evidence(model, True), ddl).withColumn("page", F.lit(True)))
    rows = rows.withColumn("suffix", F.when(F.col("page"), F.coalesce(F.element_at(F.split("host", r"\."), -1), F.lit(""))).otherwise("source"))
    # a host is known by its group key, so that null hosts are a group like any other
    rows = rows.withColumn("group", F.concat_ws(" ", F.col("page").cast("string"), F.coalesce("host", F.lit("\0"))))
    if not n:
        return rows.select(
            F.when(F.col("page"), F.col("id")).alias("page_id"), F.when(~F.col("page"), F.col("id")).alias("doc_id"),
            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host",
        )
    all_l = sum((F.exp(f"l{k}") for k in range(n)), F.lit(0.0))
    rows = rows.withColumns({f"p{k}": F.exp(f"l{k}") / all_l for k in range(n)})
    rows = rows.withColumn("said", F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other")))
    rows = stored(rows, "language-evidence")

    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in range(n)]
    whole = rows.agg(F.count("*").alias("n"), *sums).first()
    overall = [((whole[f"s{k}"] or 0) + 1) / ((whole["n"] or 0) + n) for k in range(n)]
    # P(declared | language): at most languages + 1 rows
    told = {r["said"]: r for r in rows.where("said is not null").groupBy("said").agg(*sums).collect()}
    totals = [sum(r[f"s{k}"] for r in told.values()) for k in range(n)]
    claims = [*langs, "other"]
    means = F.lit(0.0)
    says = [means] * n
    for said in claims:
        for k in range(n):
            seen = told[said][f"s{k}"] if said in told else 0.0
            right = 1.0 if said == langs[k] else 0.0
            chance = math.log((seen + right + 0.1) / (totals[k] + 1 + 0.1 * len(claims)))
            says[k] = F.when(F.col("said") == said, F.lit(chance)).otherwise(says[k])

    hosts = stored(rows.groupBy("group", "suffix").agg(F.count("*").alias("n"), *sums), "language-hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("m"), *(F.sum(f"s{k}").alias(f"t{k}") for k in range(n)))
    priors = hosts.join(suffixes, "suffix").drop("suffix")
    # groups of very many rows, of which there are few by their size, go to the rows; the others are joined
    large = F.broadcast(priors.where(F.col("n") > LARGE))
    found = rows.join(large, "group").unionByName(rows.join(large.select("group"), "group", "left_anti").join(priors.where(F.col("n") <= LARGE), "group"))
    score = []
    for k in range(n):
        rest = (F.col(f"t{k}") - F.col(f"p{k}") + SUFFIX_ROWS * overall[k]) / (F.col("m") - 1 + SUFFIX_ROWS)
        prior = (F.col(f"s{k}") - F.col(f"p{k}") + HOST_ROWS * rest) / (F.col("n") - 1 + HOST_ROWS)
        score.append(F.col(f"l{k}") + says[k] + F.log(F.greatest(prior, F.lit(1e-9))))
    found = found.withColumns({f"z{k}": s for k, s in enumerate(score)})
    best = F.greatest(*(F.col(f"z{k}") for k in range(n))) if n > 1 else F.col("z0")
    likely = F.greatest(*(F.col(f"l{k}") for k in range(n))) if n > 1 else F.col("l0")

    def named(column: str, top) -> F.Column:
        out = F.lit(None).cast("string")
        for k in reversed(range(n)):
            out = F.when(F.col(f"{column}{k}") == top, F.lit(langs[k])).otherwise(out)
        return out

    return found.select(
        F.when(F.col("page"), F.col("id")).alias("page_id"),
        F.when(~F.col("page"), F.col("id")).alias("doc_id"),
        named("z", best).alias("lang"),
        (1 / sum((F.exp(F.col(f"z{k}") - best) for k in range(n)), F.lit(0.0))).alias("confidence"),
        named("l", likely).alias("text_lang"),
        "declared",
        "host",
    )
