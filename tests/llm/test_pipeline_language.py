"""The language stage against a plain form of the mixture: labels absent, wrong, of mixed texts, or none at all."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from flowsieve.llm import languages

SF = "/root/testdata/sf0.001"


def plain_trigrams(text):
    """Byte trigrams between two spaces, hashed; non-letters are spaces."""
    raw = [32, *(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").encode().lower()), 32]
    near = [t for t in zip(raw, raw[1:], raw[2:]) if t[1] != 32 or (t[0] != 32 and t[2] != 32)]
    return [((x << 16 | y << 8 | z) * 2654435761 & 0xFFFFFFFF) >> 17 for x, y, z in near]


def plain_fit(logs, chosen):
    """Proportions and log-likelihood of a set of languages after 20 rounds."""
    weights = [1 / len(chosen)] * len(chosen)

    def joint():
        return [[w * math.exp(row[c] - max(row[k] for k in chosen)) for w, c in zip(weights, chosen)] for row in logs]

    for _ in range(20):
        shares = [[x / sum(row) for x in row] for row in joint()]
        weights = [sum(s[i] for s in shares) / len(logs) for i in range(len(chosen))]
    return weights, sum(math.log(sum(j)) + max(row[k] for k in chosen) for j, row in zip(joint(), logs))


def plain_language(text, counts):
    names = sorted(counts)
    h = plain_trigrams(text)
    total = {x: sum(counts[x].values()) + 0.5 * 2**15 for x in names}
    windows = [h[i : i + 32] for i in range(0, len(h), 32)]
    logs = [[sum(math.log((counts[x].get(t, 0) + 0.5) / total[x]) for t in w) for x in names] for w in windows]
    single = [sum(row[i] for row in logs) for i in range(len(names))]
    chosen = [single.index(max(single))]
    weights, best = [1.0], max(single)
    while len(chosen) < len(names):
        fits = [(*plain_fit(logs, [*chosen, i]), i) for i in range(len(names)) if i not in chosen]
        w, like, i = max(fits, key=lambda f: (f[1], -f[2]))
        if like - best <= 4.0 * math.log(len(logs) + 1):
            break
        weights, best = w, like
        chosen.append(i)
    return names[chosen[weights.index(max(weights))]]


def test_language_stage_writes_what_it_found(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    held = source.filter(languages.held_out(F.col("doc_id")))
    own = {x: held.filter(f"lang = '{x}' AND n_chars BETWEEN 400 AND 4000").orderBy("doc_id").head().text for x in ("de", "fr", "es")}
    planted = [(90_000, own["de"], None), (90_001, own["fr"], "en"), (90_002, own["es"][:390] + " " + own["de"][:130], "de"), (90_003, "### 12", "en")]
    more = spark.createDataFrame(planted, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = source.unionByName(more)
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if r.lang is not None and languages.in_training(r.doc_id, 5):
            n = counts.setdefault(r.lang, {})
            for t in plain_trigrams(r.text):
                n[t] = n.get(t, 0) + 1
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert got.keys() == {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    sample = [r for r in rows if r.doc_id in got and len(r.text) < 5000]
    assert len(sample) > 100 and {r.doc_id: got[r.doc_id] for r in sample} == {r.doc_id: plain_language(r.text, counts) for r in sample}
    assert [got.get(90_000 + i) for i in range(4)] == ["de", "fr", "es", None]


def test_nothing_is_lost_where_no_language_is_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "## 1", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {(1, "some words", None), (4, "é", None)}
