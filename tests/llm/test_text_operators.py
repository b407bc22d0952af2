"""Operators on texts against plain versions, with NULLs, empty and long texts, repeats and further columns."""

import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowsieve.llm import language_model, languages, leaks, licences, packing, pii, secrets, token_counts
from flowsieve.session import scratch_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "fp string, doc_id long, key string, text string, blob int, source string, lang string"
BITS = ["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "'", "1", "22", "!", "<|endoftext|>", "日本", "\x85", "\r\n", ".", "😀", "\x0b"]


def rows(texts):
    return [("x", i, None, t, 3, f"s{i % 3}", "en" if i % 2 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """NULL, empty, blank, repeated and very long texts, NULL and repeated ids, columns with names the operators use."""
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "###", "word " * 30_000, "7" * 5_000, "a@b.co " * 2_000, "same text here now", "same text here now"]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    data = rows(texts) + [("x", None, None, "no id at all", 3, None, None), ("x", 7, None, texts[7], 3, "s1", "en")]
    return data, spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


def test_token_counts(odd, empty, documents):
    library = Tokenizer.from_file(TOKENIZER)
    texts = documents.select("doc_id", "text").collect()
    for df, data in ((odd[1], [(r[1], r[3]) for r in odd[0]]), (documents, texts)):
        n = [len(e.ids) for e in library.encode_batch([t or "" for _, t in data], add_special_tokens=False)]
        want = [(i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(data, n)]
        got = pairs(token_counts.count_tokens(df, TOKENIZER), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        token_counts.PieceCounts(public_tokenizers.path("word_bpe_49k.json"))


def test_token_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_UNITS", 1)
    counter = token_counts.PieceCounts(TOKENIZER)
    assert [counter.count(["some words"]), counter.count(["other words here"]), counter.count(["some words"])] == [[2], [3], [2]]


def test_leaks(spark, odd, empty):
    items = [(0, "same text here now"), (1, "w1 w2 w3 w4 w5 w6 w7"), (2, None), (3, "!!"), (None, "W1, w2 w3 w4 w5 w6 w7"), (1, "w1 w2 w3 w4 w5 w6 w7")]
    texts = [t for *_, t in [(r[1], r[3]) for r in odd[0]]] + ["x " * 9_000 + "w1 w2 w3 w4 w5 w6 w7" + " y" * 9_000, "w1 w2 w3 w4 w5 w6", "w2 w3 w4 w5 w6 w7"]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks([(i, t) for i, t in enumerate(texts)], items)
    assert pairs(leaks.find_leaks(docs, table), "doc_id", "item_id", "n_item", "n_shared") == sorted(want, key=str) and len(want) > 4
    kept = {r.doc_id for r in leaks.without_leaks(docs, table).collect()}
    assert kept == set(range(len(texts))) - {w[0] for w in want}
    assert leaks.without_leaks(docs, table).columns == docs.columns
    assert leaks.find_leaks(empty, table).count() == 0 and leaks.find_leaks(docs, table.limit(0)).count() == 0
    assert leaks.without_leaks(docs, table.limit(0)).count() == len(texts)


def test_leaks_in_blocks_of_items(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = pairs(leaks.find_leaks(documents, items), "doc_id", "item_id")
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2000)
    assert pairs(leaks.find_leaks(documents, items), "doc_id", "item_id") == whole and whole


def test_ids_of_other_types_or_none_at_all(spark):
    docs = spark.createDataFrame([(None, "one two three four five six seven", None)] * 3, "doc_id int, text string, source string")
    for kind in ("int", "string", "long"):
        items = spark.createDataFrame([(None, "two three four five six")], f"item_id {kind}, text string")
        rows_ = leaks.find_leaks(docs, items).collect()
        assert [(r.doc_id, r.item_id, r.n_item, r.n_shared, r.containment) for r in rows_] == [(None, None, 1, 1, 1.0)] * 3
    items = spark.createDataFrame([(4, "two three four five six")], "item_id int, text string")
    assert [r.item_id for r in leaks.find_leaks(docs, items).collect()] == [4] * 3
    assert packing.pack(docs).agg({"n_tokens": "sum"}).head()[0] == 21


def test_short_items_are_searched_under_several_orders():
    index = leaks.ItemIndex([(i, f"t{i}a t{i}b t{i}c t{i}d t{i}e".encode()) for i in range(300)], 5, 0.8, 1e-6)
    assert len(index.orders) >= 4
    filler = " ".join(f"f{i}" for i in range(3_000))
    found = index.search((filler + " " + " x ".join(f"t{i}a t{i}b t{i}c t{i}d t{i}e" for i in range(300))).encode())
    assert [f[0] for f in found] == list(range(300))


def test_licences(spark, odd, empty):
    texts = [r[3] for r in odd[0]] + [
        "MIT License, mit license",
        "x " * 63 + "the Apache, License. and\nGeneral Public License",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "y " * 40 + "Licensed under\nCC BY-NC 4.0 " + "z " * 50,
        "redistribution and use in source and binary forms",
        "permission is hereby granted free charge to any person obtaining copy of this software",
    ]
    # whole paragraphs, wherever they stand, with a word in ten lost; notices that name another license
    notices = list(licences.TEMPLATES)
    paragraphs = [n.split() for n in notices if len(n.split()) > 40]
    texts += ["q " * k + " ".join(x for i, x in enumerate(p) if i % 10 != 4) + " r" * 30 for p in paragraphs for k in (0, 33, 200)]
    texts += ["Released under the BSD License", "Licensed under the Mozilla Public License, Version 2.0", "Released under the XYZ License"]
    got = {r.doc_id: r for r in licences.licence_digest(licences.scan_licences(spark.createDataFrame(rows(texts), SCHEMA))).collect()}
    for i, t in enumerate(texts):
        w = brute.plain_words(t)
        at = [(j, x) for p, x in licences.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        more = {}
        for notice, (x, naming) in licences.TEMPLATES.items():
            own, names, length = set(brute.plain_words(notice)), set(naming.split()), 64
            while length < 2 * len(brute.plain_words(notice)):
                length *= 2
            blocks = [set(w[b : b + length]) for b in range(0, len(w), length // 2)]
            best = max((len(own & b) / len(own) for b in blocks if names <= b), default=0)
            if best >= 0.8:
                more[x] = max(best, more.get(x, 0))
        base = sorted({x for _, x in at})
        want = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(base), ",".join(sorted({*base, *more})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want
        assert r.score == pytest.approx(1.0 if at else max(more.values(), default=0.0))
    first = len(odd[0])
    assert [got[first + k].labels for k in (1, 2, 3, 4, 5)] == ["apache,gpl", "bsd", "cc", "", "mit"]
    assert [got[len(texts) - k].labels for k in (3, 2, 1)] == ["bsd", "mpl", ""]
    label = {" ".join(n.split()): x for n, (x, _) in licences.TEMPLATES.items()}
    for j, p in enumerate(paragraphs):
        assert all(label[" ".join(p)] in got[first + 6 + 3 * j + k].labels.split(",") for k in range(3))
    found = licences.scan_licences(spark.createDataFrame([(1, "q " * 200 + " ".join(paragraphs[0]))], "doc_id int, text string")).head()
    assert [(m.label, m.containment, m.word) for m in found.matches] == [("mit", 1.0, 128)]
    assert licences.scan_licences(empty).count() == 0


def test_secrets(spark, odd, empty):
    texts = [r[3] for r in odd[0]] + [
        'é Password: "hunter22xx" TOKEN=ſhort secret = abcdefgh', "AKIA" + "Z" * 12 + " akia" + "Z" * 12, "0f" * 16 + " " + "0f" * 15,
        "api_key='0123456789abcdef0123456789abcdef'", "-----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----",
        "token token=token=token=abcdefgh", "paſſword=abcdefghi",
    ]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    path = scratch_path(spark, "ledger-test")
    got = {r.doc_id: r for r in secrets.span_digest(secrets.scan_history(docs, path)).collect()}
    for i, t in enumerate(texts):
        want = brute.secret_base(t)
        assert got[i].base_sha256 == brute.digest(want)
        assert [got[i][f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(s[2] == k for s in want) for k in secrets.BASE_KINDS]
    assert got[len(texts) - 3].spans.startswith("pem:0:")
    ledger = secrets.open_ledger(spark, path)
    assert ledger.count() == len({t or "" for t in texts})
    more = docs.unionAll(docs).unionAll(spark.createDataFrame(rows(["a new secret=abcdefgh1"]), SCHEMA))
    assert secrets.scan_history(more, path).count() == 2 * len(texts) + 1
    assert ledger.sparkSession.read.parquet(path).count() == len({t or "" for t in texts}) + 1  # only the unseen blob
    secrets.scan_new_blobs(docs, path, rule_version="next")
    assert spark.read.parquet(path).filter("rule_version = 'next'").count() == len({t or "" for t in texts})
    assert secrets.scan_history(empty, scratch_path(spark, "ledger-test")).count() == 0


def test_masking(spark):
    data = [(0, "x token=abcdefgh y", 18), (1, None, 4), (2, "plain", 99), (None, "AKIA" + "Z" * 12, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.mask_secrets(docs, scratch_path(spark, "ledger-test")).collect()}
    assert got == {0: ("x [secret] y", 12), 1: (None, 4), 2: ("plain", 5), None: ("[secret]", 8)}


def test_pii(spark, odd, empty):
    rng = random.Random(5)
    bits = ["a", ".", "@", "-", "1", "23", "4.5", "+", "_", "é", "😀", " ", "(", ")", "4316522678525456", "192.168.1.1", "x@y.com", "+1 (499) 555-6503"]
    texts = [r[3] for r in odd[0]] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    got = {r.doc_id: r for r in pii.pii_digest(pii.find_pii(spark.createDataFrame(rows(texts), SCHEMA).repartition(3))).collect()}
    for i, t in enumerate(texts):
        want = brute.pii_base(t)
        assert got[i].base_sha256 == brute.digest(want), t
        spans = got[i].spans.split(",")
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(spans)
    assert pii.find_pii(empty).count() == 0


def test_pii_plan_is_native(documents):
    plan = pii.find_pii(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_languages(spark, odd, empty, documents):
    model = languages.train(documents.filter(~languages.held_out(F.col("doc_id"))))
    assert model.languages == ["de", "en", "es", "fr"]
    found = languages.identify(documents, model).withColumn("held_out", languages.held_out(F.col("doc_id")))
    right = found.join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.head()[0] > 0.95
    de, fr = ([r.text for r in documents.filter(f"lang = '{x}' AND n_chars > 600").limit(2).collect()] for x in ("de", "fr"))
    _, _, parts = model.predict((de[0][:900] + " " + fr[0][:500]).encode())
    assert [p[0] for p in parts] == ["de", "fr"] and sum(p[1] for p in parts) == pytest.approx(1)
    got = {r.doc_id: r for r in languages.identify(odd[1], model).collect()}
    for i, t in enumerate(r[3] for r in odd[0][:-2]):
        letter = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not letter) and 0 <= got[i].score <= 1 and (letter or got[i].score == 0)
    kept = languages.keep_identified(odd[1], model)
    assert kept.columns == odd[1].columns and kept.count() == sum(any(c.isalpha() for c in r[3] or "") for r in odd[0])
    assert languages.identify(empty, model).count() == 0
    assert {r.lang_pred for r in languages.identify(odd[1], languages.train(empty)).collect()} == {"und"}


def test_fold_rule(documents):
    got = documents.select("doc_id", languages.held_out(F.col("doc_id")).alias("a"), language_model.held_out(F.col("doc_id")).alias("b")).collect()
    assert all((r.a, r.b) == (brute.fold(r.doc_id, 5), brute.fold(r.doc_id, 10)) for r in got)


def test_language_model(spark, odd, empty, documents):
    docs = documents.select("doc_id", "text").unionByName(odd[1].select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    data = [tuple(r) for r in docs.collect()]
    training = ~language_model.held_out(F.col("doc_id"))
    got = sorted(language_model.score_texts(docs, training).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(((str(i), *w) for (i, _), w in zip(data, brute.base_scores(data))), key=lambda w: w[:2])
    for r, (i, n, known, total, base) in zip(got, want, strict=True):
        assert (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) == (i, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    assert language_model.score_texts(empty, F.lit(True)).count() == 0
    alone = language_model.score_texts(odd[1], F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)


def test_joined_counts_equal_the_head(spark, documents, monkeypatch):
    whole = pairs(language_model.score_texts(documents, F.lit(True)), "doc_id", "n_known", "base_score")
    monkeypatch.setattr(language_model, "FREQUENT", 20)
    monkeypatch.setattr(language_model.vocabulary, "__defaults__", (50,))
    tail = pairs(language_model.score_texts(documents, F.lit(True)), "doc_id", "n_known", "base_score")
    for a, b in zip(whole, tail, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9)


def test_model_probabilities_add_up_to_one():
    import numpy as np

    pairs_ = np.random.default_rng(1).integers(0, 50, (31, 30)).astype(float)
    logs = language_model.train_log_bilinear(pairs_, steps=150)
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)
    p = pairs_ / pairs_.sum()
    prior = p.sum(0)
    assert (p * logs).sum() > (p * np.log(prior)).sum()


def test_packing_matches_trying_every_bin():
    rng = random.Random(6)
    pieces = sorted(((rng.randint(0, 100), 1 << rng.randrange(6), 1 << rng.randrange(40)) for _ in range(600)), reverse=True)
    got, want = packing.best_fit(pieces, 100), brute.best_fit(pieces, 100)
    bins = {}
    for (n, s, c), (b, at) in zip(pieces, got):
        bins.setdefault(b, []).append((at, n, s, c))
    for rows_ in bins.values():
        assert sum(r[1] for r in rows_) <= 100 and len({r[2] for r in rows_}) == len({r[3] for r in rows_}) == len(rows_)
        assert all(a[0] + a[1] == b[0] for a, b in zip(rows_, rows_[1:]))
    assert got == want


def test_repeated_rows_are_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 64)
    docs = spark.createDataFrame([(None, "the same words", None)] * 500 + [(7, "x y", "s")], "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=8, group_rows=50).collect()
    sizes = {}
    for r in got:
        group = r.bin_id.split(":")[0]
        sizes[group] = sizes.get(group, 0) + 1
    assert len(got) == 501 and len(sizes) == 11 and max(sizes.values()) < 100


def test_packing_keeps_every_token(spark, odd, empty):
    docs = odd[1]
    got = packing.pack(docs, capacity=64, group_rows=40).collect()
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for r in odd[0]:
        want[r[1]] = want.get(r[1], 0) + len(brute.space_words(r[3]))
    assert n == want
    by_id = {r[1]: r for r in odd[0]}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        spans = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in b)
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == c[0] for a, c in zip(spans, spans[1:]))
        sources = [by_id[r.doc_id][5] for r in b if by_id[r.doc_id][5]]
        texts = [by_id[r.doc_id][3] for r in b if by_id[r.doc_id][3] is not None]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    assert packing.pack(empty).count() == 0
