"""Periodic runs against every lag tried by itself."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from flowsieve.llm import periodic
from flowsieve.llm.queries import op11_periodic_runs
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def sequences(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n, kinds = rng.randint(0, 110), rng.choice([1, 2, 2, 3, 5, 40])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            words = [words[min(n - 1, a + (i - a) % p)] if i >= a else w for i, w in enumerate(words)]
        yield words * rng.choice([1, 1, 2]) + words[: rng.randint(0, n)]


@pytest.mark.parametrize("least, repeats", [(12, 2), (2, 2), (5, 3), (21, 2)])
def test_runs_of_small_alphabets(least, repeats):
    total = 0
    for words in sequences(700, least):
        want = brute.runs(words, least, repeats)
        assert periodic.runs_of(words, least, repeats) == want
        total += len(want)
    assert total > 300
    with pytest.raises(ValueError):
        periodic.runs_of([], 12, 1)


def test_pieces_of_occurrences_do_not_matter(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 3)
    for words in sequences(300, 7):
        assert periodic.runs_of(words) == brute.runs(words)


def test_one_word_and_common_lines_take_time_in_proportion():
    begun = time.time()
    assert periodic.runs_of([b"a"] * 400_000) == [(0, 400_000, 1)]
    line = b"the quick brown fox jumps over the lazy dog and then".split()
    assert periodic.runs_of([w for i in range(20_000) for w in (*line, i)]) == []
    assert periodic.runs_of([i % 5_000 for i in range(200_000)]) == [(0, 200_000, 5_000)]
    assert time.time() - begun < 30


def digest(doc_id, text):
    words = brute.SPACE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute.runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha(listed), sha(" ".join(kept))


def test_query_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if len((t or "").split()) < 3_000]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert all(got[i] == digest(i, t) for i, t in docs) and len(docs) > 150
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "x", "a\xa0b " * 9, "Ab ab " * 9, "w " * 40_000, "é\x85\x0bé " * 20, "1 2 3 4 5 6 7 1 2 3 4 5 6 7"]
    rows = [(i, t, 3, "r", None) for i, t in enumerate(texts)] + [(None, "z " * 30, 3, "r", None)] * 2 + [(5, texts[5], 3, "r", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int, collapsed string, h int").repartition(3)
    found = periodic.run_digest(periodic.find_runs(periodic.with_repeated_tails(docs))).collect()
    rest = sorted(str(tuple(r)) for r in found if r.doc_id != 6)
    assert rest == sorted(str(digest(i, t)) for i, t, *_ in rows if i != 6)
    long = [r for r in found if r.doc_id == 6]
    assert [(r.n_runs, r.start, r.length, r.period) for r in long] == [(1, 0, 40_000, 1)]
    whole = periodic.find_runs(docs).filter("doc_id = 4").head()
    assert (whole.n_words, whole.collapsed, [tuple(r) for r in whole.runs]) == (9, "a\xa0b " * 8 + "a\xa0b", [])
    assert periodic.find_runs(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None)] * 2, "doc_id string, text string")
    assert [tuple(r)[1:5] for r in periodic.run_digest(periodic.find_runs(nothing)).collect()] == [(0, None, None, None)] * 2


def test_other_names_and_lengths(spark):
    docs = spark.createDataFrame([("k", "x y x y x z")], "key string, body string")
    got = periodic.find_runs(docs, "key", "body", min_length=4).head()
    assert got.doc_id == "k" and [tuple(r) for r in got.runs] == [(0, 5, 2)] and got.collapsed == "x y z"
    assert periodic.find_runs(docs, "key", "body").select(F.size("runs")).head()[0] == 0
