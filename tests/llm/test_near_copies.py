"""Clusters of near copies against all pairs, and their bins."""

import random

import numpy as np
import pytest

from flowsieve.llm import near_copies
from flowsieve.llm import queries as numbered
from tests.llm import brute


def shingles(text):
    w = brute.space_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted():
    """Texts with copies that differ in one character or a few words, chains of them, short, empty and NULL ones."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3_000)}"
    texts = [None, None, "", "", " ", "one two", "one two", "one three", "one two three four five"]
    for n in (30, 60, 90, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(6):
                base = list(base)
                for _ in range(rng.choice((1, 1, 2, 4))):
                    base[rng.randrange(n)] = word()
                texts.append(" ".join(base))
    base = [word() for _ in range(80)]
    texts += [" ".join(base), " ".join(base)[:-1] + "X"]
    return [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(None, texts[-1], "t"), (3, texts[-1], "u")]


def test_near_copies_never_share_a_bin(spark, tmp_path):
    data = planted()
    path = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    sets = [shingles(t) for _, t, _ in data]
    linked = lambda i, j: bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root = brute.groups(len(data), linked)
    got = near_copies.near_copy_clusters(spark.read.parquet(f"{path}/documents.parquet")).collect()
    cluster = {r.source: r.cluster for r in got}
    assert len(got) == len(data) and [cluster["s0"], cluster["s1"]] == [None, None] and cluster["s2"] == cluster["s3"] != cluster["s4"]
    wordy = [i for i, s in enumerate(sets) if s]
    for i in wordy:
        for j in wordy:
            assert (cluster[data[i][2]] == cluster[data[j][2]]) == (root[i] == root[j])
    bins = {}
    for r in numbered.op9_best_fit_packing(spark, path).collect():
        if r.doc_id is not None and r.doc_id != 3:
            bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert sum(map(len, bins.values())) == len(data) - 3
    pairs = [(i, j) for b in bins.values() for i in b for j in b if i < j]
    assert pairs and not any(linked(i, j) for i, j in pairs)


def varied(count, seed, words=60, most=16):
    """Copies of one text with up to ``most`` words changed: mutual likeness from 0.3 to 1."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(count):
        text = list(base)
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def clusters_of(spark, texts):
    df = spark.createDataFrame([(i, t, "s", 9, "k") for i, t in enumerate(texts)], "doc_id long, text string, source string, size int, key string")
    return {r.doc_id: r.cluster for r in near_copies.near_copy_clusters(df.repartition(4)).collect()}


def check(texts, got):
    sets = [shingles(t) for t in texts]
    linked = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root = brute.groups(len(texts), linked)
    names = {}
    for i, r in enumerate(root):
        assert names.setdefault(r, got[i]) == got[i]
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("rows, size", [(65_536, 32 << 20), (40, 20_000)])
def test_one_group_between_half_alike_and_alike(spark, monkeypatch, rows, size):
    """Whole, and cut into many blocks."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", size)
    texts = varied(400, 3, most=6)
    check(texts, clusters_of(spark, texts))


def test_links_of_a_group_are_a_forest_and_few_pairs_are_compared(monkeypatch):
    texts = varied(2_000, 5, words=120, most=8)
    sets = sorted({s.tobytes() for s in (near_copies.shingle_set(t.encode().split()) for t in texts)})
    sets = [np.frombuffer(s, np.uint64) for s in sets]
    keys, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(map(near_copies.sketch_bits, sets)), np.uint64).reshape(len(sets), -1)
    assert len(list(near_copies.possible_links(keys, sizes, bits))) < len(sets)
    compared, plain = [], near_copies._shared
    monkeypatch.setattr(near_copies, "_shared", lambda a, b: compared.append(1) or plain(a, b))
    links = list(near_copies.exact_links(keys, sizes, bits, sets))
    assert len(links) < len(sets) and len(compared) < 0.1 * len(sets) ** 2 / 2
    for a, b in links[:200]:
        assert 5 * plain(sets[a], sets[b]) >= 4 * (len(sets[a]) + len(sets[b]) - plain(sets[a], sets[b]))


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    for n in (4, 25, 400):
        for _ in range(30):
            values = rng.permutation(np.unique(rng.integers(0, 1 << 63, 10 * n, dtype=np.uint64)))
            parts = [np.sort(np.concatenate([values[: 8 * n], values[a * n : (a + 1) * n]])) for a in (8, 9)]
            bits = np.frombuffer(b"".join(map(near_copies.sketch_bits, parts)), np.uint64).reshape(2, -1)
            assert 5 * near_copies._shared(*parts) == 4 * 10 * n
            assert near_copies._near(len(parts[0]), bits[0], np.array([len(parts[1])]), bits[1:])[0]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert near_copies.near_copy_clusters(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "a"), (None, long + " more", "b"), (1, long, "a"), (2, None, None), (2, "", None)]
    got = near_copies.near_copy_clusters(spark.createDataFrame(rows, empty.schema)).collect()
    assert len(got) == 5 and sorted(r.n for r in got) == [0, 0, 60_000, 60_000, 60_001]
    assert len({r.cluster for r in got if r.n}) == 1


def test_filter_keeps_all_that_is_asked(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FILTER_BITS", 1 << 10)
    values = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 20_000)
    asked = spark.createDataFrame([(int(v),) for v in values[:50]], "hash long")
    kept = near_copies.Asked(asked, "hash").among(values)
    assert kept[:50].all() and kept.sum() < 2_000
    assert not near_copies.Asked(asked.limit(0), "hash").among(values).any()
