"""SimHash groups, components and neighbour search against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import simhash
from flowsieve.llm.collision_search import nearest
from flowsieve.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_anchors_cover_all_links():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    home = simhash.home_anchor(x)
    assert (np.bitwise_count(home ^ x) <= 1).all() and (simhash.home_anchor(home) == home).all()
    at, own = simhash.anchors(x)
    assert len(own) < 20 * len(x)
    near = {i: set(own[at == i].tolist()) for i in range(len(x))}
    for bit in range(32):
        rows, other = simhash.anchors(x ^ np.uint32(1 << bit))
        for i in range(len(x)):
            assert near[i] & set(other[rows == i].tolist())


def test_groups_without_all_pairs():
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps = list({f ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for f in fps for _ in range(12)})
    a = np.array(fps, np.uint64)
    links = list(simhash.group_links(a))
    assert len(links) < len(a)
    assert all((x ^ y).bit_count() <= 3 for x, y in links)
    place = {f: i for i, f in enumerate(fps)}
    linked = {frozenset((place[x], place[y])) for x, y in links}
    want = brute.groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = brute.groups(len(fps), lambda i, j: frozenset((i, j)) in linked)
    assert [want.index(w) for w in want] == [got.index(g) for g in got]


def test_linked_fingerprints_find_every_link(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for f in list(fps) for _ in range(4)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = components(simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)))
    root = {r.node: r.root for r in got.collect()}
    want = brute.groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for i, f in enumerate(signed):
        assert root.get(f, f) == min(signed[j] for j in range(len(fps)) if want[j] == want[i])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260, 259), (5, 5), (7, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 261)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("source", ["table", "odd"])
def test_fingerprint_groups(spark, source):
    if source == "table":
        data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    else:
        data = [(3, None), (1, ""), (2, " \n"), (None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (4, "w " * 60_000), (None, "alone here"), (5, "x"), (6, "X")]
    docs = spark.createDataFrame([(t, 1, i, 2) for i, t in data], "text string, fp int, doc_id long, root int")
    got = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.fingerprint_groups(docs).collect()], key=str)
    fps = [brute.fingerprint(t) for _, t in data]
    root = brute.groups(len(data), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {r: min((data[j][0] for j in range(len(data)) if root[j] == r and data[j][0] is not None), default=None) for r in root}
    assert got == sorted([(data[i][0], fps[i], least[root[i]]) for i in range(len(data))], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(least.values(), key=str)


def test_one_of_each_with_clashing_and_missing_ids(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(1, text(0), "a"), (1, text(1), "a"), (2, text(1), "b"), (None, text(2), "c"), (None, text(2), "c"), (None, text(3), "d"), (None, text(0), "e"), (3, None, "f"), (3, "", "f")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert sorted([tuple(r) for r in kept if r.doc_id != 3], key=str) == sorted([rows[0], rows[1], rows[3], rows[5]], key=str)
    assert [(r.doc_id, r.source) for r in kept if r.doc_id == 3] == [(3, "f")]


def test_empty_groups(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert simhash.fingerprint_groups(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def cosines(vectors, q):
    return (vectors * vectors[q]).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((vectors[q] ** 2).sum()))


def test_neighbours_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0, shard_rows=700).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    queries = np.flatnonzero(ids % 50 == 0)
    for q in queries:
        s = cosines(v, q)
        s[q] = -9
        best = np.lexsort((ids, -s))[:5]
        found = [got[ids[q]][k] for k in range(1, 6)]
        assert [x[1] for x in found] == sorted((x[1] for x in found), reverse=True)
        assert all(abs(s[np.searchsorted(ids, i)] - c) < 1e-12 for i, c in found)
        hits += len({ids[b] for b in best} & {i for i, _ in found})
    assert hits >= 0.9 * 5 * len(queries)


def test_neighbours_of_odd_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(1, 40)]
    odd = [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0])]
    short = [(0, [1.0, 0.0]), (210, [2.0, 0.0]), (211, [0.0, -1.0]), (None, [1.0, 0.0])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in same + odd + short + [(50, [1.0, 2.0, 3.0])]], "vec_id long, embedding array<double>, dim int, q int")
    got = {}
    for r in nearest(docs, F.col("vec_id") % 50 == 0, shard_rows=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 50]
    assert [x[:2] for x in sorted(got[50])] == [(k, k) for k in range(1, 6)]
    assert sorted(got[0]) == [(1, 210, 1.0), (2, 211, 0.0)]
    assert nearest(docs.limit(0), F.lit(True)).count() == 0
