"""The exact neighbour search measures few points for a query, however large its class is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.hashing import HASH_BITS, seeded_hash
from flowsieve.operators import balance
from flowsieve.operators.balance import nearest_in_class


def brute(rows, k=5):
    """{id: [(distance, neighbour)]} within a class, of the points with finite squares."""
    good = [(c, np.array(v, dtype=float), i) for c, v, i, _, _ in rows if np.isfinite(np.square(np.array(v, dtype=float)).sum())]
    want = {}
    for c in {c for c, _, _ in good}:
        ids = np.array([i for k_, _, i in good if k_ == c])
        x = np.stack([v for k_, v, _ in good if k_ == c])
        for i, v in zip(ids, x):
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            want[int(i)] = [(float(d[j]), int(ids[j])) for j in order]
    return want


@pytest.mark.parametrize("block_rows", [8, 40])
def test_many_cells_and_lanes_equal_brute_force(spark, block_rows, monkeypatch):
    """Grids with ties, a constant and a rare axis, points without numbers, a class without a name, few that ask."""
    monkeypatch.setattr(balance, "ASKING_BLOCKS", 1)
    monkeypatch.setattr(balance, "LEAF_ROWS", 8)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        v = [float(i % 9), float(rng.integers(0, 12)), 1.0, float(i % 50 == 0), float(rng.exponential())]
        v = [float("nan"), *v[1:]] if i == 500 else [float("inf"), *v[1:]] if i == 501 else [1e200, *v[1:]] if i == 502 else v
        rows.append((None if i % 4 == 0 else "a", v, i, 1, i % 3 != 1))
    df = spark.createDataFrame(rows, "c string, v array<double>, id long, copies long, asks boolean")
    got = {}
    for r in nearest_in_class(df, 5, block_rows=block_rows).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    want = {i: w for i, w in brute(rows).items() if i % 3 != 1}
    assert got.keys() == want.keys()
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], rtol=0, atol=1e-12)


def test_a_part_of_a_hashed_split_is_cut_into_cells(spark, monkeypatch):
    """Only a few cells are searched for a point, also where all ids lie above a cut of their seeded hash."""
    written, materialise = {}, balance.materialise
    monkeypatch.setattr(balance, "materialise", lambda df, name: written.setdefault(name, materialise(df, name)))
    part = spark.range(20_000).filter(seeded_hash(["id"], 42) > (1 << HASH_BITS) // 5)
    v = F.array(*[F.rand(seed) for seed in (1, 2, 3)])
    df = part.select(F.lit("a").alias("c"), v.alias("v"), "id", F.lit(1).cast("long").alias("copies"), F.lit(True).alias("asks"))
    balance.nearest_in_class(materialise(df, "cell-points"), 5, block_rows=200)
    boxes = written["knn-cell-boxes"].agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("blocks")).first()
    assert boxes.n >= 80 and boxes.blocks <= 3
    assert written["knn-searches"].agg(F.avg(F.size("hits"))).first()[0] < 8


def test_work_of_a_query_does_not_grow_with_the_block(monkeypatch):
    pairs, measure = [], balance._nearest_pairs
    monkeypatch.setattr(balance, "_nearest_pairs", lambda q, qid, x, *rest: pairs.append(len(q) * len(x)) or measure(q, qid, x, *rest))
    cost = []
    for n in (4096, 32_768):
        x, ids = np.random.default_rng(3).random((n, 3)), np.arange(n)
        pairs.clear()
        row, col, d = balance._nearest_in_leaves(x[:500], ids[:500], x, ids, 5)
        cost.append(sum(pairs) / 500)
        assert (np.bincount(row) == 5).all()
        far = np.sqrt(((x - x[499]) ** 2).sum(axis=1))
        assert col[row == 499].tolist() == [j for j in np.argsort(far, kind="stable") if j != 499][:5]
    assert cost[1] < 1.25 * cost[0] < 4096
