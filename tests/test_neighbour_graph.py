"""The refined neighbour graph against exact neighbours."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.balance import nearest_in_class, synthetic_rows
from flowsieve.operators.neighbour_graph import neighbour_graph
from tests.test_blocks import clusters, points

SCHEMA = "c string, v array<double>, id long, copies long, asks boolean"


def pairs(df):
    return {(r.id, r.neighbour): (r.c, round(r.distance, 9), r.copies, r["rank"]) for r in df.collect()}


def cloud(spark, n, dims=8, axes=64, seed=3):
    """A class of ``n`` points near a curved sheet of ``dims`` dimensions."""
    rng = np.random.default_rng(seed)
    inner = rng.normal(size=(n, dims)) + rng.normal(size=(60, dims))[rng.integers(0, 60, n)] * 2
    x = inner @ rng.normal(size=(dims, axes)) / 3 + 0.05 * rng.normal(size=(n, axes))
    frame = pd.DataFrame({"c": "large", "v": list(x), "id": np.arange(n), "copies": 1, "asks": True})
    return x, spark.createDataFrame(frame, SCHEMA)


def test_graph_of_a_large_class(spark):
    n = 20_000
    x, df = cloud(spark, n)
    near = neighbour_graph(df, 5).cache()
    assert near.count() == 5 * n and near.groupBy("id").count().filter("count <> 5").isEmpty()
    got = {}
    for r in near.filter("id % 40 = 0").collect():
        got.setdefault(r.id, {})[r.neighbour] = r.distance
    hits = 0
    for i, mine in got.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert all(abs(d[j] - value) < 1e-9 for j, value in mine.items())
        d[i] = np.inf
        hits += len(mine.keys() & set(np.argsort(d, kind="stable")[:5].tolist()))
    assert len(got) == 500 and hits >= 0.95 * 2_500


def test_partitions_have_no_influence(spark):
    _, df = clusters(spark)
    one = pairs(neighbour_graph(df.coalesce(1), 5, run_rows=64))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        other = pairs(neighbour_graph(df.repartition(11, "v"), 5, run_rows=64))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    exact = pairs(nearest_in_class(df, 5))
    assert one == other and len(one) == len(exact)
    assert len(one.keys() & exact.keys()) >= 0.95 * len(exact)


@pytest.mark.parametrize("run_rows", [48, 4096])
def test_small_classes_are_exact(spark, run_rows):
    """Classes of one, two, seven and forty points, a NULL class, points that do not ask, points at one place."""
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for name, n in (("one", 1), ("two", 2), ("seven", 7), (None, 40), ("same", 30)):
        for _ in range(n):
            v = [0.0, 0.0] if name == "same" else rng.integers(0, 5, 2).astype(float).tolist()
            rows.append((name, v, i, 1 + i % 3, i % 4 > 0))
            i += 1
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert pairs(neighbour_graph(df, 5, run_rows=run_rows)) == pairs(nearest_in_class(df, 5))
    assert neighbour_graph(df.limit(0), 5).count() == 0


def test_a_point_that_all_others_are_near(spark):
    """A star: the centre is a neighbour of every point, and its reverse list stays bounded."""
    n = 2_000
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 256))
    x = x / np.linalg.norm(x, axis=1)[:, None] * 10
    x[0] = 0
    df = spark.createDataFrame(pd.DataFrame({"c": "s", "v": list(x), "id": np.arange(n), "copies": 1, "asks": True}), SCHEMA)
    near = neighbour_graph(df, 5, run_rows=128)
    assert near.filter("neighbour = 0 AND rank = 1").count() >= 0.95 * (n - 1)


def test_synthetic_rows_with_the_graph(spark):
    _, df, axes = points(spark)
    made = synthetic_rows(df, "label", "id", axes, {"s": 131, "m": 7}, block_rows=16, neighbours=neighbour_graph)
    assert {r.label: r["count"] for r in made.groupBy("label").count().collect()} == {"s": 131, "m": 7}
    assert made.filter(F.col("seed_id") == F.col("neighbour")).count() <= made.count()
