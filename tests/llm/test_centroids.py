"""Centroid clusters against plain Lloyd rounds in unbounded integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import centroids
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string"


def rows(vectors, first=0):
    return [(first + i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in enumerate(vectors)]


def results(df, **options):
    placed, last = centroids.cluster_vectors(df, **options)
    return [tuple(r) for r in centroids.cluster_digest(placed, last).collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_search_is_exact_and_rejects():
    rng = np.random.default_rng(5)
    means = rng.integers(-400, 400, (300, 1))
    index = centroids.Centroids((means + rng.integers(-300, 300, (300, 16))).tolist() + [[0] * 16, [0] * 16])
    points = rng.integers(-400, 400, (2_000, 1)) + rng.integers(-300, 300, (2_000, 16))
    points = np.concatenate([points, np.array(index.rows[:50]), np.zeros((3, 16), np.int64)])
    number, distance = index.nearest(points)
    gaps = ((points[:, None, :] - np.array(index.rows)[None]) ** 2).sum(2)
    assert (number == gaps.argmin(1)).all() and (distance == gaps.min(1)).all()
    assert (number[-3:] == 300).all()
    assert index.compared < 0.5 * gaps.size
    for p in points[:20].tolist():
        assert index.nearest_wide(p) == (brute.nearest_row(index.rows, p))


def test_search_at_the_edge_of_the_narrow_range():
    big = centroids.NARROW
    index = centroids.Centroids([[big] * 1024, [-big] * 1024, [big] * 1023 + [big - 1]])
    number, distance = index.nearest(np.array([[big] * 1024, [-big] * 1024, [big] * 1023 + [big - 1]], np.int64))
    assert number.tolist() == [0, 1, 2] and distance.tolist() == [0, 0, 0]
    assert index.nearest(np.full((1, 1024), -big))[1].tolist() == [0]


def test_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(5)
    data = [(r.vec_id, r.embedding) for r in vectors.collect()]
    same(results(vectors), brute.clusters(data))


@pytest.mark.parametrize("k, rounds", [(1, 3), (3, 0), (5, 10)])
def test_odd_vectors(spark, k, rounds):
    good = [[1, 2, 3], [1, 2, 3], [0, 0, 0], [-0.0004, 5, 9], [7, 7, 7], [7, 7, 8], [1e-30, -1e-30, 0.5], [-3.25, 2, 1], [100, -100, 0]]
    bad = [None, [], [1, 2], [1, 2, 3, 4], [1, None, 3], [1, float("nan"), 3], [float("inf"), 1, 1], [None] * 3]
    data = rows(good) + rows(bad, 100) + [(None, [2.0, 2.0, 2.0], 0, None)] * 2 + [(3, [4.0, 4.0, 4.0], 0, "")] + rows(good)[4:6]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = brute.clusters([(r[0], r[1]) for r in data], 3, k, rounds)
    assert len(want) == len(good) + 5
    same(results(df, dim=3, k=k, rounds=rounds), want)
    same(results(df.withColumn("embedding", F.col("embedding").cast("array<float>")), dim=3, k=k, rounds=rounds), want)


def test_huge_components_and_rounding_of_negative_means(spark):
    data = rows([[1e300, 1.0], [1.1e300, 1.0], [-5.5, 0.001], [-2.0, -0.001], [3e6, 2.0], [1.7e308, 0.0], [-1.7e308, 0.0]])
    df = spark.createDataFrame(data, SCHEMA)
    want = brute.clusters([(r[0], r[1]) for r in data], 2, 3, 4)
    same(results(df, dim=2, k=3, rounds=4), want)
    assert any(w[2] is None for w in want) and all(w[4] is None for w in want)
    assert centroids.whole(1e300, 1024) == int(1e300) * 1024 and centroids.whole(-0.0001, 1024) == -1


def test_few_none_and_other_kinds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert results(empty) == [] and centroids.cluster_vectors(empty)[0].columns == ["vec_id", "cluster", "distance"]
    two = spark.createDataFrame([("a", [1, 2]), ("b", [5, 6])], "vec_id string, embedding array<int>")
    same(results(two, dim=2), brute.clusters([("a", [1, 2]), ("b", [5, 6])], 2))
    assert results(two) == []
    with pytest.raises(ValueError):
        centroids.cluster_vectors(two, k=0)


def test_many_narrow_vectors_in_one_cluster(spark):
    df = spark.range(60_000).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") % (5 + j)).cast("float") for j in range(4)]).alias("embedding"))
    placed, last = centroids.cluster_vectors(df, dim=4, k=1, rounds=1)
    assert last == [[math.floor(sum(1024 * (i % (5 + j)) for i in range(60_000)) / 60_000) for j in range(4)]]
    assert placed.count() == 60_000
    names = centroids.cluster_digest(placed, last).select("centroid_sha256").distinct().collect()
    assert [r[0] for r in names] == [hashlib.sha256(",".join(map(str, last[0])).encode()).hexdigest()]
