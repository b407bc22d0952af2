"""Block-wise running sums, quantiles, neighbours and splits against brute force, hot groups included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.values import ordered_bits
from flowsieve.operators.balance import distinct_points, hashed_neighbours, nearest_in_class, synthetic_rows
from flowsieve.operators.encode import class_list, encode_label
from flowsieve.operators.evaluate import auc_by_class, roc_points
from flowsieve.operators.learn import with_class_weight
from flowsieve.operators import running
from flowsieve.operators.running import exact_quantiles, running_sums
from flowsieve.operators.sample import mark_stratified, stratified_quota, stratified_split


def test_running_sums_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"p{i % 5}", int(o), int(v)) for i, (o, v) in enumerate(zip(rng.permutation(400), rng.integers(0, 9, 400)))]
    df = spark.createDataFrame(rows, "p string, o long, v long")
    got = {(r.p, r.o): r.run_v for r in running_sums(df, ["p"], "o", ["v"], block_rows=20).collect()}
    assert len(got) == 400
    for p, o, _ in rows:
        assert got[p, o] == sum(v for q, x, v in rows if q == p and x <= o)


@pytest.mark.parametrize("rank_rows", [0, 7, 1_000_000])
def test_exact_quantiles(spark, rank_rows):
    values = [0.0] * 40 + np.random.default_rng(2).normal(size=61).tolist() + [float("inf"), None, float("nan")]
    values += [-0.0, 5e-324, -2.5e-310, 1.7e308, -1.7e308, 4.0, 8.0, 7.999999999999999, 1e-300]
    df = spark.createDataFrame([(v, None) for v in values], "x double, y double")
    finite = [v for v in values if v is not None and np.isfinite(v)]
    probes = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.p: r.value for r in exact_quantiles(df, ["x", "y"], probes, rank_rows).collect()}
    assert set(got) == set(probes)
    for p in probes:
        assert got[p] == pytest.approx(float(np.quantile(finite, p)))


@pytest.mark.parametrize("margin", [0.0, 0.02, 0.5])
def test_quantiles_with_sketches_of_any_kind(spark, monkeypatch, margin):
    """Ranges that are too narrow, right, or overlap; ties that hold a third of all values."""
    monkeypatch.setattr(running, "MARGIN", margin)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.full(3_000, 2.5), rng.normal(size=6_001)]).tolist()
    df = spark.createDataFrame([(a, float(i % 4)) for i, a in enumerate(x)], "x double, y double").repartition(5)
    probes = [0.0, 0.01, 0.33, 0.5, 0.77, 0.999, 1.0]
    got = {(r.name, r.p): r.value for r in exact_quantiles(df, ["x", "y"], probes, 50).collect()}
    for name, values in (("x", x), ("y", [float(i % 4) for i in range(len(x))])):
        for p in probes:
            assert got[name, p] == pytest.approx(float(np.quantile(values, p)))


def test_ordered_bits_keep_the_order(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-320, 300, 300), 2.0 ** np.arange(-1074, 1024, 7), [0.0, 5e-324, 1.7976931348623157e308]])
    values = np.unique(np.concatenate([values, -values, np.nextafter(values, 0)]))
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", ordered_bits(F.col("x")).alias("b")).collect()
    bits = [r.b for r in sorted(rows, key=lambda r: r.x)]
    assert all(a < b for a, b in zip(bits, bits[1:]))


def test_auc_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(("a", "b")[i % 2], float(round(s, 2)), bool(y)) for i, (s, y) in enumerate(zip(rng.random(300), rng.random(300) < 0.4))]
    df = spark.createDataFrame(rows, "class string, score double, positive boolean")
    got = {r["class"]: r.auc for r in auc_by_class(roc_points(df, block_rows=10)).collect()}
    for c in ("a", "b"):
        pos = [s for k, s, y in rows if k == c and y]
        neg = [s for k, s, y in rows if k == c and not y]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[c] == pytest.approx(wins / (len(pos) * len(neg)))


def points(spark, n=240, copies=80, dims=3, seed=4):
    """Two classes; a third of all rows are copies of one point, a tenth of another."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=dims) * (1 + i % 3) if i >= copies else np.ones(dims)
        if copies <= i < copies + 24:
            x = np.full(dims, 5.0)
        rows.append((i, "m" if i % 5 else "s", *[float(v) for v in x]))
    schema = "id long, label string, " + ", ".join(f"x{i} double" for i in range(dims))
    return rows, spark.createDataFrame(rows, schema), [f"x{i}" for i in range(dims)]


@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_neighbours_equal_brute_force(spark, block_rows):
    rows, df, axes = points(spark)
    distinct = {}
    for i, c, *x in rows:
        distinct.setdefault((c, tuple(x)), i)
    near = nearest_in_class(distinct_points(df, "label", "id", axes), 5, block_rows=block_rows)
    got = {}
    for r in near.collect():
        got.setdefault((r.c, r.id), {})[r["rank"]] = (r.neighbour, r.distance)
    assert len(got) == len(distinct)
    for (c, x), i in distinct.items():
        want = sorted(
            (float(np.linalg.norm(np.array(x) - np.array(y))), j) for (k, y), j in distinct.items() if k == c and j != i
        )[:5]
        mine = [got[c, i][r] for r in range(1, 6)]
        assert [round(d, 9) for _, d in mine] == [round(d, 9) for d, _ in want]
        assert [n for n, _ in mine] == [j for _, j in want]


def clusters(spark, n=3000, dims=12, seed=8):
    """Three classes of unequal size around common centres; one class has no name."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dims)) * 3
    rows = [(i, [None, "a", "a", "a", "b"][i % 5], [float(x) for x in centres[i % 60] + rng.normal(size=dims) * 0.4]) for i in range(n)]
    return rows, spark.createDataFrame([(c, v, i, 1, i % 2 == 0) for i, c, v in rows], "c string, v array<double>, id long, copies long, asks boolean")


def test_hashed_neighbours_find_most_and_enough(spark):
    rows, df = clusters(spark)
    want = {(r.id, r.neighbour): r.distance for r in nearest_in_class(df, 5, block_rows=200).collect()}
    got = {(r.id, r.neighbour): r.distance for r in hashed_neighbours(df, 5, block_rows=200).collect()}
    assert len(got) == len(want) == 5 * 1500
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    v = {i: np.array(x) for i, _, x in rows}
    assert all(abs(d - np.linalg.norm(v[a] - v[b])) < 1e-9 for (a, b), d in got.items())
    tiny = df.filter("id < 23")
    assert hashed_neighbours(tiny, 5, block_rows=4).groupBy("id").count().filter("count < 3").isEmpty()


def test_synthetic_rows_with_hashed_neighbours(spark):
    rows, df, axes = points(spark)
    made = synthetic_rows(df, "label", "id", axes, {"s": 131, "m": 7}, block_rows=16, neighbours=hashed_neighbours)
    assert {r.label: r["count"] for r in made.groupBy("label").count().collect()} == {"s": 131, "m": 7}


def test_synthetic_rows_are_exact_in_number_and_between_neighbours(spark):
    rows, df, axes = points(spark)
    made = synthetic_rows(df, "label", "id", axes, {"s": 131, "m": 7}, block_rows=16).collect()
    assert sum(r.label == "s" for r in made) == 131 and sum(r.label == "m" for r in made) == 7
    at = {i: (c, np.array(x)) for i, c, *x in rows}
    for r in made:
        (c, x), (k, y) = at[r.seed_id], at[r.neighbour]
        assert c == k == r.label and 0 <= r.gap < 1
        assert np.allclose([r[a] for a in axes], x + r.gap * (y - x))


def test_too_small_class_is_an_error(spark):
    _, df, axes = points(spark)
    with pytest.raises(ValueError):
        synthetic_rows(df.filter("id % 5 > 0 or id < 20"), "label", "id", axes, {"s": 3})


def test_quota_sums_to_total():
    quota = stratified_quota({"a": 83, "b": 10, "c": 7}, 21)
    assert sum(quota.values()) == 21 and quota == {"a": 17, "b": 2, "c": 2}


def test_split_is_exact_stable_and_disjoint(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("label"))
    train, test = stratified_split(df, "label", ["id"], 0.2, seed=7)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert len(b) == 201 and not a & b and len(a | b) == 1003
    small = mark_stratified(df, "label", ["id"], 0.2, seed=7, rank_rows=5).filter("picked")
    assert {r.id for r in small.collect()} == b
    again = stratified_split(df.repartition(13), "label", ["id"], 0.2, seed=7)[1]
    assert {r.id for r in again.collect()} == b
    assert {r.id for r in stratified_split(df, "label", ["id"], 0.2, seed=8)[1].collect()} != b


def test_marks_per_class_numbers(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("label"))
    marked = mark_stratified(df, "label", ["id"], {"0": 3, "1": 500}).filter("picked").groupBy("label").count()
    assert {r.label: r["count"] for r in marked.collect()} == {"0": 3, "1": 50}
    assert mark_stratified(df, "label", ["id"], {"0": 0}).filter("picked").count() == 0


def test_splits_with_many_classes(spark):
    """1,500 classes: what is known of each is a joined table, not an expression."""
    rows = spark.range(9_000).select(F.col("id"), F.concat(F.lit("c"), (F.col("id") % 1500).cast("string")).alias("label"))
    train, test = stratified_split(rows, "label", ["id"], 0.25)
    assert (train.count(), test.count()) == (6_750, 2_250)
    sizes = {r["count"] for r in test.groupBy("label").count().collect()}
    assert sizes == {1, 2}
    weighed = with_class_weight(rows.union(spark.createDataFrame([(9_999, "c0")], rows.schema)), "label")
    got = {r.label: r.weight__ for r in weighed.filter("label IN ('c0', 'c1')").collect()}
    assert got["c0"] == pytest.approx(9_001 / (1500 * 7)) and got["c1"] == pytest.approx(9_001 / (1500 * 6))
    classes = class_list(rows, "label")
    assert len(classes) == 1500 and encode_label(rows, classes, "label").filter("label_index IS NULL").count() == 0
