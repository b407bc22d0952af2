"""Passes of the exact quantiles: copies of a value need none, large ranges are read from what lies inside them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import running


def written(monkeypatch):
    names, write = [], running.materialise
    monkeypatch.setattr(running, "materialise", lambda df, name: names.append(name) or write(df, name))
    return names


def test_copies_of_a_value_are_not_ranked(spark, monkeypatch):
    """A value held by many more rows than are ranked at once is found without another pass."""
    names = written(monkeypatch)
    df = spark.range(20_000).select((F.col("id") % 4).cast("double").alias("x"))
    got = {r.p: r.value for r in running.exact_quantiles(df, ["x"], [0.1, 0.4, 0.9], 50).collect()}
    assert got == pytest.approx(dict(zip([0.1, 0.4, 0.9], np.quantile(np.arange(20_000) % 4, [0.1, 0.4, 0.9])))) and not names


def test_a_large_range_is_written_once(spark, monkeypatch):
    """Ranks among distinct values beside a heavy one: the passes over buckets read what lies inside the ranges."""
    names = written(monkeypatch)
    n = F.col("id")
    df = spark.range(40_000).select(F.when(n % 2 == 0, F.lit(-7.5)).otherwise(F.sin("id") * 1000).alias("x"))
    values, probes = [r.x for r in df.collect()], [0.0, 0.2, 0.2475, 0.5, 0.7462, 0.7478, 0.99, 1.0]
    got = {r.p: r.value for r in running.exact_quantiles(df, ["x"], probes, 20).collect()}
    assert names == ["quantile-ranges"]
    assert [got[p] for p in probes] == pytest.approx(np.quantile(values, probes).tolist())
