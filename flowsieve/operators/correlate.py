"""Pearson correlation of all numeric pairs, and what is read from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bands import correlation_band

SALTS = 64


def feature_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, f1, f2, n) for i < j, with the rows in which both features are finite: one scan, no join."""
    there = [F.abs(F.col(f"`{f}`").cast("double")) < F.lit(float("inf")) for f in features]
    pairs = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(features[i]).alias("f1"), F.lit(features[j]).alias("f2"),
            F.count_if(there[i] & there[j]).alias("n"),
        )
        for i in range(len(features))
        for j in range(i + 1, len(features))
    ]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def _moments(features: list[str], center: list[float]):
    """Per-partition sums over the rows where both columns of a pair are present."""
    shift = np.array(center)
    n = len(features)
    upper = np.triu_indices(n, 1)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(upper[0])))
        for batch in batches:
            block = batch.to_numpy(dtype=float) - shift
            present = np.isfinite(block)
            x = np.where(present, block, 0.0)
            m = present.astype(float)
            sums, squares = x.T @ m, (x * x).T @ m
            total += np.stack(
                [
                    (m.T @ m)[upper],
                    sums[upper],
                    sums.T[upper],
                    squares[upper],
                    squares.T[upper],
                    (x.T @ x)[upper],
                ]
            )
        yield pd.DataFrame(
            {"i": upper[0], "j": upper[1], **dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), total))}
        )

    return step


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, f1, f2, n, r) over the rows where both values are finite; r is NULL without variance.

    Each task reduces its rows to one row of sums for each pair with dense matrix products. The sums are added in two
    steps, first within salts and then over them, so that a pair is not one task's work however many tasks there are.
    Centring by the column means first keeps the sums of squares accurate.
    """
    finite = [
        F.when(F.abs(F.col(f"`{f}`").cast("double")) < F.lit(float("inf")), F.col(f"`{f}`").cast("double"))
        for f in features
    ]
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(finite)]).first()
    numeric = df.select(*[F.col(f"`{f}`").cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    parts = numeric.mapInPandas(
        _moments(features, list(means)),
        "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double",
    )
    added = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    salted = parts.groupBy("i", "j", (F.spark_partition_id() % SALTS).alias("salt")).agg(*added)
    sums = salted.groupBy("i", "j").agg(*added)
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.try_divide(F.col("sx"), n)
    vy = F.col("syy") - F.col("sy") * F.try_divide(F.col("sy"), n)
    cov = F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), n)
    tiny = F.lit(1e-12)
    varies = (vx > tiny * F.col("sxx")) & (vy > tiny * F.col("syy")) & (n > 1)
    names = F.array(*[F.lit(f) for f in features])
    return sums.select(
        "i",
        "j",
        names[F.col("i")].alias("f1"),
        names[F.col("j")].alias("f2"),
        n.cast("long").alias("n"),
        F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).alias("r"),
    )


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    def finite(f: str) -> Column:
        c = F.col(f"`{f}`").cast("double")
        return F.when(F.abs(c) < F.lit(float("inf")), c)

    entries = [F.struct(F.lit(f).alias("feature"), F.var_samp(finite(f)).alias("variance")) for f in features]
    return df.agg(F.array(*entries).alias("v")).select(F.inline("v"))


def top_variance(df: DataFrame, features: list[str], n: int = 30) -> DataFrame:
    return variances(df, features).orderBy(F.desc_nulls_last("variance"), "feature").limit(n)


def pairs_within(pairs: DataFrame, present: DataFrame, feature: str = "feature") -> DataFrame:
    """Pairs whose two features are in the given list."""
    keep = present.select(F.col(feature).alias("k"))
    return pairs.join(keep, pairs.f1 == keep.k, "left_semi").join(keep, pairs.f2 == keep.k, "left_semi")


def correlated_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs with abs(r) above the threshold, strongest first; r to nine digits, then by place."""
    strong = pairs.filter(F.abs("r") > threshold).withColumn("band", correlation_band(F.col("r")))
    return strong.orderBy(F.desc(F.round(F.abs("r"), 9)), "i", "j")


def strongest(pairs: DataFrame, sign: str, n: int = 10) -> DataFrame:
    """The n strongest pairs of a sign; what is equal to nine digits is in order of place, not of the last bits."""
    if sign == "positive":
        return pairs.filter(F.col("r") > 0).orderBy(F.desc(F.round("r", 9)), "i", "j").limit(n)
    return pairs.filter(F.col("r") < 0).orderBy(F.round("r", 9), "i", "j").limit(n)


def correlated_features_to_drop(pairs: DataFrame, threshold: float = 0.99) -> list[str]:
    """Greedy walk over the pairs at or above the threshold: the second of a pair goes, unless either is gone.

    The pairs are feature metadata, at most n(n-1)/2 rows.
    """
    chosen: set[str] = set()
    rows = pairs.filter(F.abs("r") >= threshold).select("i", "j", "f1", "f2").collect()
    for row in sorted(rows, key=lambda p: (p.j, p.i)):
        if not chosen & {row.f1, row.f2}:
            chosen.add(row.f2)
    return sorted(chosen)


def remaining_features(features: DataFrame, dropped: DataFrame) -> DataFrame:
    return features.join(dropped, "feature", "left_anti")
