"""Ranked classes and threat levels of one scored row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.schema import BENIGN, SUSPICIOUS_CONFIDENCE


def top_classes(probabilities: Column, classes: Sequence[str], k: int = 3) -> Column:
    """ARRAY<STRUCT<class, conf>>: the k likeliest classes, ties by class index."""
    names = F.array(*[F.lit(c) for c in classes])
    ranked = F.sort_array(
        F.transform(
            probabilities,
            lambda p, i: F.struct((-p).alias("order"), i.alias("idx"), names[i].alias("class"), p.alias("conf")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda r: F.struct(r["class"].alias("class"), r["conf"].alias("conf"))
    )


def pad_top(top: Column, k: int = 3) -> Column:
    """The same array with ('-', 0.0) appended up to k entries."""
    blank = F.struct(F.lit("-").alias("class"), F.lit(0.0).alias("conf"))
    return F.slice(F.concat(top, F.array_repeat(blank, k)), 1, k)


def nth_class(top: Column, n: int, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(top, F.lit(n))["class"], F.lit(default))


def nth_conf(top: Column, n: int) -> Column:
    return F.coalesce(F.try_element_at(top, F.lit(n))["conf"], F.lit(0.0))


def threat_level(top: Column, benign: str = BENIGN, threshold: float = SUSPICIOUS_CONFIDENCE) -> Column:
    """RED: the top class is an attack. YELLOW: the runner-up is one and likely enough. GREEN: neither."""
    runner = F.try_element_at(top, F.lit(2))
    return (
        F.when(nth_class(top, 1) != benign, "RED")
        .when((runner["class"] != benign) & (runner["conf"] >= threshold), "YELLOW")
        .otherwise("GREEN")
    )


def is_attack(prediction: str, benign: str = BENIGN) -> Column:
    return F.col(prediction) != benign
