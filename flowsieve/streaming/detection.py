"""Scored streams: alerts, minute and session totals. Scoring itself is the batch code on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.values import percent
from flowsieve.operators.rollup import level_counts
from flowsieve.operators.score import Scorer


def score_stream(flows: DataFrame, scorer: Scorer, protocol: str = "Protocol") -> DataFrame:
    """Preparation and scoring of each micro-batch; stateless, so batches of any size give the same rows."""
    return scorer.score(flows, protocol)


def alerts(scored: DataFrame, level: str = "threat_level") -> DataFrame:
    """Only what needs attention; clean flows are counted by ``level_totals``."""
    return scored.filter(F.col(level).isin("RED", "YELLOW"))


def level_totals(scored: DataFrame, session: list[str] = (), level: str = "threat_level") -> DataFrame:
    """Running count of each level, for a session or for the whole run (update or complete mode)."""
    return scored.groupBy(*session, level).agg(F.count(F.lit(1)).alias("n"))


def class_totals(scored: DataFrame, session: list[str] = (), predicted: str = "predicted_class") -> DataFrame:
    return scored.groupBy(*session, F.col(predicted).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def minute_totals(
    scored: DataFrame,
    ts: str,
    lateness: str = "1 minute",
    session: list[str] = (),
    level: str = "threat_level",
    classes: Sequence[str] = (),
    predicted: str = "predicted_class",
    actual: str | None = None,
) -> DataFrame:
    """Tumbling minutes by event time. Rows later than the watermark are dropped and counted by the query.

    With ``classes`` there is a map of flows by predicted class, with ``actual`` the correct and the labelled flows and
    the accuracy in percent.

    The session, if any, is part of the group, and counts combine before the shuffle: a busy minute is
    one row for each input task.
    """
    timed = scored.withColumn("ts__", F.col(ts).cast("timestamp")).withWatermark("ts__", lateness)
    more, shown = [], []
    if classes:
        counts = [F.count_if(F.col(predicted) == c) for c in classes]
        more.append(F.create_map(*[x for c, n in zip(classes, counts) for x in (F.lit(c), n)]).alias("by_class"))
        shown.append("by_class")
    if actual:
        more += [F.count_if(F.col(predicted) == F.col(actual)).alias("correct"), F.count(actual).alias("labelled")]
        shown += ["correct", "labelled", percent(F.col("correct"), F.col("labelled")).alias("accuracy_pct")]
    grouped = timed.groupBy(*session, F.window("ts__", "1 minute").alias("w")).agg(*level_counts(level), *more)
    return grouped.select(*session, F.col("w.start").alias("minute"), "total", "threats", "suspicious", "clean", *shown)
