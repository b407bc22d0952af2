"""Threat totals, class breakdowns, minute and session rollups, running accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.bands import minute_of
from flowsieve.functions.values import all_rows, percent, ratio
from flowsieve.operators.running import BLOCK_ROWS, running_sums
from flowsieve.schema import BENIGN



def level_counts(level: str = "threat_level") -> list[Column]:
    c = F.col(level)
    return [
        all_rows().alias("total"),
        F.count_if(c == "RED").alias("threats"),
        F.count_if(c == "YELLOW").alias("suspicious"),
        F.count_if(c == "GREEN").alias("clean"),
    ]


def threat_totals(df: DataFrame, level: str = "threat_level") -> DataFrame:
    total = F.col("total")
    return df.agg(*level_counts(level)).select(
        "*",
        F.round(percent(F.col("threats"), total), 2).alias("threat_pct"),
        F.round(percent(F.col("suspicious"), total), 2).alias("suspicious_pct"),
        F.round(percent(F.col("clean"), total), 2).alias("clean_pct"),
    )


def class_precision(df: DataFrame, predicted: str = "predicted_class", actual: str = "actual_label") -> DataFrame:
    """Per predicted class: rows, labelled rows, correct rows and their share in percent."""
    hit = F.col(predicted) == F.col(actual)
    return (
        df.groupBy(F.col(predicted).alias("class"))
        .agg(all_rows().alias("predicted"), F.count(actual).alias("labelled"), F.count_if(hit).alias("correct"))
        .withColumn("precision_pct", percent(F.col("correct"), F.col("labelled")))
    )


def batch_accuracy(df: DataFrame, predicted: str = "predicted_class", actual: str = "actual_label") -> DataFrame:
    """Correct rows over all rows, unlabelled ones included."""
    return df.agg(all_rows().alias("total"), F.count_if(F.col(predicted) == F.col(actual)).alias("correct")).withColumn(
        "accuracy_pct", percent(F.col("correct"), F.col("total"))
    )


def class_breakdown(df: DataFrame, predicted: str = "predicted_class") -> DataFrame:
    counts = df.groupBy(F.col(predicted).alias("class")).agg(all_rows().alias("n"))
    share = percent(F.col("n"), F.sum("n").over(W.partitionBy()))
    return counts.withColumn("pct", share).orderBy(F.desc("n"), "class")


def attack_breakdown(df: DataFrame, predicted: str = "predicted_class", benign: str = BENIGN) -> DataFrame:
    return class_breakdown(df, predicted).filter(F.col("class") != benign).select("class", "n")


def replay_estimate(df: DataFrame, flows_per_second: float, predicted: str = "predicted_class") -> DataFrame:
    """Benign and threat counts and the seconds a replay at a given rate would take."""
    return df.agg(
        all_rows().alias("total"),
        F.count_if(F.col(predicted) == BENIGN).alias("benign"),
        F.count_if(F.col(predicted) != BENIGN).alias("threats"),
        F.round(all_rows() / F.lit(float(max(flows_per_second, 1)))).cast("long").alias("estimated_seconds"),
    )


def minute_rollup(
    df: DataFrame,
    ts: str,
    session: list[str] = (),
    level: str = "threat_level",
    predicted: str = "predicted_class",
    actual: str | None = None,
) -> DataFrame:
    """Flows, levels, class counts and accuracy, over labelled flows, of each minute (and session).

    Rows are counted by (minute, class) first, so a busy minute is combined map-side and the class map
    is built from a handful of counts.
    """
    hit = F.col(predicted) == F.col(actual) if actual else F.lit(None).cast("boolean")
    keys = [*session, "minute"]
    by_class = (
        df.withColumn("minute", minute_of(F.col(ts)))
        .groupBy(*keys, F.col(predicted).alias("class"))
        .agg(*level_counts(level), F.count_if(hit).alias("correct"), F.count(hit).alias("labelled"))
    )
    return by_class.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("total", "threats", "suspicious", "clean")],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "total")))).alias("by_class"),
        F.sum("correct").alias("correct"),
        F.sum("labelled").alias("labelled"),
        percent(F.sum("correct"), F.sum("labelled")).alias("accuracy_pct"),
    )


def session_summary(minutes: DataFrame, session: str) -> DataFrame:
    """Minute rows, one total for each session and one grand total, from a minute rollup."""
    return minutes.rollup(session, "minute").agg(
        *[F.sum(c).alias(c) for c in ("total", "threats", "suspicious", "clean", "correct", "labelled")],
        percent(F.sum("correct"), F.sum("labelled")).alias("accuracy_pct"),
        F.grouping_id().alias("level"),
    )


def binary_from_precision(precision: DataFrame, benign: str = BENIGN) -> DataFrame:
    """Binary matrix from per-class precision rows; NULL where a cell would be negative or benign is absent."""
    is_benign = F.lower("class") == benign.lower()
    tn = F.max(F.when(is_benign, F.col("correct")))
    fn = F.max(F.when(is_benign, F.col("predicted") - F.col("correct")))
    row = precision.agg(
        tn.alias("tn"), fn.alias("fn"), F.sum("correct").alias("hits"), F.sum("predicted").alias("total")
    ).select("tn", "fn", (F.col("hits") - F.col("tn")).alias("tp"), "total")
    row = row.withColumn("fp", F.col("total") - F.col("tn") - F.col("fn") - F.col("tp"))
    valid = (F.col("tp") >= 0) & (F.col("fp") >= 0)
    return row.select(*[F.when(valid, F.col(c)).alias(c) for c in ("tp", "tn", "fp", "fn")])


def running_accuracy(
    df: DataFrame,
    session: list[str],
    seq: str,
    predicted: str = "predicted_class",
    actual: str = "actual_label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Accuracy in percent after each result of a session, in the order of its sequence number."""
    hit = F.coalesce((F.col(predicted) == F.col(actual)).cast("long"), F.lit(0).cast("long"))
    hits = df.select(*session, seq, hit.alias("hit"), F.lit(1).cast("long").alias("one"))
    run = running_sums(hits, list(session), seq, ["hit", "one"], block_rows)
    return run.select(
        *session, seq, F.col("run_hit").alias("correct"), F.col("run_one").alias("seen"),
        (ratio(F.col("run_hit"), F.col("run_one")) * 100).alias("accuracy_pct"),
    )
