"""Model evaluation: confusion matrix, per-class and binary metrics, ROC, errors, search results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.values import all_rows, everything, percent, ratio
from flowsieve.operators.running import BLOCK_ROWS, exact_quantiles, running_sums
from flowsieve.operators.score import attack_score
from flowsieve.schema import BENIGN
from flowsieve.session import materialise


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """Mean, deviations, extremes and exact quartiles of the finite values of one column, in one row."""
    quartiles = exact_quantiles(df, [value], [0.25, 0.5, 0.75])

    def at(p: float) -> Column:
        return F.max(F.when(F.col("p") == p, F.col("value")))

    cuts = quartiles.groupBy("name").agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    c = F.col(f"`{value}`").cast("double")
    c = F.when(F.abs(c) < F.lit(float("inf")), c)
    moments = df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std_pop"),
        F.stddev_samp(c).alias("std_samp"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.count_if(c < 0.5).alias("below_half"),
    )
    both = moments.unionByName(cuts.drop("name"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def confidence_summary(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    row = five_numbers(df, confidence)
    return row.select(
        "mean", "median", F.col("std_pop").alias("std"), "min", "max", "q25", "q75",
        F.col("below_half").alias("low_confidence"),
        percent(F.col("below_half"), F.col("n")).alias("low_confidence_pct"),
    )


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The only pass over the rows; everything below reads these few counts. Rows without a label are left out."""
    return df.filter(F.col(actual).isNotNull()).groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(all_rows().alias("n"))


def confusion_matrix(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """A cell for each pair of the class list, zeros included, with the share of its actual class."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = (
        counts.agg(F.count(F.lit(1)).alias("cells"))
        .select(F.explode(names).alias("actual"))
        .select("actual", F.explode(names).alias("predicted"), F.lit(0).cast("long").alias("n"))
    )
    full = counts.unionByName(grid).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    return full.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy("actual"))))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that is actual or predicted."""
    one = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    sums = one.groupBy("s.class").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.predicted").alias("predicted"),
        (F.sum("hit") / 2).cast("long").alias("correct"),
    )
    precision = ratio(F.col("correct"), F.col("predicted"))
    recall = ratio(F.col("correct"), F.col("support"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    )


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages, best and worst class by F1 (ties to the smaller name)."""

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")

    return metrics.agg(
        ratio(F.sum("correct"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")],
        F.min(F.struct((-F.col("f1")).alias("o"), "class"))["class"].alias("best_class"),
        F.min(F.struct(F.col("f1").alias("o"), "class"))["class"].alias("worst_class"),
    )


def meets_target(overall: DataFrame, macro_f1: float = 0.85) -> DataFrame:
    return overall.select("macro_f1", (F.col("macro_f1") >= macro_f1).alias("meets_target"))


def labelled_batch_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and weighted metrics to four digits."""
    return overall_metrics(class_metrics(counts)).select(
        F.round("accuracy", 4).alias("accuracy"),
        F.round("weighted_precision", 4).alias("precision"),
        F.round("weighted_recall", 4).alias("recall"),
        F.round("weighted_f1", 4).alias("f1"),
    )


def label_union(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select(F.col(actual).alias("label")).union(df.select(F.col(predicted).alias("label"))).distinct()


def class_scores(df: DataFrame, actual: str, classes: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """One-vs-rest form: (class, score, positive) with a row for each class of each labelled flow."""
    entries = [
        F.struct(
            F.lit(c).alias("class"),
            F.get(F.col(probabilities), F.lit(i)).alias("score"),
            (F.col(actual) == c).alias("positive"),
        )
        for i, c in enumerate(classes)
    ]
    return df.filter(F.col(actual).isNotNull()).select(F.inline(F.array(*entries)))


def attack_scores(df: DataFrame, actual: str, probabilities: str = "probabilities", benign: str = BENIGN) -> DataFrame:
    """Binary form of the labelled flows: the score of the class ``attack`` is 1 minus the first probability."""
    entry = F.struct(
        F.lit("attack").alias("class"),
        attack_score(probabilities).alias("score"),
        (F.col(actual) != benign).alias("positive"),
    )
    return df.filter(F.col(actual).isNotNull()).select(F.inline(F.array(entry)))


def roc_points(scores: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(class, score, tps, fps, tpr, fpr): a point for each distinct score, all rows at or above it positive.

    Equal scores collapse to one row first, which is written: the flows are scored once, whatever reads the counts
    after that. The sums then run from the highest score down, block by block.
    """
    counts = scores.groupBy("class", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    down = materialise(counts.withColumn("down", -F.col("score")), "score-counts")
    run = running_sums(down, ["class"], "down", ["pos", "neg"], block_rows)
    totals = down.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return run.join(totals, "class").select(
        "class", "score", "pos", "neg", "p", "n",
        F.col("run_pos").alias("tps"),
        F.col("run_neg").alias("fps"),
        F.try_divide("run_pos", "p").alias("tpr"),
        F.try_divide("run_neg", "n").alias("fpr"),
    )


def auc_by_class(points: DataFrame) -> DataFrame:
    """Area by the trapezoid rule: each point adds its step of fps times the mean tps of the step."""
    area = F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2.0))
    per_class = points.groupBy("class", "p", "n").agg(area.alias("area"))
    return per_class.select(
        "class", F.try_divide("area", F.col("p").cast("double") * F.col("n")).alias("auc")
    ).withColumn("macro_auc", F.avg("auc").over(everything()))


def best_threshold(points: DataFrame) -> DataFrame:
    """The score with the largest tpr - fpr, the highest of equal ones, for each class."""
    return points.groupBy("class").agg(
        F.max(F.struct((F.round(F.col("tpr") - F.col("fpr"), 12)).alias("j"), "score", "tpr", "fpr")).alias("b")
    ).select(
        "class", F.col("b.score").alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"),
        F.col("b.j").alias("youden_j"),
    )


def binary_metrics(df: DataFrame, actual: str, predicted: str, benign: str = BENIGN) -> DataFrame:
    """Benign against attack in one aggregate; a ratio without rows is 0."""
    real, said = F.col(actual) != benign, F.col(predicted) != benign
    row = df.agg(
        F.count_if(~real & ~said).alias("tn"),
        F.count_if(~real & said).alias("fp"),
        F.count_if(real & ~said).alias("fn"),
        F.count_if(real & said).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return row.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(tp * 2, tp * 2 + fp + fn),
            "specificity": ratio(tn, tn + fp),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
        }
    )


def error_pairs(counts: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent confusions with their share of all errors."""
    wrong = counts.filter(F.col("actual") != F.col("predicted"))
    share = percent(F.col("n"), F.sum("n").over(everything()))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "actual", "predicted"))
    return wrong.select("actual", "predicted", "n", share.alias("pct_of_errors"), rank.alias("rank")).filter(
        F.col("rank") <= n
    )


def error_summary(counts: DataFrame, benign: str = BENIGN) -> DataFrame:
    wrong = F.col("actual") != F.col("predicted")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return counts.agg(
        F.sum("n").alias("total"),
        total(wrong).alias("errors"),
        total(wrong & (F.col("predicted") == benign)).alias("missed_attacks"),
        total(wrong & (F.col("actual") == benign)).alias("false_alarms"),
    ).withColumn("error_rate", ratio(F.col("errors"), F.col("total")))


def error_by_attack(counts: DataFrame, benign: str = BENIGN) -> DataFrame:
    """Missed rows of each attack, and benign rows taken for it."""
    missed = counts.filter((F.col("actual") != benign) & (F.col("predicted") == benign)).select(
        F.lit("missed").alias("kind"), F.col("actual").alias("attack"), "n"
    )
    alarms = counts.filter((F.col("actual") == benign) & (F.col("predicted") != benign)).select(
        F.lit("false_alarm").alias("kind"), F.col("predicted").alias("attack"), "n"
    )
    return missed.unionByName(alarms)


def parameter_effect(results: DataFrame, parameter: str, score: str) -> DataFrame:
    """Mean, deviation and count of the score for each value of a parameter; the best value is flagged."""
    grouped = results.groupBy(F.col(parameter).alias("value")).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), all_rows().alias("n")
    )
    best = F.row_number().over(W.orderBy(F.desc("mean"), "value")) == 1
    return grouped.withColumn("is_best", best)


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """Summary of scores with the 95 % interval mean +- 1.96 deviations."""
    row = five_numbers(df, score)
    half = F.col("std_samp") * 1.96
    return row.select(
        "mean", "median", F.col("std_samp").alias("std"), "min", "max",
        (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
    )


def score_histogram(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """Rows in equal-width bins between the smallest and the largest score; the last bin is closed."""
    edges = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = edges["lo"], edges["hi"]
    if lo is None:
        return df.select(F.lit(1).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (hi - lo) / bins or 1.0 / bins
    at = F.least(F.floor((F.col(score) - lo) / F.lit(width)), F.lit(bins - 1)) + 1
    return df.filter(F.col(score).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(all_rows().alias("n"))


def importance_table(importances: DataFrame) -> DataFrame:
    """Rank and cumulative importance of each feature; the window runs over features, not rows."""
    order = W.orderBy(F.desc("importance"), "feature")
    return importances.select(
        "feature",
        "importance",
        F.row_number().over(order).alias("rank"),
        F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"),
    )


def importance_summary(table: DataFrame) -> DataFrame:
    return table.agg(
        F.sum(F.when(F.col("rank") <= 10, F.col("importance"))).alias("top10"),
        F.sum(F.when(F.col("rank") <= 20, F.col("importance"))).alias("top20"),
        (F.count_if(F.col("cumulative") <= 0.8) + 1).alias("features_to_80pct"),
        all_rows().alias("features"),
    )


def rank_results(results: DataFrame, score: str, n: int = 10) -> DataFrame:
    """Search results by score, missing scores as 0, equal scores with equal rank."""
    filled = results.withColumn(score, F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)))
    rank = F.rank().over(W.orderBy(F.desc(score)))
    return filled.withColumn("rank", rank).filter(F.col("rank") <= n)
