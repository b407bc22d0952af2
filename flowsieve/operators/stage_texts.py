"""Stage reports as texts, written from the results of the operators that they report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.evaluate import overall_metrics


def _one_row(*tables: DataFrame) -> DataFrame:
    """Tables of one row and different columns side by side."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def _lines(*cells: Column) -> Column:
    return F.concat_ws("\n", *cells)


def _number(label: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.format_number(c, 0))


def _share(label: str, c: Column | str, digits: int = 4) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.format_string(f"{label}: %.{digits}f", F.round(column, digits))


def exploration_text(report: str, summary: DataFrame, impact: DataFrame, columns: int, size: str) -> DataFrame:
    """(report, text) from ``class_summary`` and ``consolidation_impact``."""
    at = lambda c: F.max(F.when(F.col("stage") == "after", F.col(c)))
    after = impact.agg(at("classes").alias("classes_after"), at("gini_impurity").alias("gini_after"), at("max_imbalance_ratio").alias("ratio_after"))
    row = _one_row(summary, after)
    text = _lines(
        F.lit("1. DATASET"), _number("   Total Rows", "rows"), F.lit(f"   Total Columns: {columns}\n   Memory Usage: {size}\n2. CLASSES"),
        _number("   Total Classes", "classes"), F.concat(F.lit("   Majority Class: "), "majority_class"), F.concat(F.lit("   Minority Class: "), "minority_class"),
        F.concat(F.lit("   Imbalance Severity: "), "severity"), _share("   Gini Coefficient", "gini_impurity", 3),
        F.lit("3. CONSOLIDATION\n   AFTER Consolidation"), _number("     Classes", "classes_after"), _share("     Gini Coefficient", "gini_after", 3),
        _share("     Max Ratio", "ratio_after", 2),
    )
    return row.select(F.lit(report).alias("report"), text.alias("text"))


def preprocessing_text(report: str, waterfall: DataFrame, split: DataFrame, synthetic: DataFrame, features: int) -> DataFrame:
    """(report, text) from ``cleaning_waterfall``, the rows of the split (train, test) and those made by oversampling (synthetic)."""
    first = F.max(F.when(F.col("step") == 1, F.col("removed") + F.col("remaining")))
    clean = waterfall.agg(first.alias("initial"), F.min("remaining").alias("final"), F.sum("removed").alias("gone"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("step", "rule", "removed"))), lambda s: F.concat(F.lit("  "), s["rule"], F.lit(" removed: "), F.format_number(s["removed"], 0)))
    row = _one_row(clean, waterfall.agg(F.concat_ws("\n", steps).alias("steps")), split, synthetic)
    share = F.when(F.col("initial") > 0, F.col("gone") * 100.0 / F.col("initial")).otherwise(0.0)
    text = _lines(
        F.lit("Initial Dataset:"), _number("  Rows", "initial"), "steps", F.lit("Final Clean Dataset:"), _number("  Rows", "final"),
        F.concat(_number("Total removed", "gone"), F.format_string(" rows (%.3f%%)", F.round(share, 3))),
        F.concat(_number("Training set", "train"), F.lit(" samples")), F.concat(_number("Test set", "test"), F.lit(" samples")),
        _number("Synthetic samples", "synthetic"), _number("Samples after", F.col("train") + F.col("synthetic")), F.lit(f"Features selected: {features}"),
    )
    return row.select(F.lit(report).alias("report"), text.alias("text"))


def testing_text(
    report: str, metrics: DataFrame, aucs: DataFrame, binary: DataFrame, binary_auc: DataFrame, confidence: DataFrame, seconds: float
) -> DataFrame:
    """(report, text) from ``class_metrics``, ``auc_by_class`` (of all classes, and of attacks), ``binary_metrics`` and ``confidence_summary``.

    ``seconds`` is how long scoring took; a class without AUC shows 0.
    """
    auc = aucs.select(F.col("class").alias("class__"), F.coalesce("auc", F.lit(0.0)).alias("auc"))
    scored = metrics.join(auc, F.col("class") == F.col("class__"), "left")
    numbers = [F.format_string("%.4f", F.round(F.coalesce(c, F.lit(0.0)), 4)) for c in ("precision", "recall", "f1", "auc")]
    line = F.concat_ws("  ", F.rpad("class", 20, " "), *numbers, F.format_number("support", 0))
    table = scored.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("class", line.alias("line")))), lambda r: r["line"])).alias("table"))
    overall = overall_metrics(metrics).select("accuracy", "macro_f1", "weighted_f1", "best_class", "worst_class")
    rows = metrics.agg(F.sum("support").alias("rows"))
    attacks = binary.select(*[F.col(c).alias(f"b_{c}") for c in ("accuracy", "precision", "recall", "f1", "specificity")])
    area = binary_auc.agg(F.coalesce(F.max("auc"), F.lit(0.0)).alias("b_auc"))
    sure = confidence.select(F.col("mean").alias("confidence"), F.col("low_confidence_pct").alias("low"))
    row = _one_row(table, overall, rows, attacks, area, sure)
    text = _lines(
        F.lit("2. INFERENCE PERFORMANCE"), F.concat(_number("Inference speed", F.col("rows") / F.lit(float(seconds))), F.lit(" samples/second")),
        _share("Mean confidence", "confidence"), _share("Low confidence share", "low", 2), F.lit("\n3. MULTICLASS EVALUATION"),
        _share("Accuracy", "accuracy"), _share("Macro F1-Score", "macro_f1"), _share("Weighted F1-Score", "weighted_f1"),
        F.concat(F.lit("Best Class: "), "best_class"), F.concat(F.lit("Worst Class: "), "worst_class"),
        F.lit("\nPer-Class Performance:\nClass  Precision  Recall  F1-Score  AUC  Support\n" + "-" * 60), "table",
        F.lit("\n4. BINARY EVALUATION (Benign vs Attack)"), _share("Accuracy", "b_accuracy"), _share("Precision", "b_precision"),
        _share("Recall (TPR)", "b_recall"), _share("F1-Score", "b_f1"), _share("Specificity (TNR)", "b_specificity"), _share("Binary AUC", "b_auc"), F.lit(""),
    )
    return row.select(F.lit(report).alias("report"), text.alias("text"))
