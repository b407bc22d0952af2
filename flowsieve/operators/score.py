"""Preparing flows for a trained forest, scoring them, and the per-row report fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import threat
from flowsieve.operators.clean import align_features, zero_fill
from flowsieve.operators.encode import apply_scaler, one_hot_fixed


@dataclass(frozen=True)
class Scorer:
    """What scoring needs besides the rows: scaler rows, chosen features, class names and the model."""

    scaler: list
    features: list[str]
    classes: list[str]
    model: object

    def prepare(self, df: DataFrame, protocol: str = "Protocol") -> DataFrame:
        """Input columns plus a struct of the scaled, selected features; the same for batch and stream."""
        trained = [r.feature for r in self.scaler]
        raw = df.withColumn("input__", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        names = [c for c in dict.fromkeys([*trained, protocol]) if c in df.columns]
        numbers = one_hot_fixed(zero_fill(raw, names), protocol)
        aligned = align_features(numbers, trained, keep=["input__"])
        scaled = apply_scaler(aligned, self.scaler)
        return scaled.select("input__", *[F.col(f"`{f}`") for f in self.features])

    def score(self, df: DataFrame, protocol: str = "Protocol") -> DataFrame:
        """The rows with probabilities, top3, predicted_class, confidence and threat_level."""
        predicted = self.model.transform(self.prepare(df, protocol))
        probabilities = vector_to_array("probability").alias("probabilities")
        return add_ranking(predicted.select("input__.*", probabilities), self.classes)


def add_ranking(df: DataFrame, classes: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """top3, predicted_class, confidence and threat_level from an array of class probabilities."""
    top = df.withColumn("top3", threat.top_classes(F.col(probabilities), classes))
    return top.withColumns(
        {
            "predicted_class": threat.nth_class(F.col("top3"), 1),
            "confidence": threat.nth_conf(F.col("top3"), 1),
            "threat_level": threat.threat_level(F.col("top3")),
        }
    )


def flatten_top2(df: DataFrame, top: str = "top3") -> DataFrame:
    """prediction, confidence and the runner-up as flat columns, '' and 0.0 where there is none."""
    t = F.col(top)
    return df.withColumns(
        {
            "prediction": threat.nth_class(t, 1),
            "confidence": threat.nth_conf(t, 1),
            "top2_prediction": threat.nth_class(t, 2),
            "top2_confidence": threat.nth_conf(t, 2),
        }
    )


def attack_label(index: str) -> Column:
    """1 for every class but the first; NULL without a label."""
    return (F.col(index) != 0).cast("int")


def attack_score(probabilities: str = "probabilities") -> Column:
    return F.lit(1.0) - F.get(F.col(probabilities), F.lit(0))
