"""Label and protocol encoding, scaling fitted on the training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.schema import PROTOCOL_CODES


def class_table(df: DataFrame, label: str = "Label") -> DataFrame:
    """(class, class_index) in order of the class name; the window runs over distinct classes only."""
    names = df.select(F.col(f"`{label}`").alias("class")).where(F.col("class").isNotNull()).distinct()
    return names.select("class", (F.row_number().over(W.orderBy("class")) - 1).alias("class_index"))


def few_values(df: DataFrame, column: str) -> list:
    """The distinct values of a categorical column, sorted, as metadata."""
    rows = df.select(F.col(f"`{column}`").alias("v")).where(F.col("v").isNotNull()).distinct().collect()
    return sorted(r["v"] for r in rows)


def class_list(df: DataFrame, label: str = "Label") -> list[str]:
    """The sorted class names, as metadata."""
    return few_values(df, label)


def encode_label(df: DataFrame, classes: Sequence[str], label: str = "Label", out: str = "label_index") -> DataFrame:
    """Index of the label in the class list; NULL where the class is unknown."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{label}`")).cast("int")
    return df.withColumn(out, F.when(at > 0, at - 1))


def decode_label(df: DataFrame, classes: Sequence[str], index: str, out: str = "class") -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.get(names, F.col(index).cast("int")))


def protocol_values(df: DataFrame, protocol: str = "Protocol") -> DataFrame:
    return df.select(F.col(f"`{protocol}`").cast("string").alias("protocol")).distinct().orderBy("protocol")


def one_hot_all(df: DataFrame, protocol: str = "Protocol") -> DataFrame:
    """A 0/1 column for each protocol in the table, in text order, none dropped."""
    values = few_values(df.select(F.col(f"`{protocol}`").cast("string").alias(protocol)), protocol)
    text = F.col(f"`{protocol}`").cast("string")
    flags = {f"{protocol}_{v}": F.coalesce((text == v).cast("int"), F.lit(0)) for v in values}
    return df.withColumns(flags).drop(protocol)


def one_hot_fixed(df: DataFrame, protocol: str = "Protocol") -> DataFrame:
    """The three trained protocol columns; an absent column or unreadable value counts as protocol 0."""
    if protocol in df.columns:
        value = F.coalesce(F.col(f"`{protocol}`").try_cast("double").try_cast("int"), F.lit(0))
    else:
        value = F.lit(0)
    return df.withColumns({f"Protocol_{v}": (value == v).cast("int") for v in PROTOCOL_CODES}).drop(protocol)


def fit_scaler(df: DataFrame, features: Sequence[str], kind: str = "standard") -> DataFrame:
    """(ordinal, feature, center, scale) from one aggregate over all features.

    ``standard`` uses the mean and the population deviation, ``minmax`` the minimum and the range;
    a scale of 0 is replaced by 1.
    """
    entries = []
    for i, f in enumerate(features):
        c = F.col(f"`{f}`").cast("double")
        if kind == "standard":
            center, scale = F.avg(c), F.stddev_pop(c)
        elif kind == "minmax":
            center, scale = F.min(c), F.max(c) - F.min(c)
        else:
            raise ValueError(f"unknown scaler {kind!r}")
        entries.append(
            F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("feature"), center.alias("center"), scale.alias("scale"))
        )
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p")).withColumn(
        "scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    )


def scaler_rows(params: DataFrame) -> list:
    """The fitted parameters as driver-side metadata, one row for each feature."""
    return params.orderBy("ordinal").collect()


def apply_scaler(df: DataFrame, params: DataFrame | list) -> DataFrame:
    """(x - center) / scale for each fitted feature, as one projection."""
    rows = scaler_rows(params) if isinstance(params, DataFrame) else params
    return df.withColumns(
        {r.feature: (F.col(f"`{r.feature}`").cast("double") - F.lit(r.center)) / F.lit(r.scale) for r in rows}
    )


def scaling_check(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Smallest and largest mean and deviation over the features."""
    means = F.array(*[F.avg(F.col(f"`{f}`")) for f in features])
    devs = F.array(*[F.stddev_pop(F.col(f"`{f}`")) for f in features])
    row = df.agg(means.alias("m"), devs.alias("s"))
    return row.select(
        F.array_min("m").alias("min_mean"),
        F.array_max("m").alias("max_mean"),
        F.array_min("s").alias("min_std"),
        F.array_max("s").alias("max_std"),
    )
