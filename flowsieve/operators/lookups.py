"""Lookup and row-aligned joins, ordered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.schema import RAW_LABEL_CLASS


def mapping_table(spark: SparkSession, mapping: dict[str, str] = RAW_LABEL_CLASS) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "raw string, mapped string")


def map_labels(df: DataFrame, mapping: DataFrame, label: str, out: str = "class") -> DataFrame:
    """Left outer lookup; unmapped labels keep their name.

    No broadcast hint: Spark broadcasts the mapping while its size is under its threshold and shuffles
    it otherwise.
    """
    raw = F.col(f"`{label}`")
    return df.join(mapping, raw == F.col("raw"), "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("mapped"), raw).alias(out)
    )


def align_rows(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One-to-one join of two views of a table on its row key."""
    return left.join(right, key)


def page(df: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
