"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.plans import registry
from flowsieve.plans import profiles, relational, rows, stored_reports, streams, tables, training  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["d29_minute_rollup"](spark, sf_dir)
