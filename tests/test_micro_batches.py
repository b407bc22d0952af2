"""Streams of large tables: few micro-batches, each a whole part of the capture."""

from math import ceil

from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowsieve.plans.streams import flow_files


def test_micro_batches_stay_few(spark):
    for n in (10_000, 100_000, 6_000_000):
        size, files = flow_files(spark.range(n))
        assert 2 <= ceil(ceil(n / size) / files) <= 12


def test_a_part_of_many_files_is_one_micro_batch(spark, tmp_path):
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    events = spark.range(2000, numPartitions=5).select(
        F.col("id").alias("event_id"), start.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = entry.queries()["h4_micro_batches"](spark, str(tmp_path)).collect()
    assert {r.batches for r in rows} == {3} and sum(r.n for r in rows) == 2000
