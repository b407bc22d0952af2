"""Plan checks: what reaches the scan, what stays in the JVM, what is never planned."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import flowsieve
from flowsieve.operators import clean, profile
from flowsieve.plans.fixtures import FLOW_SCHEMA, scored
from flowsieve.operators.lookups import align_rows
from flowsieve.plans.registry import table
from flowsieve.session import scratch_path
from flowsieve.sources.tables import load_bucketed, save_bucketed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = table(spark, SF, "events").filter(F.col("event_type") == "view").select("event_id")
    text = plan(clean.drop_identifiers(df))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    schema = re.search(r"ReadSchema: (\S+)", plan(profile.class_counts(scored(spark, SF), "threat_level"))).group(1)
    assert "props" not in schema and "value" not in schema


def test_scoring_and_rollup_stay_in_the_jvm(spark):
    for name in ("d29_minute_rollup", "d25_threat_totals", "c8_top_classes", "b_clean_training", "d14_cleaning_waterfall"):
        text = plan(entry.queries()[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text, name


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n[0] in "bcdfg" and n not in ("d36_forest_shape", "d36_forest_invariants")])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_profiles_scan_once(spark):
    rows = table(spark, SF, "lineitem")
    for df in (profile.missing_by_column(rows), profile.missing_totals(rows), profile.initial_statistics(rows), profile.column_availability(rows)):
        assert plan(df).count("FileScan") == 1


def test_stored_stage_tables_join_without_an_exchange(spark):
    path = scratch_path(spark, "bucketed")
    left = spark.range(5_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), F.lit("a'b").alias("odd name"))
    save_bucketed(left, f"{path}/left", ["k"], 5)
    save_bucketed(left.select("k", (F.col("k") % 3).alias("y")), f"{path}/right", ["k"], 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for again in (False, True):
            if again:  # another session knows only the folder
                for t in spark.catalog.listTables():
                    if t.name.startswith("bucketed_"):
                        spark.sql(f"DROP TABLE {t.name}")
            joined = align_rows(load_bucketed(spark, f"{path}/left"), load_bucketed(spark, f"{path}/right"), ["k"])
            counted = joined.groupBy("k").count()
            assert joined.count() == 5_000 and joined.columns == ["k", "x", "odd name", "y"]
            for df in (joined, counted):
                assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_local_checkpoints_or_collected_frames():
    root = Path(flowsieve.__file__).parent
    for file in root.rglob("*.py"):
        text = file.read_text()
        assert "localCheckpoint" not in text and "toPandas" not in text and "crossJoin" not in text, file
        assert "coalesce(1)" not in text and "repartition(1)" not in text, file


def test_default_schema():
    assert FLOW_SCHEMA.key == ("event_id",)
