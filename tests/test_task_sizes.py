"""What one task holds does not grow with the tables."""

from pyspark.sql import functions as F

from flowsieve.operators import encode, learn, sample
from flowsieve.plans import training


def test_training_rows_are_dealt_in_bounded_parts(spark):
    rows = spark.range(2000, numPartitions=1)
    parts = learn.deal_rows(rows, task_rows=100).groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] <= 125
    assert learn.deal_rows(rows, task_rows=2000) is rows


def test_a_forest_grows_on_dealt_rows(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(learn, "deal_rows", lambda rows: asked.append(rows) or rows)
    rows = spark.range(40).select((F.col("id") % 2).alias("y"), (F.col("id") % 7).alias("x"))
    learn.fit_forest(rows, ["x"], "y", learn.ForestParams(n_estimators=2, max_depth=2))
    assert len(asked) == 1


def test_a_forest_deals_its_rows_once(spark, monkeypatch):
    """The rows are read to count them and to deal them, not again each time MLlib asks for them."""
    read, deal = spark.sparkContext.accumulator(0), learn.deal_rows
    monkeypatch.setattr(learn, "deal_rows", lambda rows: deal(rows, task_rows=100))

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(1000).select((F.col("id") % 2).alias("y"), (F.col("id") % 7).alias("x"))
    learn.fit_forest(rows.mapInPandas(counted, rows.schema), ["x"], "y", learn.ForestParams(n_estimators=2, max_depth=2))
    assert read.value == 2 * 1000


def test_a_large_table_is_marked_without_moving_its_rows(spark):
    """What is known of each class is written, so Spark sees that it is small: the rows are joined where they are."""
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("y"))
    marked = sample.mark_stratified(rows, "y", ["id"], 0.2, rank_rows=100)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    picked = [r.id for r in marked.filter("picked").collect()]
    assert sorted(picked) == sorted(r.id for r in sample.mark_stratified(rows, "y", ["id"], 0.2).filter("picked").collect())


def test_equal_rows_are_grouped_once(spark, monkeypatch):
    """The protocols are looked up in the written table, not by grouping all rows again."""
    plans, few = [], encode.few_values
    monkeypatch.setattr(encode, "few_values", lambda df, c: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or few(df, c))
    rows = spark.range(400).select(
        F.col("id").alias("n"), (F.col("id") % 90).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "Bot").otherwise("Benign").alias("Label"),
        (F.col("id") % 2 * 11 + 6).alias("Protocol"),
    )
    training.prepare(rows, "n", balance=False)
    assert plans and not any("Aggregate" in p for p in plans)
