"""Scoring on a stream against the batch, live runs with a drain, late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import learn
from flowsieve.plans.fixtures import flows, scored
from flowsieve.plans.training import SMALL, prepare, train_scorer
from flowsieve.session import scratch_path
from flowsieve.sources.replay import stream_table, typed_or_rejected
from flowsieve.streaming.detection import minute_totals, score_stream
from flowsieve.streaming.runs import drain, latest, progress_table, run_to_end, run_versions, start_live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scorer(spark):
    prepared = prepare(flows(spark, SF).drop("ts"), "event_id", drop=("Flow ID", "Src IP"))
    return train_scorer(prepared, "event_id", SMALL, SMALL, smallest=3, largest=6)[0]


def test_prepared_tables(spark):
    p = prepare(flows(spark, SF).drop("ts"), "event_id", drop=("Flow ID", "Src IP"))
    assert p.classes == sorted(p.classes) and "__DROP__" not in p.classes and "Infilteration" not in p.classes
    real = p.train.filter(~F.col("synthetic"))
    n, t = real.count(), p.test.count()
    assert t == -(-(n + t) // 5)
    assert p.train.filter("synthetic").count() > 0
    means = real.agg(*[F.avg(f"`{f}`") for f in p.features]).first()
    assert all(abs(m) < 1e-9 for m in means)


def test_stream_scores_equal_batch_scores(spark, scorer):
    rows = flows(spark, SF)
    path = scratch_path(spark, "flows")
    rows.repartition(5).write.parquet(path)
    stream = stream_table(spark, path, rows.schema, files_per_trigger=2)
    columns = ["event_id", "predicted_class", "confidence", "threat_level"]
    run = run_to_end(score_stream(stream, scorer).select(columns), "test-scores")
    got = sorted(tuple(r) for r in spark.read.parquet(run.output).collect())
    assert got == sorted(tuple(r) for r in scorer.score(rows).select(columns).collect())
    assert progress_table(spark, run).filter("input_rows > 0").count() == 3


def test_saved_scorer_scores_the_same(spark, scorer):
    path = scratch_path(spark, "scorer")
    learn.save_scorer(spark, scorer, path)
    rows = flows(spark, SF)
    one, two = (s.score(rows).select("event_id", "confidence").orderBy("event_id").collect() for s in (scorer, learn.load_scorer(spark, path)))
    assert one == two


def test_live_run_drains_what_has_arrived(spark):
    rows = scored(spark, SF).select("event_id", "threat_level")
    path, out, ckpt = (scratch_path(spark, n) for n in ("live-in", "live-out", "live-ckpt"))
    rows.write.parquet(path)
    query = start_live(stream_table(spark, path, rows.schema), out, ckpt, every="200 milliseconds")
    drain(query)
    assert not query.isActive
    assert spark.read.parquet(out).count() == rows.count()


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    zero = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(zero + timedelta(minutes=m), level) for m, level in ((0, "RED"), (1, "GREEN"), (90, "RED"))], "ts timestamp, threat_level string"
    )
    late = spark.createDataFrame([(zero, "RED"), (zero + timedelta(minutes=90), "YELLOW")], df.schema)
    path = scratch_path(spark, "late")
    # Late rows are measured against the watermark that the batch before started with.
    for part in (df, df.filter("minute(ts) = 30"), late):
        part.coalesce(1).write.mode("append").parquet(path)
    run = run_versions(minute_totals(stream_table(spark, path, df.schema, files_per_trigger=1), "ts", "5 minutes"), "late")
    rows = {r.minute: (r.total, r.threats, r.suspicious) for r in latest(spark, run, ["minute"]).collect()}
    assert rows == {zero: (1, 1, 0), zero + timedelta(minutes=1): (1, 0, 0), zero + timedelta(minutes=90): (3, 2, 1)}
    assert progress_table(spark, run).agg(F.sum("late_rows")).first()[0] == 1


def test_rejected_rows_keep_their_reason(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "1"), ("2", None)], "id string, v string")
    types = spark.createDataFrame([], "id long, v double").schema
    out = typed_or_rejected(df, {f.name: f.dataType for f in types}).collect()
    assert [(r.status, r.reason) for r in out] == [("good", None), ("rejected", "id: not readable: x"), ("rejected", "v: missing")]
    assert out[1].raw == '{"id":"x","v":"1"}'


def test_a_failed_fit_scores_zero(spark):
    p = prepare(flows(spark, SF).drop("ts"), "event_id", drop=("Flow ID", "Src IP"), balance=False)
    space = {"n_estimators": [3], "max_depth": [2, 99]}
    results, best = learn.randomised_search(p.train, p.features, "y", ["event_id"], space, n_iter=2, folds=2, fraction=1.0)
    by_depth = {r.params["max_depth"]: r for r in results.collect()}
    assert by_depth["99"].mean_score == 0.0 and by_depth["99"].failure
    assert by_depth["2"].mean_score > 0.0 and best["max_depth"] == 2


def test_draws_are_distinct_and_seeded():
    space = {"a": [1, 2, 3], "b": [True, False]}
    draws = learn.draw_parameters(space, 4, 1)
    assert draws == learn.draw_parameters(space, 4, 1) and len({tuple(d.items()) for d in draws}) == 4
    assert len(learn.draw_parameters(space, 99)) == 6
    path_params = learn.ForestParams(min_samples_split=10, min_samples_leaf=2).classifier("y")
    assert path_params.getMinInstancesPerNode() == 5


def test_best_parameters_are_kept(spark):
    path = scratch_path(spark, "best")
    best = {"n_estimators": 150, "max_features": "sqrt", "class_weight": None, "bootstrap": True}
    learn.save_best_parameters(spark, best, path)
    assert learn.load_best_parameters(spark, path) == best


def test_progress_of_many_fast_batches_is_complete(spark):
    path = scratch_path(spark, "many")
    spark.range(3_000).repartition(300).write.parquet(path)
    stream = stream_table(spark, path, spark.range(1).schema, files_per_trigger=1)
    run = run_to_end(stream, "many")
    rows = progress_table(spark, run).collect()
    assert sorted(r.batch_id for r in rows if r.input_rows) == list(range(300))
    assert sum(r.input_rows for r in rows) == 3_000


def test_closed_minutes_are_written_once_and_late_rows_counted(spark):
    zero = datetime(2024, 1, 1)
    # late rows are measured against the watermark that the batch before started with
    parts = [[(0, "RED"), (1, "GREEN")], [(20, "RED")], [(20, "GREEN")], [(0, "RED"), (20, "YELLOW")], [(50, "RED")]]
    path = scratch_path(spark, "minutes")
    for part in parts:
        rows = [(zero + timedelta(minutes=m), level) for m, level in part]
        spark.createDataFrame(rows, "ts timestamp, threat_level string").coalesce(1).write.mode("append").parquet(path)
    schema = spark.createDataFrame([], "ts timestamp, threat_level string").schema
    run = run_to_end(minute_totals(stream_table(spark, path, schema, files_per_trigger=1), "ts", "5 minutes"), "minutes")
    got = sorted((r.minute, r.total, r.threats, r.suspicious) for r in spark.read.parquet(run.output).collect())
    assert got == [(zero, 1, 1, 0), (zero + timedelta(minutes=1), 1, 0, 0), (zero + timedelta(minutes=20), 3, 1, 1)]
    assert progress_table(spark, run).agg(F.sum("late_rows")).first()[0] == 1


def test_a_search_on_the_same_content_fits_nothing(spark, monkeypatch):
    rows = [(i, float(i % 7), None if i % 11 == 0 else float(i % 5), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").fillna(0.0)
    store, space = scratch_path(spark, "store"), {"n_estimators": [2], "max_depth": [2, 3]}
    fits, plain = [], learn.fit_forest
    monkeypatch.setattr(learn, "fit_forest", lambda *a, **k: fits.append(1) or plain(*a, **k))

    def search(table, **options):
        before = len(fits)
        results, best, stored = learn.cached_search(table, ["a", "b"], "y", ["id"], store, space, n_iter=2, folds=2, fraction=1.0, **options)
        return len(fits) - before, best, stored, sorted((r.trial, r.mean_score) for r in results.collect())

    first = search(df)
    again = search(df.orderBy(F.desc("b")).repartition(5))
    assert first[0] == 4 and not first[2] and again[0] == 0 and again[2] and first[1:2] + first[3:] == again[1:2] + again[3:]
    assert search(df.withColumn("a", F.when(F.col("id") == 9, 0.5).otherwise(F.col("a"))))[0] == 4
    assert search(df.unionAll(df.limit(1)))[0] == 4
    assert search(df, seed=7)[0] == 4


def test_fingerprint_tells_nulls_and_types_apart(spark):
    name = lambda rows, schema: learn.content_fingerprint(spark.createDataFrame(rows, schema), ["a", "b"])
    schema = "a long, b long"
    prints = [name([(1, None)], schema), name([(None, 1)], schema), name([(1, 1)], schema), name([(1, 1)] * 2, schema), name([(1, 1)], "a int, b long"), name([], schema)]
    assert len(set(prints)) == 6 and name([(1, 2), (3, 4)], schema) == name([(3, 4), (1, 2)], schema)
