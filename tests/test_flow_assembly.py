"""Flow assembly: chunked batch form against a plain loop, and the stream against the batch."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.flows import Steps, _last_starts, _starts_after, assemble_flows, mark_flows
from flowsieve.session import scratch_path
from flowsieve.sources.replay import stream_table
from flowsieve.streaming.assembly import assemble_stream, finish_flows, remaining_flows, rocksdb_state
from flowsieve.streaming.runs import progress_table, run_to_end

ZERO = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, v double"


def packets(seed, n=900):
    """One key sends two thirds of all packets without an idle gap."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else rng.choice("abcde")
        second = (i // 3) * 0.9 if key == "hot" else rng.uniform(0, 600)
        rows.append((i, key, ZERO + timedelta(seconds=round(second, 3)), float(i % 17)))
    return rows


def by_loop(rows, idle, age):
    out, state = {}, {}
    for i, k, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        start, last = state.get(k, (None, None))
        if start is None or (ts - last).total_seconds() >= idle or (ts - start).total_seconds() >= age:
            start = ts
        state[k] = (start, ts)
        out[i] = start
    return out


@pytest.mark.parametrize("seed, block_rows, fan", [(1, 3, 2), (2, 20, 3), (3, 70, 16), (4, 10**6, 16)])
def test_block_marks_equal_the_loop(spark, seed, block_rows, fan):
    rows = packets(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mark_flows(df, ["k"], "ts", 15, 30, block_rows, fan).collect()
    want = by_loop(rows, 15, 30)
    assert {r.id: r.flow_start for r in got} == want
    assert sum(r.iat is None for r in got) == len({(r.k, r.flow_start) for r in got})
    spans = {}
    for i, k, ts, _ in rows:
        low, high = spans.get((k, want[i]), (ts, ts))
        spans[k, want[i]] = (min(low, ts), max(high, ts))
    assert sum(r.iat or 0 for r in got) == sum(int((b - a).total_seconds() * 1e6 + 0.5) for a, b in spans.values())


def random_steps(rng, begin, age, idle):
    """Times of a stretch without an idle gap, from shortly after ``begin``."""
    t = begin + np.cumsum(rng.integers(0, idle, rng.integers(1, 30)))
    return t, Steps.of(t, _last_starts(t, _starts_after(t, idle, age)), age)


def test_composed_steps_equal_the_walk():
    rng, age = np.random.default_rng(8), 100
    for trial in range(300):
        idle = int(rng.integers(2, 100))
        begin, stretches = 1_000, []
        for _ in range(rng.integers(2, 6)):
            stretches.append(random_steps(rng, begin, age, idle))
            begin = int(stretches[-1][0][-1])
        whole = stretches[0][1]
        for _, steps in stretches[1:]:
            whole = whole.then(steps, age)
        whole = whole.before(int(stretches[0][0][0]) + age)
        for start in rng.integers(1_000 - age, 1_001, 20).tolist():
            now = start
            for t in np.concatenate([t for t, _ in stretches]).tolist():
                now = t if t >= now + age else now
            if start < stretches[0][0][0]:
                assert whole(np.asarray([start]), age)[0] == now


def test_one_key_with_a_million_packets_inside_one_age_limit(spark):
    """Blocks are cut at any packet: no block holds much more than its share, and every packet finds its flow."""
    n = 1_000_000
    at = F.col("id") * 45 + F.pmod(F.xxhash64("id"), F.lit(40))
    df = spark.range(n).select("id", F.lit("hot").alias("k"), F.timestamp_micros(at).alias("ts"))
    marked = mark_flows(df, ["k"], "ts", 15, 30, block_rows=50_000, fan=4)
    got = marked.groupBy("flow_start").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("flow_start").collect()
    times = sorted(r.t for r in df.select(F.unix_micros("ts").alias("t")).collect())
    second = next(i for i, t in enumerate(times) if t >= times[0] + 30_000_000)
    assert [r.n for r in got] == [second, n - second] and all(r.flow_start == r.lo for r in got)


def test_identical_packets_and_missing_times(spark):
    rows = [(i, None, ZERO, 1.0) for i in range(60)] + [(100 + i, "a", ZERO + timedelta(seconds=i), None) for i in range(60)]
    df = spark.createDataFrame([*rows, (999, "a", None, 1.0)], SCHEMA)
    got = {r.id: r.flow_start for r in mark_flows(df, ["k"], "ts", 15, 30, 7, 2).collect()}
    assert got == by_loop(rows, 15, 30)


def test_empty_packet_table(spark):
    assert assemble_flows(spark.createDataFrame([], SCHEMA), ["k"], "ts", "v").count() == 0


def flow_key(df):
    return sorted(
        (r.k, r.flow_start, r.flow_end, r.packets, round(r.value_sum, 6), round(r.value_std or -1, 6), r.iat_min, r.iat_max, r.duration_us)
        for r in df.collect()
    )


def streamed(spark, path, schema, lateness, piece_rows=2048):
    """(closed flows, those that remain, progress) of the files of a folder, one for each micro-batch."""
    stream = stream_table(spark, path, schema, files_per_trigger=1)
    with rocksdb_state(spark):
        run = run_to_end(assemble_stream(stream, "k", "ts", "v", 15, 30, lateness, piece_rows), "test-assembly")
    closed = spark.read.parquet(run.output).drop("closed")
    progress = progress_table(spark, run).agg(F.sum("input_rows"), F.sum("late_rows")).first()
    return closed, remaining_flows(spark, run.checkpoint, "k", 15, 30), tuple(progress)


def test_stream_equals_batch_and_counts_late_rows(spark):
    rows = sorted(packets(5), key=lambda r: r[2])
    df = spark.createDataFrame(rows, SCHEMA)
    path = scratch_path(spark, "packets")
    for lo, hi in ((0, 200), (200, 400), (400, 601)):
        bound = [F.lit(ZERO + timedelta(seconds=s)) for s in (lo, hi)]
        df.filter((F.col("ts") >= bound[0]) & (F.col("ts") < bound[1])).coalesce(1).write.mode("append").parquet(path)
    closed, rest, progress = streamed(spark, path, df.schema, "5 seconds")
    assert closed.count() > rest.count() > 0
    batch = assemble_flows(df, ["k"], "ts", "v", 15, 30)
    assert flow_key(finish_flows(closed.unionByName(rest.drop("followed")), "k")) == flow_key(batch)
    assert progress == (len(rows), 0)


@pytest.mark.parametrize("piece_rows", [5, 2048])
def test_packets_out_of_order_within_the_lateness(spark, piece_rows):
    """Batches that overlap in time and are shuffled inside give the flows of the sorted table; later ones are dropped."""
    rng = random.Random(6)
    rows = packets(6)
    late = {r[0]: (r[2] - ZERO).total_seconds() + rng.uniform(0, 55) for r in rows}
    arriving = sorted(rows, key=lambda r: late[r[0]])
    path = scratch_path(spark, "packets")
    size = 75
    for at in range(0, len(arriving), size):
        part = arriving[at : at + size]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    too_late = [(10_000, "hot", ZERO, 1.0)]
    spark.createDataFrame(too_late, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    df = spark.createDataFrame(rows, SCHEMA)
    closed, rest, progress = streamed(spark, path, df.schema, "60 seconds", piece_rows)
    assert closed.count() > 20
    batch = assemble_flows(df, ["k"], "ts", "v", 15, 30)
    assert flow_key(finish_flows(closed.unionByName(rest.drop("followed")), "k")) == flow_key(batch)
    assert progress == (len(rows) + 1, 1)


def test_hot_key_of_one_micro_batch_is_no_frame(spark):
    """Many more packets of a key than a frame holds, backwards, in one batch and out by timers of the next."""
    n = 30_000
    df = spark.range(n).select("id", F.lit("hot").alias("k"), F.timestamp_micros((n - F.col("id")) * 1_700).alias("ts"), F.lit(1.0).alias("v"))
    path = scratch_path(spark, "packets")
    df.coalesce(1).write.mode("append").parquet(path)
    last = [(n, "other", datetime(1970, 1, 1) + timedelta(seconds=400), 1.0)]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    try:
        closed, rest, _ = streamed(spark, path, df.schema, "60 seconds", 512)
        assert closed.filter("k = 'hot'").count() == 2 and rest.filter("k = 'hot'").isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = assemble_flows(df, ["k"], "ts", "v", 15, 30)
    assert flow_key(finish_flows(closed, "k")) == flow_key(batch)
