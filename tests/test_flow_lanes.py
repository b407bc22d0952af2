"""Many keys in one state of the stream: the walk against a plain loop, few state rows, keys of any plain type."""

import numpy as np
from pyspark.sql import functions as F

from flowsieve.operators.flows import assemble_flows
from flowsieve.session import scratch_path
from flowsieve.sources.replay import stream_table
from flowsieve.streaming.assembly import assemble_stream, finish_flows, remaining_flows, rocksdb_state, walk
from flowsieve.streaming.runs import progress_table, run_to_end


def by_loop(packets, idle, age):
    """(key, start, last, packets, values, sum, smallest gap, largest gap) of all flows, packet by packet."""
    opened, closed = {}, []
    for k, t, v in packets:
        flow = opened.get(k)
        if flow is None or t - flow[1] >= idle or t >= flow[0] + age:
            closed += [] if flow is None else [(k, *flow)]
            flow = [t, t, 0, 0, 0.0, None, None]
        elif flow[2]:
            gap = t - flow[1]
            flow[5], flow[6] = min(gap, gap if flow[5] is None else flow[5]), max(gap, gap if flow[6] is None else flow[6])
        flow[1], flow[2] = t, flow[2] + 1
        if not np.isnan(v):
            flow[3], flow[4] = flow[3] + 1, flow[4] + v
        opened[k] = flow
    return sorted([tuple(f) for f in closed] + [(k, *f) for k, f in opened.items()])


def test_walk_of_many_keys_equals_the_loop():
    rng = np.random.default_rng(3)
    for trial in range(200):
        idle, age, n = int(rng.integers(1, 60)), int(rng.integers(1, 200)), int(rng.integers(1, 300))
        if trial % 10 == 0:
            idle, age = 2**58, 2**59
        times = np.sort(rng.integers(0, 2000, n))
        codes, values = rng.integers(0, 6, n), np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 9, n))
        flows, got = {}, []
        cuts = [0, *np.sort(rng.integers(0, n + 1, 3)).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            got += walk(flows, codes[a:b], times[a:b], values[a:b], idle, age)
        got += list(flows.items())
        short = sorted((c, *f[:4], f[4] + f[3] * (f[6] or 0.0), f[9], f[10]) for c, f in got)
        assert short == by_loop(zip(codes.tolist(), times.tolist(), values.tolist()), idle, age)


def test_thousands_of_keys_are_a_few_states(spark):
    """Integers beyond a double's precision, NULL, both zeros and moments as a key; the state has no row for each key."""
    n = F.col("id")
    big = F.when(n % 11 > 0, n % 1500 + F.lit(2**60 + 1))
    zero = F.when(n % 2 == 0, F.lit(-0.0)).when(n % 13 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0))
    df = spark.range(12_000).select(
        big.alias("k"), zero.alias("z"), F.timestamp_micros(n % 3 + 1).alias("m"), F.timestamp_millis(n * 10 + 1_700_000_000_000).alias("ts"), (n % 7).cast("double").alias("v")
    )
    path, key = scratch_path(spark, "many-keys"), ["k", "z", "m"]
    for half in (0, 1):
        df.filter(F.floor((F.unix_millis("ts") - 1_700_000_000_000) / 60_000) == half).coalesce(1).write.mode("append").parquet(path)
    with rocksdb_state(spark):
        stream = stream_table(spark, path, df.schema, files_per_trigger=1)
        run = run_to_end(assemble_stream(stream, key, "ts", "v", 15, 30, lanes=3), "many-keys")
    assert progress_table(spark, run).agg(F.max("state_rows")).first()[0] < 60
    live = spark.read.parquet(run.output).drop("closed").unionByName(remaining_flows(spark, run.checkpoint, key, 15, 30).drop("followed"))
    assert [live.schema[k].dataType for k in key] == [df.schema[k].dataType for k in key]
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in ("k", "m")], (F.col("z") + 0.0).cast("string"))
    batch = assemble_flows(df.withColumn("name", name), ["name"], "ts", "v", 15, 30)
    shown = ["name", "flow_start", "flow_end", "packets", F.round("value_sum", 6), F.round("value_std", 6), "iat_min", "iat_max"]
    want, got = batch.select(*shown), finish_flows(live, key).withColumn("name", name).select(*shown)
    assert got.count() == want.count() > 4000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
