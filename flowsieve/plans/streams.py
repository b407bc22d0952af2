"""Queries for flow assembly and streaming (H): each stream runs to its end and is read back."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from pyspark.sql import types as T

from flowsieve.operators.flows import assemble_flows
from flowsieve.operators.score import add_ranking
from flowsieve.operators import learn
from flowsieve.plans.fixtures import CLASSES, SCORED, flows, weigh
from flowsieve.plans.profiles import MINUTES
from flowsieve.plans.registry import query, rounded, table
from flowsieve.plans.training import small_scorer, twice
from flowsieve.session import scratch_path
from flowsieve.sources.replay import replay_csv, stream_table, typed_or_rejected
from flowsieve.streaming.assembly import assemble_stream, finish_flows, remaining_flows, rocksdb_state
from flowsieve.streaming.detection import alerts, class_totals, level_totals, minute_totals, score_stream
from flowsieve.streaming.runs import drain, latest, progress_table, run_to_end, run_versions, start_live

KEY = ["user_id", "side"]
CHAIN = """packets AS (SELECT user_id, CAST(event_id % 2 AS INT) AS side, ts, CASE WHEN event_id % 97 = 0 OR event_id % 83 = 0 THEN NULL ELSE value END AS value,
      row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS rn FROM events),
    chain AS (SELECT user_id, side, rn, ts, value, ts AS flow_start FROM packets WHERE rn = 1
      UNION ALL SELECT p.user_id, p.side, p.rn, p.ts, p.value, CASE WHEN p.ts - c.ts >= INTERVAL 1 HOUR OR p.ts - c.flow_start >= INTERVAL 4 HOUR
        THEN p.ts ELSE c.flow_start END FROM chain c JOIN packets p ON p.user_id = c.user_id AND p.side = c.side AND p.rn = c.rn + 1),
    gaps AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, side, flow_start ORDER BY rn) AS iat FROM chain)"""
FLOW_SQL = f"""WITH RECURSIVE {CHAIN} SELECT user_id, side, strftime(flow_start, '%Y-%m-%d %H:%M:%S.%f') AS flow_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS flow_end,
    count(*) AS packets, round(sum(value), 6) AS value_sum, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
    min(value) AS value_min, max(value) AS value_max, round(avg(iat), 3) AS iat_mean, min(iat) AS iat_min, max(iat) AS iat_max,
    CAST(epoch_us(max(ts)) - epoch_us(flow_start) AS BIGINT) AS duration_us FROM gaps GROUP BY user_id, side, flow_start"""


def packets(events):
    """Events as packets of two-column keys; some have no value, NULL or NaN."""
    n = F.col("event_id")
    value = F.when(n % 97 == 0, F.lit(None)).when(n % 83 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return events.withColumns({"side": (n % 2).cast("int"), "value": value})


def flow_rows(df):
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    out = df.withColumns(
        {
            "flow_start": F.date_format("flow_start", stamp),
            "flow_end": F.date_format("flow_end", stamp),
            "iat_mean": F.round("iat_mean", 3),
        }
    )
    return rounded(out)


@query("h3_assemble_flows", FLOW_SQL)
def _(spark, d):
    return flow_rows(assemble_flows(packets(table(spark, d, "events")), KEY, "ts", "value", 3600, 4 * 3600))


#: Events of a file, as a capture would close it.
FILE_ROWS = 500_000


def event_files(spark, d, parts=3, file_rows=FILE_ROWS):
    """(schema, folder, files of a part): the events in parts of growing time, written one after the other as a capture would.

    All parts have the same number of files, so a micro-batch of so many is a whole part: a file for itself would
    let the watermark pass the other files of its part.
    """
    e = table(spark, d, "events")
    path = scratch_path(spark, "events")
    cuts = e.select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t")).approxQuantile(
        "t", [i / parts for i in range(1, parts)], 0.01
    )
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [float("-inf"), *cuts, float("inf")]
    files = max(ceil(e.count() / parts / file_rows), 1)
    for low, high in zip(edges, edges[1:]):
        part = e.filter((t > F.lit(low)) & (t <= F.lit(high)))
        part.repartition(files).write.mode("append").parquet(path)
    return e.schema, path, files


def event_stream(spark, d, files_per_trigger=8):
    schema, path, _ = event_files(spark, d)
    return stream_table(spark, path, schema, files_per_trigger=files_per_trigger)


def assembly_run(spark, d):
    schema, path, files = event_files(spark, d)
    arriving = packets(stream_table(spark, path, schema, files_per_trigger=files))
    with rocksdb_state(spark):
        return run_to_end(assemble_stream(arriving, KEY, "ts", "value", 3600, 4 * 3600), "assembly")


@query("h1_stream_flow_assembly", FLOW_SQL)
def _(spark, d):
    """Closed flows of the stream and, as at shutdown, those that its state still holds."""
    run = assembly_run(spark, d)
    closed = spark.read.parquet(run.output).drop("closed")
    rest = remaining_flows(spark, run.checkpoint, KEY, 3600, 4 * 3600).drop("followed")
    return flow_rows(finish_flows(closed.unionByName(rest), KEY))


@query("h2_stream_sweep", f"""WITH RECURSIVE {CHAIN}, flows AS (SELECT user_id, side, flow_start, max(ts) AS flow_end, count(*) AS packets FROM gaps GROUP BY 1, 2, 3),
    swept AS (SELECT *, flow_start < max(flow_start) OVER (PARTITION BY user_id, side) AS followed,
      least(flow_end + INTERVAL 1 HOUR, flow_start + INTERVAL 4 HOUR) <= max(flow_end) OVER () - INTERVAL 5 SECOND AS expired FROM flows)
    SELECT user_id, side, strftime(flow_start, '%Y-%m-%d %H:%M:%S.%f') AS flow_start, packets FROM swept WHERE followed OR expired""")
def _(spark, d):
    """What packets and timers have closed when the input ends; flows that nothing has followed stay in the state."""
    run = assembly_run(spark, d)
    followed = remaining_flows(spark, run.checkpoint, KEY, 3600, 4 * 3600).filter("followed").drop("followed")
    closed = finish_flows(spark.read.parquet(run.output).drop("closed").unionByName(followed), KEY)
    return closed.select(*KEY, F.date_format("flow_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("flow_start"), "packets")


def scored_stream(spark, d):
    return add_ranking(weigh(event_stream(spark, d)), CLASSES)


@query("h5_stream_scores", f"""WITH {SCORED} SELECT event_id, c1 AS predicted_class, round(q1, 6) AS confidence, level AS threat_level FROM scored""")
def _(spark, d):
    rows = scored_stream(spark, d).select("event_id", "predicted_class", "confidence", "threat_level")
    return rounded(spark.read.parquet(run_to_end(rows, "scores").output))


def flow_files(rows):
    """(rows of a file, files of a micro-batch): eight micro-batches or so, while a file has 2,000 to 200,000 rows."""
    n = rows.count()
    size = min(max(2000, ceil(n / 192)), 200_000)
    return size, max(2, min(n // size // 8, 24))


@query("h5_stream_model_scores", "SELECT event_id, true AS same_as_batch FROM events")
def _(spark, d):
    """Preparation and scoring of a stream with a stored forest, row by row as in the batch."""
    scorer, store, path = small_scorer(spark, d), scratch_path(spark, "stream-scorer"), scratch_path(spark, "stream-flows")
    learn.save_scorer(spark, scorer, store)
    rows = flows(spark, d)
    size, files = flow_files(rows)
    rows.write.option("maxRecordsPerFile", size).parquet(path)
    columns = ["event_id", "predicted_class", "threat_level", F.round("confidence", 9).alias("confidence")]
    stream = score_stream(stream_table(spark, path, rows.schema, files_per_trigger=files), learn.load_scorer(spark, store))
    live = spark.read.parquet(run_to_end(stream.select(*columns), "model-scores").output)
    return twice(live.unionByName(scorer.score(rows).select(*columns)), "event_id", "same_as_batch")


@query("h4_micro_batches", f"""WITH {SCORED} SELECT level AS threat_level, count(*) AS n, 3 AS batches FROM scored GROUP BY 1""")
def _(spark, d):
    """One part for each micro-batch gives the same rows as any other batch size."""
    schema, path, files = event_files(spark, d)
    rows = add_ranking(weigh(stream_table(spark, path, schema, files_per_trigger=files)), CLASSES)
    run = run_to_end(rows.select("event_id", "threat_level"), "micro")
    batches = progress_table(spark, run).filter("input_rows > 0").count()
    out = spark.read.parquet(run.output).groupBy("threat_level").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("batches", F.lit(batches))


@query("h9_live_run_and_drain", f"""WITH {SCORED} SELECT event_id, level AS threat_level FROM scored""")
def _(spark, d):
    """A timed query that is drained and stopped leaves every row that had arrived."""
    out, checkpoint = scratch_path(spark, "live-out"), scratch_path(spark, "live-ckpt")
    drain(start_live(scored_stream(spark, d).select("event_id", "threat_level"), out, checkpoint, every="500 milliseconds"))
    return spark.read.parquet(out)


@query("h6_stream_alerts", f"""WITH {SCORED} SELECT event_id, c1 AS predicted_class, level AS threat_level FROM scored WHERE level <> 'GREEN'""")
def _(spark, d):
    rows = alerts(scored_stream(spark, d)).select("event_id", "predicted_class", "threat_level")
    return spark.read.parquet(run_to_end(rows, "alerts").output)


@query("h6_stream_level_counts", f"""WITH {SCORED} SELECT level AS threat_level, count(*) AS n FROM scored GROUP BY 1""")
def _(spark, d):
    run = run_versions(level_totals(scored_stream(spark, d)), "levels")
    return latest(spark, run, ["threat_level"])


@query("h7_stream_minute_totals", f"""WITH {SCORED}, {MINUTES} SELECT minute, total, threats, suspicious, clean, CAST(benign AS BIGINT) AS benign, CAST(ddos AS BIGINT) AS ddos,
    correct, labelled, CASE WHEN labelled = 0 THEN 0 ELSE round(correct * 100.0 / labelled, 6) END AS accuracy_pct FROM minutes""")
def _(spark, d):
    totals = minute_totals(scored_stream(spark, d), "ts", "1 day", classes=CLASSES, actual="actual_label")
    rows = latest(spark, run_versions(totals, "minutes"), ["minute"])
    by_class = [F.col("by_class")[c].alias(c.lower()) for c in ("Benign", "DDoS")]
    return rounded(rows.select("*", *by_class).drop("by_class").withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm")))


@query("h7_closed_minutes", f"""WITH {SCORED}, {MINUTES} SELECT minute, total, threats, suspicious, clean, CAST(benign AS BIGINT) AS benign, CAST(ddos AS BIGINT) AS ddos,
    correct, labelled, CASE WHEN labelled = 0 THEN 0 ELSE round(correct * 100.0 / labelled, 6) END AS accuracy_pct FROM minutes
    WHERE strptime(minute, '%Y-%m-%d %H:%M') + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, d):
    """Minutes that the watermark has passed, each written once by an append run and never changed."""
    totals = minute_totals(scored_stream(spark, d), "ts", "1 day", classes=CLASSES, actual="actual_label")
    rows = spark.read.parquet(run_to_end(totals, "closed-minutes").output)
    by_class = [F.col("by_class")[c].alias(c.lower()) for c in ("Benign", "DDoS")]
    return rounded(rows.select("*", *by_class).drop("by_class").withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm")))


@query("h8_stream_session_totals", f"""WITH {SCORED} SELECT strftime(ts, '%Y-%m-%d') AS session, c1 AS class, count(*) AS n FROM scored GROUP BY 1, 2""")
def _(spark, d):
    rows = scored_stream(spark, d).withColumn("session", F.date_format("ts", "yyyy-MM-dd"))
    run = run_versions(class_totals(rows, ["session"]), "sessions")
    return latest(spark, run, ["session", "class"])


LINE_HEADER = ["event_id", "Src IP", "Label", "value"]


def line_files(spark, d):
    """Events as CSV lines: most fit the header, some are short, some long, some hold a word for a number."""
    n = F.col("event_id")
    head = F.concat_ws(",", n.cast("string"), F.col("user_id").cast("string"))
    kind = F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    line = (
        F.when(n % 50 == 7, F.concat_ws(",", head, "event_type"))
        .when(n % 50 == 9, F.concat_ws(",", head, F.col("event_type"), F.lit("1.5,surplus")))
        .when(n % 50 == 11, F.concat_ws(",", head, kind, F.lit("many")))
        .otherwise(F.concat_ws(",", head, kind, cents))
    )
    path = scratch_path(spark, "lines")
    rows = table(spark, d, "events").select(line.alias(",".join(LINE_HEADER)))
    rows.write.option("header", "true").option("sep", "\u0001").option("quote", "").csv(path)
    return path


@query("a17_replay_labelled_csv", """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS src_ip, event_type AS actual_label FROM events
    WHERE event_id % 50 NOT IN (7, 9)""")
def _(spark, d):
    rows = replay_csv(spark, line_files(spark, d), LINE_HEADER)
    out = run_to_end(rows.select("event_id", F.col("identifiers")["Src IP"].alias("src_ip"), "actual_label"), "replay")
    return spark.read.parquet(out.output)


@query("h10_dead_letters", """SELECT CASE WHEN event_id % 50 IN (7, 9, 11) THEN 'rejected' ELSE 'good' END AS status,
    CASE event_id % 50 WHEN 7 THEN 'wrong number of fields' WHEN 9 THEN 'wrong number of fields' WHEN 11 THEN 'value: not readable: many' END AS reason,
    CASE WHEN event_id % 50 NOT IN (7, 9) THEN event_id END AS event_id, CASE WHEN event_id % 50 NOT IN (7, 9, 11) THEN CAST(round(value * 100) AS DOUBLE) END AS value,
    CASE event_id % 50 WHEN 7 THEN event_id || ',' || user_id || ',' || event_type WHEN 9 THEN event_id || ',' || user_id || ',' || event_type || ',1.5,surplus' END AS line
    FROM events""")
def _(spark, d):
    """Every input line is a good row or a dead letter."""
    rows = replay_csv(spark, line_files(spark, d), LINE_HEADER, keep_malformed=True)
    checked = typed_or_rejected(rows.drop("identifiers"), {"event_id": T.LongType(), "value": T.DoubleType()})
    out = spark.read.parquet(run_to_end(checked, "letters").output)
    line = F.when(F.col("reason") == "wrong number of fields", F.col("raw"))
    return out.select("status", "reason", "event_id", "value", line.alias("line"))


@query("h11_stream_progress", "SELECT count(*) AS input_rows, CAST(0 AS BIGINT) AS late_rows FROM events")
def _(spark, d):
    run = run_to_end(scored_stream(spark, d).select("event_id", "threat_level"), "progress")
    return progress_table(spark, run).agg(
        F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows")
    )


@query("a16_stream_flow_sink", """SELECT event_id, user_id, event_type, value FROM events""")
def _(spark, d):
    rows = event_stream(spark, d).select("event_id", "user_id", "event_type", "value")
    run = run_to_end(rows, "flowfile", fmt="csv", options={"header": "true"})
    return spark.read.schema(rows.schema).option("header", "true").csv(run.output)
