"""Queries for row repair (B) and encoding, ranking and conditional columns (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import threat
from flowsieve.functions.bands import correlation_band, imbalance_severity, minute_label, minute_of
from flowsieve.operators import clean, encode, profile, reports, score
from flowsieve.operators.correlate import correlation_pairs
from flowsieve.plans.fixtures import (
    CLASSES, FLOWS, MAPPED, SCORED, SHOWN_SQL, WIDE, WIDE_FEATURES, flows, probabilities, scored, shown, wide,
)
from flowsieve.plans.registry import query, rounded, table
from flowsieve.schema import FIVE_CLASSES, SIX_CLASSES

MISSING = "(value IS NULL OR isnan(value))"
INFINITE = "(value IS NOT NULL AND isinf(value))"


@query("b1_drop_identifiers", f"""WITH {FLOWS} SELECT event_id, user_id, "Dst Port", "Protocol", k, hr, "Label" FROM flows""")
def _(spark, d):
    return clean.drop_identifiers(flows(spark, d)).drop("value", "ts")


@query("b2_drop_missing_rows", f"""WITH {FLOWS} SELECT event_id, {SHOWN_SQL} AS shown FROM flows WHERE NOT {MISSING}""")
def _(spark, d):
    return clean.drop_missing_rows(flows(spark, d)).select("event_id", shown().alias("shown"))


@query("b3_drop_infinite_rows", f"""WITH {FLOWS} SELECT event_id, {SHOWN_SQL} AS shown FROM flows WHERE NOT {INFINITE}""")
def _(spark, d):
    return clean.drop_infinite_rows(flows(spark, d)).select("event_id", shown().alias("shown"))


@query("b4_deduplicate", f"""WITH {FLOWS} SELECT DISTINCT "Protocol", k, hr, "Label" FROM flows""")
def _(spark, d):
    return clean.deduplicate(clean.drop_identifiers(flows(spark, d)).select("Protocol", "k", "hr", "Label"))


@query("b5_standardise_port_protocol", f"""WITH {FLOWS}
    SELECT event_id, TRY_CAST("Dst Port" AS DOUBLE) AS "Dst Port", CAST("Protocol" AS VARCHAR) AS "Protocol"
    FROM flows WHERE TRY_CAST("Dst Port" AS DOUBLE) IS NOT NULL""")
def _(spark, d):
    return clean.standardise_port_protocol(flows(spark, d)).select("event_id", "Dst Port", "Protocol")


@query("b6_drop_classes", f"""WITH {FLOWS}, {MAPPED}
    SELECT event_id, cls AS "Label" FROM mapped WHERE cls NOT IN ('__DROP__', 'Infilteration')""")
def _(spark, d):
    rows = clean.consolidate(flows(spark, d))
    return clean.drop_classes(rows, "Label", FIVE_CLASSES).select("event_id", "Label")


@query("e11_six_class_variant", f"""WITH {FLOWS}, {MAPPED}
    SELECT event_id, cls AS "Label" FROM mapped WHERE cls <> '__DROP__'""")
def _(spark, d):
    rows = clean.consolidate(flows(spark, d))
    return clean.drop_classes(rows, "Label", SIX_CLASSES).select("event_id", "Label")


@query("b7_zero_fill", f"""WITH {FLOWS}
    SELECT event_id, CASE WHEN {MISSING} OR isinf(value) THEN 0.0 ELSE value END AS value,
      coalesce(TRY_CAST("Dst Port" AS DOUBLE), 0.0) AS "Dst Port", k FROM flows""")
def _(spark, d):
    return clean.zero_fill(flows(spark, d), ["value", "Dst Port", "k"]).select("event_id", "value", "Dst Port", "k")


LIVE = """live AS (SELECT event_id, '10.0.0.' || CAST(user_id AS VARCHAR) AS src_ip,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE '10.1.0.' || CAST(event_id % 250 AS VARCHAR) END AS dst_ip,
    (user_id * 37) % 65536 AS src_port, 443 AS dst_port, value AS flow_duration,
    CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 13 AS VARCHAR) END AS idle_max, value AS internal_note
    FROM events)"""


def live(spark, d):
    """Records with live extractor field names; there is no protocol field."""
    n = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"),
        F.when(n % 7 != 0, F.concat(F.lit("10.1.0."), (n % 250).cast("string"))).alias("dst_ip"),
        ((F.col("user_id") * 37) % 65536).alias("src_port"),
        F.lit(443).alias("dst_port"),
        F.col("value").alias("flow_duration"),
        F.when(n % 11 == 0, "n/a").otherwise((n % 13).cast("string")).alias("idle_max"),
        F.col("value").alias("internal_note"),
    )


@query("b8_rename_live_fields", f"""WITH {LIVE} SELECT src_ip AS "Src IP", dst_ip AS "Dst IP", src_port AS "Src Port",
    dst_port AS "Dst Port", flow_duration AS "Flow Duration", idle_max AS "Idle Max" FROM live""")
def _(spark, d):
    return clean.rename_live_fields(live(spark, d))


@query("b9_seconds_to_micros", f"""WITH {LIVE} SELECT event_id, round(flow_duration * 1000000, 6) AS flow_duration,
    CASE WHEN idle_max = 'n/a' THEN -1.0 ELSE CAST(idle_max AS DOUBLE) * 1000000 END AS idle_max,
    idle_max = 'n/a' AS left_as_is FROM live""")
def _(spark, d):
    rows = clean.seconds_to_micros(live(spark, d))
    text = F.col("idle_max")
    return rounded(
        rows.select(
            "event_id", "flow_duration",
            F.coalesce(text.try_cast("double"), F.lit(-1.0)).alias("idle_max"),
            (text == "n/a").alias("left_as_is"),
        )
    )


@query("b10_flow_id", f"""WITH {LIVE} SELECT event_id, src_ip || '-' || coalesce(dst_ip, '?') || '-' ||
    CAST(src_port AS VARCHAR) || '-' || CAST(dst_port AS VARCHAR) || '-?' AS "Flow ID" FROM live""")
def _(spark, d):
    return clean.add_flow_id(live(spark, d)).select("event_id", "Flow ID")


@query("b11_nest_identifiers", f"""WITH {FLOWS} SELECT event_id, "Flow ID" AS flow_id, "Src IP" AS src_ip,
    "Dst Port" AS dst_port, "Protocol" AS protocol FROM flows""")
def _(spark, d):
    ids = F.col("identifiers")
    return clean.nest_identifiers(flows(spark, d)).select(
        "event_id", ids["Flow ID"].alias("flow_id"), ids["Src IP"].alias("src_ip"),
        ids["Dst Port"].alias("dst_port"), ids["Protocol"].alias("protocol"),
    )


@query("b12_align_features", f"""WITH {FLOWS} SELECT event_id, hr, CAST(0 AS DOUBLE) AS "Flow Duration", k,
    CAST("Protocol" AS DOUBLE) AS "Protocol" FROM flows""")
def _(spark, d):
    return clean.align_features(flows(spark, d), ["hr", "Flow Duration", "k", "Protocol"], keep=["event_id"])


@query("b13_select_features", f"""WITH {FLOWS} SELECT event_id, k, hr FROM flows""")
def _(spark, d):
    return clean.select_features(flows(spark, d), ["k", "hr"], keep=["event_id"])


@query("b14_attacks", f"""WITH {SCORED} SELECT event_id, c1 AS predicted_class FROM scored WHERE c1 <> 'Benign'""")
def _(spark, d):
    return scored(spark, d).filter(threat.is_attack("predicted_class")).select("event_id", "predicted_class")


@query("b_clean_training", f"""WITH {FLOWS}, {MAPPED}, kept AS (
    SELECT DISTINCT user_id, "Dst Port", "Protocol", value, k, hr, cls, "Label" FROM mapped
    WHERE "Label" <> 'Label' AND NOT {MISSING} AND NOT {INFINITE})
    SELECT user_id, CAST("Dst Port" AS DOUBLE) AS "Dst Port", CAST("Protocol" AS VARCHAR) AS "Protocol", value, k, hr,
      cls AS "Label" FROM kept WHERE "Dst Port" <> 'n/a' AND cls NOT IN ('__DROP__', 'Infilteration')""")
def _(spark, d):
    """Every cleaning step in training order."""
    rows = flows(spark, d).drop("event_id", "ts")
    return clean.clean_training(rows)


@query("c1_consolidate_labels", f"""WITH {FLOWS}, {MAPPED} SELECT event_id, cls AS "Label" FROM mapped""")
def _(spark, d):
    return clean.consolidate(flows(spark, d)).select("event_id", "Label")


@query("c2_one_hot_all", f"""WITH {FLOWS} SELECT event_id, CAST("Protocol" = 0 AS INT) AS "Protocol_0",
    CAST("Protocol" = 17 AS INT) AS "Protocol_17", CAST("Protocol" = 6 AS INT) AS "Protocol_6" FROM flows""")
def _(spark, d):
    rows = encode.one_hot_all(flows(spark, d))
    return rows.select("event_id", *[c for c in rows.columns if c.startswith("Protocol_")])


@query("c3_one_hot_fixed", f"""WITH {FLOWS} SELECT event_id, CAST(p = 0 AS INT) AS "Protocol_0",
    CAST(p = 6 AS INT) AS "Protocol_6", CAST(p = 17 AS INT) AS "Protocol_17"
    FROM (SELECT event_id, coalesce(CAST(trunc(TRY_CAST("Dst Port" AS DOUBLE)) AS BIGINT), 0) % 20 AS p FROM flows)""")
def _(spark, d):
    rows = flows(spark, d).select(
        "event_id",
        (F.coalesce(F.col("Dst Port").try_cast("double").cast("long"), F.lit(0)) % 20).cast("string").alias("Protocol"),
    )
    return encode.one_hot_fixed(rows)


@query("c4_encode_labels", f"""WITH {FLOWS}, {MAPPED},
    names AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS idx FROM (SELECT DISTINCT cls FROM mapped))
    SELECT event_id, idx AS label_index, cls AS class FROM mapped JOIN names USING (cls)""")
def _(spark, d):
    rows = clean.consolidate(flows(spark, d))
    classes = encode.class_list(rows)
    coded = encode.encode_label(rows, classes).select("event_id", F.col("label_index").cast("long"))
    return encode.decode_label(coded, classes, "label_index")


def scale_sql(center, scale):
    parts = []
    for c in ("k", "hr"):
        s = scale.format(c=c)
        parts.append(f"round(({c} - (SELECT {center.format(c=c)} FROM flows)) / "
                     f"(SELECT CASE WHEN {s} = 0 THEN 1 ELSE {s} END FROM flows), 6) AS {c}")
    return f"WITH {FLOWS} SELECT event_id, {', '.join(parts)} FROM flows"


@query("c5_standard_scaling", scale_sql("avg({c})", "stddev_pop({c})"))
def _(spark, d):
    rows = flows(spark, d).select("event_id", "k", "hr")
    return rounded(encode.apply_scaler(rows, encode.fit_scaler(rows, ["k", "hr"])))


@query("c6_minmax_scaling", scale_sql("min({c})", "(max({c}) - min({c}))"))
def _(spark, d):
    rows = flows(spark, d).select("event_id", "k", "hr")
    return rounded(encode.apply_scaler(rows, encode.fit_scaler(rows, ["k", "hr"], "minmax")))


@query("c7_scaling_check", f"""WITH {FLOWS} SELECT round(least(avg(k), avg(hr)), 6) AS min_mean,
    round(greatest(avg(k), avg(hr)), 6) AS max_mean, round(least(stddev_pop(k), stddev_pop(hr)), 6) AS min_std,
    round(greatest(stddev_pop(k), stddev_pop(hr)), 6) AS max_std FROM flows""")
def _(spark, d):
    return rounded(encode.scaling_check(flows(spark, d), ["k", "hr"]))


TOP_SQL = """event_id, c1, round(q1, 6) AS q1, c2, round(q2, 6) AS q2, c3, round(q3, 6) AS q3"""


def flat_top(df, top="top3", *more):
    cols = []
    for n in (1, 2, 3):
        cols += [threat.nth_class(F.col(top), n).alias(f"c{n}"), threat.nth_conf(F.col(top), n).alias(f"q{n}")]
    return rounded(df.select("event_id", *cols, *more))


@query("c8_top_classes", f"WITH {SCORED} SELECT {TOP_SQL} FROM scored")
def _(spark, d):
    return flat_top(scored(spark, d))


@query("c9_pad_and_flatten_top", f"""WITH {SCORED} SELECT event_id, c1, round(q1, 6) AS q1,
    CASE WHEN event_id % 2 = 0 THEN c2 ELSE '-' END AS c2, round(CASE WHEN event_id % 2 = 0 THEN q2 ELSE 0 END, 6) AS q2,
    '-' AS c3, CAST(0 AS DOUBLE) AS q3, CASE WHEN event_id % 2 = 0 THEN c2 ELSE '' END AS top2_prediction,
    round(CASE WHEN event_id % 2 = 0 THEN q2 ELSE 0 END, 6) AS top2_confidence FROM scored""")
def _(spark, d):
    rows = scored(spark, d).withColumn(
        "top3", F.slice("top3", F.lit(1), F.when(F.col("event_id") % 2 == 0, 2).otherwise(1))
    )
    padded = score.flatten_top2(rows).withColumn("padded", threat.pad_top(F.col("top3")))
    return flat_top(padded, "padded", "top2_prediction", "top2_confidence")


@query("c10_threat_level", f"WITH {SCORED} SELECT event_id, level AS threat_level FROM scored")
def _(spark, d):
    return scored(spark, d).select("event_id", "threat_level")


@query("c11_attack_label_and_score", f"""WITH {SCORED} SELECT l.event_id,
    CAST(l.actual <> 'Benign' AS INT) AS attack, round(1 - p, 6) AS attack_score
    FROM labelled l JOIN long USING (event_id) WHERE idx = 0""")
def _(spark, d):
    rows = encode.encode_label(probabilities(spark, d), CLASSES, "actual_label", "y")
    return rounded(rows.select("event_id", score.attack_label("y").alias("attack"), score.attack_score().alias("attack_score")))


@query("c12_minute_key", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS minute,
    strftime(ts, '%H-%M') AS minute_label FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    minute = F.date_format(minute_of(F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", minute.alias("minute"), minute_label(F.col("ts")).alias("minute_label"))


@query("c13_report_rows", f"""WITH {SCORED} SELECT event_id,
    rpad(strftime(ts, '%Y-%m-%d %H:%M:%S'), 19, ' ') || ' | ' || rpad('10.0.0.' || CAST(user_id AS VARCHAR), 18, ' ')
    || ' | ' || rpad('?', 8, ' ') || ' | ' || rpad('?', 18, ' ') || ' | ' || rpad('?', 8, ' ') || ' | ' || rpad('?', 8, ' ')
    || ' | ' || rpad(c1, 14, ' ') || ' | ' || rpad(printf('%.1f%%', round(q1*100, 1)), 8, ' ')
    || ' | ' || rpad(c2, 14, ' ') || ' | ' || rpad(printf('%.1f%%', round(q2*100, 1)), 8, ' ')
    || ' | ' || rpad(c3, 14, ' ') || ' | ' || rpad(printf('%.1f%%', round(q3*100, 1)), 8, ' ')
    || ' | ' || rpad(coalesce(actual, '?'), 14, ' ') AS line FROM scored""")
def _(spark, d):
    rows = scored(spark, d).withColumn("Src IP", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    return rows.select("event_id", reports.report_row(rows, "ts", "actual_label").alias("line"))


@query("c14_correlation_band", f"""WITH {WIDE} SELECT band, count(*) AS pairs FROM (
    SELECT CASE WHEN abs(r) >= 0.99 THEN 'perfect' WHEN abs(r) >= 0.95 THEN 'strong' WHEN abs(r) >= 0.9 THEN 'high'
      ELSE 'none' END AS band FROM (
      {' UNION ALL '.join(f"SELECT corr({a}, {b}) AS r FROM wide WHERE abs({a}) < 'Infinity'::DOUBLE AND abs({b}) < 'Infinity'::DOUBLE"
        for i, a in enumerate(WIDE_FEATURES) for b in WIDE_FEATURES[i + 1:])})) GROUP BY band""")
def _(spark, d):
    pairs = correlation_pairs(wide(spark, d), WIDE_FEATURES)
    return pairs.groupBy(correlation_band(F.col("r")).alias("band")).agg(F.count(F.lit(1)).alias("pairs"))


@query("c15_imbalance_severity", f"""WITH {FLOWS}, counts AS (SELECT "Label" AS class, count(*) AS n FROM flows GROUP BY 1)
    SELECT class, CASE WHEN r > 1000 THEN 'EXTREME' WHEN r > 100 THEN 'HIGH' WHEN r > 10 THEN 'MODERATE' ELSE 'LOW' END AS severity
    FROM (SELECT class, (SELECT max(n) FROM counts) / CAST(n AS DOUBLE) AS r FROM counts)""")
def _(spark, d):
    shares = profile.class_distribution(flows(spark, d))
    return shares.select("class", imbalance_severity(F.col("imbalance_ratio")).alias("severity"))
