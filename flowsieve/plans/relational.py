"""Queries for joins (F) and for ranking, ordering and set operations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import clean, correlate, encode, evaluate, lookups, rollup, sample
from flowsieve.operators.balance import oversampling_targets
from flowsieve.plans.fixtures import (
    FLOWS, IMPORTANCES, MAPPED, SCORED, TRIALS, WIDE, WIDE_FEATURES, flows, importances, scored, trials, wide,
)
from flowsieve.plans.profiles import CM, FINITE, PAIRS, R6, RANKED, VARIANCES, confusion, pairs
from flowsieve.plans.registry import query, rounded, table
from flowsieve.session import scratch_path
from flowsieve.sources.tables import preview, save_bucketed, split_roles


@query("f1_label_lookup", f"""WITH {FLOWS}, {MAPPED} SELECT event_id, "Label" AS raw_label, cls AS class FROM mapped""")
def _(spark, d):
    """Left join on a mapping table instead of the literal map of c1."""
    rows = flows(spark, d).select("event_id", F.col("Label").alias("raw_label"))
    return lookups.map_labels(rows, lookups.mapping_table(spark), "raw_label")


@query("f2_features_with_labels", f"""WITH {FLOWS} SELECT event_id, k, hr, "Label" FROM flows""")
def _(spark, d):
    roles = split_roles(flows(spark, d).select("event_id", "Flow ID", "k", "hr", "Label"), ["event_id"])
    return lookups.align_rows(roles.features, roles.labels, ["event_id"])


@query("f2_bucketed_stage_tables", f"""WITH {FLOWS} SELECT event_id, k, hr, "Label" FROM flows""")
def _(spark, d):
    """The same from two stored stage tables, whose rows already lie together."""
    return lookups.align_rows(*bucketed_views(spark, d), ["event_id"])


def bucketed_views(spark, d, buckets=8):
    roles = split_roles(flows(spark, d).select("event_id", "Flow ID", "k", "hr", "Label"), ["event_id"])
    return [save_bucketed(view, scratch_path(spark, "bucketed"), ["event_id"], buckets) for view in (roles.features, roles.labels)]


@query("f3_predictions_with_identifiers", f"""WITH {SCORED} SELECT event_id, user_id, actual AS actual_label, c1 AS predicted_class,
    round(q1, 6) AS confidence FROM scored""")
def _(spark, d):
    """No join: identifiers and labels ride along through scoring."""
    return rounded(scored(spark, d).select("event_id", "user_id", "actual_label", "predicted_class", "confidence"))


@query("f4_feature_pairs", f"""WITH {WIDE}, {PAIRS} SELECT i, j, f1, f2, n FROM pairs""")
def _(spark, d):
    return correlate.feature_pairs(wide(spark, d), WIDE_FEATURES)


TOP5 = "top AS (SELECT feature FROM variances ORDER BY variance DESC, feature LIMIT 5)"


@query("f5_pairs_within_features", f"""WITH {WIDE}, {PAIRS}, {VARIANCES}, {TOP5} SELECT {R6} FROM pairs
    WHERE f1 IN (SELECT feature FROM top) AND f2 IN (SELECT feature FROM top)""")
def _(spark, d):
    return rounded(correlate.pairs_within(pairs(spark, d), correlate.top_variance(wide(spark, d), WIDE_FEATURES, 5)))


@query("f6_remaining_features", f"""WITH {WIDE}, {VARIANCES}, {TOP5} SELECT feature FROM variances WHERE feature NOT IN (SELECT feature FROM top)""")
def _(spark, d):
    everything = correlate.variances(wide(spark, d), WIDE_FEATURES).select("feature")
    top = correlate.top_variance(wide(spark, d), WIDE_FEATURES, 5)
    return correlate.remaining_features(everything, top)


@query("e5_correlated_features", f"""WITH RECURSIVE {WIDE}, {PAIRS},
    strong AS (SELECT f1, f2, row_number() OVER (ORDER BY j, i) AS rn FROM pairs WHERE abs(r) >= 0.99),
    walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS gone
      UNION ALL SELECT s.rn, CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN gone ELSE list_append(gone, f2) END
      FROM walk JOIN strong s ON s.rn = walk.rn + 1)
    SELECT unnest(gone) AS feature FROM (SELECT gone FROM walk ORDER BY rn DESC LIMIT 1)""")
def _(spark, d):
    dropped = correlate.correlated_features_to_drop(pairs(spark, d), 0.99)
    names = F.array(*[F.lit(f) for f in dropped]) if dropped else F.array().cast("array<string>")
    return wide(spark, d).agg(names.alias("f")).select(F.explode("f").alias("feature"))


@query("e6_clamped_selection", f"""WITH {IMPORTANCES}, {RANKED}, above AS (SELECT count_if(importance >= 0.04) AS n FROM imp)
    SELECT feature, round(importance, 6) AS importance, rank FROM imp, above
    WHERE rank <= greatest(8, least(12, n))""")
def _(spark, d):
    from flowsieve.operators.learn import clamp_selection

    return rounded(clamp_selection(importances(spark, d), 0.04, 8, 12))


def targets_sql(rule):
    return f"""WITH {FLOWS}, {MAPPED}, counts AS (SELECT cls AS class, count(*) AS n FROM mapped GROUP BY 1),
    second AS (SELECT n AS reference FROM (SELECT n, row_number() OVER (ORDER BY n DESC, class) AS rn FROM counts) WHERE rn = 2),
    t AS (SELECT class, n, {rule} AS target FROM counts, second)
    SELECT class, n, CAST(target AS BIGINT) AS target, CAST(target - n AS BIGINT) AS extra FROM t WHERE target > n"""


@query("e3_dynamic_targets", targets_sql("CASE WHEN n < reference THEN floor(n + (reference - n) / 2.0) ELSE n END"))
def _(spark, d):
    return oversampling_targets(clean.consolidate(flows(spark, d)), "Label", "dynamic")


@query("e3_tiered_targets", targets_sql("""CASE class WHEN 'Botnet' THEN floor((SELECT sum(n) FROM counts) * 0.15)
    WHEN 'Brute Force' THEN floor((SELECT sum(n) FROM counts) * 0.02) ELSE n END"""))
def _(spark, d):
    return oversampling_targets(
        clean.consolidate(flows(spark, d)), "Label", "tiered", shares={"Botnet": 0.15, "Brute Force": 0.02}
    )


@query("e3_uniform_targets", targets_sql("floor((SELECT sum(n) FROM counts) * 0.1)"))
def _(spark, d):
    return oversampling_targets(clean.consolidate(flows(spark, d)), "Label", "uniform", share=0.1)


@query("g1_cumulative_by_rank", f"""WITH {IMPORTANCES}, {RANKED} SELECT feature, rank, round(cumulative, 6) AS cumulative FROM imp""")
def _(spark, d):
    return rounded(evaluate.importance_table(importances(spark, d)).select("feature", "rank", "cumulative"))


@query("g2_second_largest_class", f"""WITH {FLOWS} SELECT class, n FROM (SELECT "Label" AS class, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, "Label") AS rn FROM flows GROUP BY 1) WHERE rn = 2""")
def _(spark, d):
    from flowsieve.operators.balance import second_largest

    return second_largest(flows(spark, d), "Label")


RUNNING = """run AS (SELECT user_id % 10 AS session, event_id, CAST(sum(CASE WHEN c1 = actual THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct,
    count(*) OVER w AS seen FROM scored WINDOW w AS (PARTITION BY user_id % 10 ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


@query("g3_running_accuracy", f"""WITH {SCORED}, {RUNNING} SELECT session, event_id, correct, seen, round(correct * 100.0 / seen, 6) AS accuracy_pct FROM run""")
def _(spark, d):
    rows = scored(spark, d).withColumn("session", F.col("user_id") % 10)
    return rounded(rollup.running_accuracy(rows, ["session"], "event_id"))


@query("g4_top_pairs", f"""WITH {SCORED}, {CM} SELECT actual, predicted, n FROM cm ORDER BY n DESC, actual, predicted LIMIT 5""")
def _(spark, d):
    return confusion(spark, d).orderBy(F.desc("n"), "actual", "predicted").limit(5)


@query("g5_top_in_row", f"""WITH {SCORED} SELECT event_id, c1, c2, c3 FROM scored""")
def _(spark, d):
    top = F.col("top3")
    return scored(spark, d).select("event_id", *[top[i]["class"].alias(f"c{i + 1}") for i in range(3)])


@query("g6_paging", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100""")
def _(spark, d):
    rows = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return lookups.page(rows, [F.desc("o_orderkey")], 50, 100).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("g7_first_hundred", f"""WITH {SCORED} SELECT event_id, c1 AS predicted_class FROM scored ORDER BY event_id LIMIT 100""")
def _(spark, d):
    return preview(scored(spark, d), ["event_id"], 100).select("event_id", "predicted_class")


@query("g8_union_by_name", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")
    )
    return c.unionByName(s, allowMissingColumns=True)


@query("g9_label_union", f"""WITH {SCORED} SELECT actual AS label FROM scored UNION SELECT c1 FROM scored""")
def _(spark, d):
    return evaluate.label_union(scored(spark, d), "actual_label", "predicted_class")


@query("g10_ranked_results", f"""WITH {TRIALS} SELECT max_depth, max_features, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, fits,
    rank() OVER (ORDER BY mean_score DESC) AS rank FROM trials QUALIFY rank <= 10""")
def _(spark, d):
    return rounded(evaluate.rank_results(trials(spark, d), "mean_score", 10))
