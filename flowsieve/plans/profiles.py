"""Queries for profiling and evaluation (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import correlate, encode, evaluate, profile, rollup, sample
from flowsieve.operators.clean import consolidate
from flowsieve.plans.fixtures import (
    CLASSES, FLOWS, IMPORTANCES, MAPPED, SCORED, TRIALS, WIDE, WIDE_FEATURES,
    flows, importances, probabilities, scored, trials, wide,
)
from flowsieve.plans.registry import query, rounded, table

COLUMNS = ["event_id", "user_id", "Flow ID", "Src IP", "Dst Port", "Protocol", "value", "k", "hr", "Label"]
TYPES = ["bigint", "bigint", "string", "string", "string", "int", "double", "double", "double", "string"]
MISSING = "(value IS NULL OR isnan(value))"
INFINITE = "(value IS NOT NULL AND isinf(value))"


def plain(spark, d):
    return flows(spark, d).drop("ts")


COUNTS = 'counts AS (SELECT "Label" AS class, count(*) AS n FROM flows GROUP BY 1)'


@query("d1_class_distribution", f"""WITH {FLOWS}, {COUNTS} SELECT class, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
    round(CAST(max(n) OVER () AS DOUBLE) / n, 6) AS imbalance_ratio, n * 100.0 / sum(n) OVER () < 1 AS below_one_percent FROM counts""")
def _(spark, d):
    return rounded(profile.class_distribution(flows(spark, d)))


SUMMARY = """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes,
    (SELECT class FROM counts ORDER BY n DESC, class LIMIT 1) AS majority_class,
    (SELECT class FROM counts ORDER BY n, class LIMIT 1) AS minority_class,
    round(CAST(max(n) AS DOUBLE) / min(n), 6) AS max_imbalance_ratio,
    round(1 - sum(CAST(n AS DOUBLE) * n) / (sum(n) * CAST(sum(n) AS DOUBLE)), 6) AS gini_impurity,
    median(n) AS median_class_size, CASE WHEN CAST(max(n) AS DOUBLE) / min(n) > 1000 THEN 'EXTREME'
      WHEN CAST(max(n) AS DOUBLE) / min(n) > 100 THEN 'HIGH' WHEN CAST(max(n) AS DOUBLE) / min(n) > 10 THEN 'MODERATE'
      ELSE 'LOW' END AS severity FROM counts"""


@query("d1_class_summary", f"WITH {FLOWS}, {COUNTS} {SUMMARY}")
def _(spark, d):
    return rounded(profile.class_summary(flows(spark, d)))


@query("d2_median_class_size", f"WITH {FLOWS}, {COUNTS} SELECT median(n) AS median_class_size FROM counts")
def _(spark, d):
    return profile.class_summary(flows(spark, d)).select("median_class_size")


def column_union(columns, expr):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {expr(c)} FROM flows""" for c in columns)


def missing_of(c):
    return f'count_if("{c}" IS NULL OR isnan("{c}"))' if c in ("value", "k", "hr") else f'count_if("{c}" IS NULL)'


def infinite_of(c):
    return f'count_if("{c}" IS NOT NULL AND isinf("{c}"))'


@query("d3_missing_by_column", f"""WITH {FLOWS}, u AS ({column_union(COLUMNS, lambda c: f"count(*) AS rows, {missing_of(c)} AS n")})
    SELECT "column", rows, CAST(n AS BIGINT) AS n, round(n * 100.0 / rows, 6) AS pct FROM u""")
def _(spark, d):
    return rounded(profile.missing_by_column(plain(spark, d)))


def totals_sql(cond, width):
    return f"""SELECT count(*) AS rows, CAST(count_if({cond}) AS BIGINT) AS rows_affected, CAST(count_if({cond}) AS BIGINT) AS cells,
    round(count_if({cond}) * 100.0 / (count(*) * {width}), 6) AS cells_pct, CAST(count_if({cond}) > 0 AS INT) AS columns_affected,
    round(CAST(count_if({cond}) > 0 AS INT) * 100.0 / {width}, 6) AS columns_pct,
    CAST(count_if({cond}) * 100.0 / count(*) > 1 AS INT) AS columns_over_1pct,
    CAST(count_if({cond}) * 100.0 / count(*) > 10 AS INT) AS columns_over_10pct FROM flows"""


@query("d3_missing_totals", f"WITH {FLOWS} {totals_sql(MISSING, 10)}")
def _(spark, d):
    return rounded(profile.missing_totals(plain(spark, d)))


def histogram_sql(cond):
    return f"""SELECT CAST({cond} AS INT) AS per_row, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
    FROM flows GROUP BY 1"""


@query("d3_missing_per_row", f"WITH {FLOWS} {histogram_sql(MISSING)}")
def _(spark, d):
    return rounded(profile.missing_per_row(plain(spark, d)))


@query("d4_infinite_by_column", f"""WITH {FLOWS}, u AS ({column_union(["value", "k", "hr"], lambda c: f"count(*) AS rows, {infinite_of(c)} AS n")})
    SELECT "column", rows, CAST(n AS BIGINT) AS n, round(n * 100.0 / rows, 6) AS pct FROM u""")
def _(spark, d):
    return rounded(profile.infinite_by_column(plain(spark, d)))


@query("d4_infinite_totals", f"WITH {FLOWS} {totals_sql(INFINITE, 10)}")
def _(spark, d):
    return rounded(profile.infinite_totals(plain(spark, d)))


@query("d4_infinite_per_row", f"WITH {FLOWS} {histogram_sql(INFINITE)}")
def _(spark, d):
    return rounded(profile.infinite_per_row(plain(spark, d)))


COARSE = """coarse AS (SELECT "Protocol", hr, floor(k / 10) AS k10, "Label" FROM flows)"""


def coarse(spark, d):
    return flows(spark, d).select("Protocol", "hr", F.floor(F.col("k") / 10).cast("double").alias("k10"), "Label")


@query("d5_duplicates", f"""WITH {FLOWS}, {COARSE} SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates,
    round(sum(c - 1) * 100.0 / sum(c), 6) AS pct FROM (SELECT count(*) AS c FROM coarse GROUP BY ALL)""".replace(
    "SELECT count(*) AS c FROM coarse GROUP BY ALL", 'SELECT count(*) AS c FROM coarse GROUP BY "Protocol", hr, k10, "Label"'))
def _(spark, d):
    return rounded(profile.duplicate_profile(coarse(spark, d)))


@query("d5_duplicate_documents", """SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates,
    round(sum(c - 1) * 100.0 / sum(c), 6) AS pct FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source)""")
def _(spark, d):
    return rounded(profile.duplicate_profile(table(spark, d, "documents").select("text", "lang", "source")))


@query("d6_column_availability", f"""WITH {FLOWS}, u AS ({column_union(COLUMNS, lambda c: f"'{TYPES[COLUMNS.index(c)]}' AS dtype, count(*) AS rows, {missing_of(c)} AS n")})
    SELECT "column", dtype, CAST(rows - n AS BIGINT) AS non_null, round((rows - n) * 100.0 / rows, 6) AS non_null_pct,
      CAST(n AS BIGINT) AS nulls, round(n * 100.0 / rows, 6) AS null_pct, n * 100.0 / rows > 10 AS high_missing FROM u""")
def _(spark, d):
    return rounded(profile.column_availability(plain(spark, d)))


@query("d7_initial_statistics", f"""WITH {FLOWS} SELECT count(*) AS rows, 10 AS columns, 6 AS numeric_columns, 4 AS text_columns,
    CAST(count_if({MISSING}) AS BIGINT) AS missing_cells, round(count_if({MISSING}) * 10.0 / count(*), 6) AS missing_pct,
    CAST(count_if({INFINITE}) AS BIGINT) AS infinite_cells, round(count_if({INFINITE}) * 10.0 / count(*), 6) AS infinite_pct,
    CAST(0 AS BIGINT) AS duplicates, CAST(0 AS DOUBLE) AS duplicate_pct FROM flows""")
def _(spark, d):
    return rounded(profile.initial_statistics(plain(spark, d)))


@query("d7_dtype_counts", f"""WITH {FLOWS}, u AS ({column_union(COLUMNS, lambda c: f"'{TYPES[COLUMNS.index(c)]}' AS dtype, count(*) - {missing_of(c)} AS filled")})
    SELECT dtype, count(*) AS columns, CAST(sum(filled) AS BIGINT) AS filled_cells FROM u GROUP BY 1""")
def _(spark, d):
    return profile.dtype_counts(plain(spark, d))


def storage_sql():
    def size(c):
        t = TYPES[COLUMNS.index(c)]
        if t == "string":
            return f'coalesce(sum(strlen("{c}")), 0)'
        return f"count(*) * {4 if t == 'int' else 8}"

    return column_union(COLUMNS, lambda c: f"'{TYPES[COLUMNS.index(c)]}' AS dtype, count(*) AS rows, CAST({size(c)} AS BIGINT) AS bytes")


@query("d8_storage_by_type", f"""WITH {FLOWS}, u AS ({storage_sql()}) SELECT dtype, count(*) AS columns,
    CAST(sum(bytes) AS BIGINT) AS bytes, round(CAST(sum(bytes) AS DOUBLE) / max(rows), 6) AS bytes_per_row FROM u GROUP BY dtype""")
def _(spark, d):
    return rounded(profile.storage_by_type(plain(spark, d)))


@query("d8_storage_top_columns", f"""WITH {FLOWS}, u AS ({storage_sql()}) SELECT "column", dtype, rows, bytes FROM u ORDER BY bytes DESC, "column" LIMIT 10""")
def _(spark, d):
    return profile.storage_top(plain(spark, d))


def describe_sql(c):
    return f"""SELECT '{c}' AS feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
    round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75,
    max(x) AS max, round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis
    FROM (SELECT CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE CAST({c} AS DOUBLE) END AS x FROM flows)"""


@query("d9_describe", f"WITH {FLOWS} {describe_sql('value')} UNION ALL {describe_sql('k')} UNION ALL {describe_sql('hr')}")
def _(spark, d):
    return rounded(profile.describe(plain(spark, d), ["value", "k", "hr"], exact=True))


FINITE = "CAST('Infinity' AS DOUBLE)"
PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS i, {j} AS j, '{a}' AS f1, '{b}' AS f2, count(*) AS n, corr({a}, {b}) AS r FROM wide
    WHERE abs({a}) < {FINITE} AND abs({b}) < {FINITE}"""
    for i, a in enumerate(WIDE_FEATURES)
    for j, b in enumerate(WIDE_FEATURES)
    if i < j
) + ")"
R6 = "i, j, f1, f2, n, round(r, 6) AS r"


def pairs(spark, d):
    return correlate.correlation_pairs(wide(spark, d), WIDE_FEATURES)


@query("d10_correlation_pairs", f"WITH {WIDE}, {PAIRS} SELECT {R6} FROM pairs")
def _(spark, d):
    return rounded(pairs(spark, d))


VARIANCES = "variances AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM wide WHERE abs({c}) < {FINITE}" for c in WIDE_FEATURES
) + ")"


@query("d11_top_variance_pairs", f"""WITH {WIDE}, {PAIRS}, {VARIANCES},
    top AS (SELECT feature FROM variances ORDER BY variance DESC, feature LIMIT 4)
    SELECT {R6} FROM pairs WHERE f1 IN (SELECT feature FROM top) AND f2 IN (SELECT feature FROM top)""")
def _(spark, d):
    top = correlate.top_variance(wide(spark, d), WIDE_FEATURES, 4)
    return rounded(correlate.pairs_within(pairs(spark, d), top))


@query("d11_top_variance", f"WITH {WIDE}, {VARIANCES} SELECT feature, round(variance, 4) AS variance FROM variances ORDER BY variance DESC, feature LIMIT 4")
def _(spark, d):
    return rounded(correlate.top_variance(wide(spark, d), WIDE_FEATURES, 4), 4)


BAND = "CASE WHEN abs(r) >= 0.99 THEN 'perfect' WHEN abs(r) >= 0.95 THEN 'strong' WHEN abs(r) >= 0.9 THEN 'high' ELSE 'none' END AS band"


@query("d12_correlated_pairs", f"WITH {WIDE}, {PAIRS} SELECT {R6}, {BAND} FROM pairs WHERE abs(r) > 0.9")
def _(spark, d):
    return rounded(correlate.correlated_pairs(pairs(spark, d), 0.9))


@query("d12_all_correlations", f"WITH {WIDE}, {PAIRS} SELECT {R6}, {BAND} FROM pairs WHERE abs(r) > 0.01")
def _(spark, d):
    return rounded(correlate.correlated_pairs(pairs(spark, d), 0.01))


@query("d12_strongest_pairs", f"""WITH {WIDE}, {PAIRS} SELECT * FROM (
    SELECT 'positive' AS sign, {R6} FROM (SELECT * FROM pairs WHERE r > 0 ORDER BY round(r, 9) DESC, i, j LIMIT 10)
    UNION ALL SELECT 'negative', {R6} FROM (SELECT * FROM pairs WHERE r < 0 ORDER BY round(r, 9), i, j LIMIT 10))""")
def _(spark, d):
    p = pairs(spark, d)
    both = [correlate.strongest(p, s).select(F.lit(s).alias("sign"), "*") for s in ("positive", "negative")]
    return rounded(both[0].unionByName(both[1]))


IMPACT = f"""{COUNTS}, after AS (SELECT cls AS class, count(*) AS n FROM mapped WHERE cls <> '__DROP__' GROUP BY 1),
    stages AS (SELECT 'before' AS stage, class, n FROM counts UNION ALL SELECT 'after', class, n FROM after),
    impact AS (SELECT stage, CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, CAST(max(n) AS DOUBLE) / min(n) AS max_imbalance_ratio,
      1 - sum(CAST(n AS DOUBLE) * n) / (sum(n) * CAST(sum(n) AS DOUBLE)) AS gini_impurity FROM stages GROUP BY stage)"""


@query("d13_consolidation_impact", f"""WITH {FLOWS}, {MAPPED}, {IMPACT} SELECT stage, rows, classes,
    round(max_imbalance_ratio, 6) AS max_imbalance_ratio, round(gini_impurity, 6) AS gini_impurity FROM impact""")
def _(spark, d):
    return rounded(profile.consolidation_impact(flows(spark, d)))


@query("d13_consolidation_change", f"""WITH {FLOWS}, {MAPPED}, {IMPACT} SELECT b.rows - a.rows AS rows_removed,
    b.classes - a.classes AS classes_removed, round((b.gini_impurity - a.gini_impurity) / b.gini_impurity * 100, 6) AS improvement_pct
    FROM impact b, impact a WHERE b.stage = 'before' AND a.stage = 'after'""")
def _(spark, d):
    return rounded(profile.consolidation_change(profile.consolidation_impact(flows(spark, d))))


@query("d14_cleaning_waterfall", f"""WITH {FLOWS}, ruled AS (SELECT "Protocol", hr, value, "Label",
      CASE WHEN "Label" = 'Label' THEN 'header' WHEN {MISSING} THEN 'missing' WHEN {INFINITE} THEN 'infinite' ELSE 'clean' END AS rule FROM flows),
    removed AS (SELECT 1 AS step, 'header' AS rule, count_if(rule = 'header') AS removed FROM ruled
      UNION ALL SELECT 2, 'missing', count_if(rule = 'missing') FROM ruled
      UNION ALL SELECT 3, 'infinite', count_if(rule = 'infinite') FROM ruled
      UNION ALL SELECT 4, 'duplicate', sum(c - 1) FROM (SELECT count(*) AS c FROM ruled WHERE rule = 'clean' GROUP BY "Protocol", hr, value, "Label"))
    SELECT step, rule, CAST(removed AS BIGINT) AS removed, round(removed * 100.0 / (SELECT count(*) FROM flows), 6) AS removed_pct,
      CAST((SELECT count(*) FROM flows) - sum(removed) OVER (ORDER BY step) AS BIGINT) AS remaining FROM removed""")
def _(spark, d):
    rows = flows(spark, d).select("Flow ID", "Protocol", "hr", "value", "Label")
    return rounded(profile.cleaning_waterfall(rows))


@query("d15_expected_clean_size", f"""WITH {FLOWS}, t AS (SELECT count(*) AS rows, count_if({MISSING}) + count_if({INFINITE})
      + (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM flows GROUP BY "Protocol", hr, value, "Label")) AS gone FROM flows)
    SELECT rows, CAST(gone AS BIGINT) AS to_remove, round(gone * 100.0 / rows, 6) AS to_remove_pct, CAST(rows - gone AS BIGINT) AS expected_rows FROM t""")
def _(spark, d):
    return rounded(profile.expected_clean_size(flows(spark, d).select("Protocol", "hr", "value", "Label")))


@query("d16_confidence_summary", f"""WITH {SCORED} SELECT round(avg(q1), 6) AS mean, round(median(q1), 6) AS median,
    round(stddev_pop(q1), 6) AS std, round(min(q1), 6) AS min, round(max(q1), 6) AS max, round(quantile_cont(q1, 0.25), 6) AS q25,
    round(quantile_cont(q1, 0.75), 6) AS q75, CAST(count_if(q1 < 0.5) AS BIGINT) AS low_confidence,
    round(count_if(q1 < 0.5) * 100.0 / count(*), 6) AS low_confidence_pct FROM scored""")
def _(spark, d):
    return rounded(evaluate.confidence_summary(scored(spark, d)))


CM = "cm AS (SELECT actual, c1 AS predicted, count(*) AS n FROM scored WHERE actual IS NOT NULL GROUP BY 1, 2)"
NAMES = "names AS (SELECT unnest(['Benign', 'Botnet', 'Brute Force', 'DDoS', 'DoS']) AS class)"


def confusion(spark, d):
    return evaluate.confusion_counts(scored(spark, d), "actual_label", "predicted_class")


@query("d17_confusion_matrix", f"""WITH {SCORED}, {CM}, {NAMES}, cells AS (
      SELECT a.class AS actual, p.class AS predicted, coalesce(n, 0) AS n
      FROM names a CROSS JOIN names p LEFT JOIN cm ON cm.actual = a.class AND cm.predicted = p.class)
    SELECT actual, predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY actual) = 0 THEN 0
      ELSE n / CAST(sum(n) OVER (PARTITION BY actual) AS DOUBLE) END, 6) AS share FROM cells""")
def _(spark, d):
    return rounded(evaluate.confusion_matrix(confusion(spark, d), CLASSES))


METRICS = f"""{CM}, sides AS (SELECT class, sum(support) AS support, sum(predicted) AS predicted, sum(correct) AS correct FROM (
      SELECT actual AS class, n AS support, 0 AS predicted, CASE WHEN actual = predicted THEN n ELSE 0 END AS correct FROM cm
      UNION ALL SELECT predicted, 0, n, 0 FROM cm) GROUP BY class),
    pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE correct / CAST(predicted AS DOUBLE) END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE correct / CAST(support AS DOUBLE) END AS recall FROM sides),
    metrics AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query("d18_class_metrics", f"""WITH {SCORED}, {METRICS} SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
    CAST(correct AS BIGINT) AS correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics""")
def _(spark, d):
    return rounded(evaluate.class_metrics(confusion(spark, d)))


OVERALL = """sum(correct) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
    avg(f1) AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1"""


@query("d19_overall_metrics", f"""WITH {SCORED}, {METRICS}, o AS (SELECT {OVERALL} FROM metrics)
    SELECT round(accuracy, 6) AS accuracy, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
    round(macro_f1, 6) AS macro_f1, round(weighted_precision, 6) AS weighted_precision, round(weighted_recall, 6) AS weighted_recall,
    round(weighted_f1, 6) AS weighted_f1, (SELECT class FROM metrics ORDER BY f1 DESC, class LIMIT 1) AS best_class,
    (SELECT class FROM metrics ORDER BY f1, class LIMIT 1) AS worst_class FROM o""")
def _(spark, d):
    return rounded(evaluate.overall_metrics(evaluate.class_metrics(confusion(spark, d))))


@query("d19_meets_target", f"""WITH {SCORED}, {METRICS} SELECT round(avg(f1), 6) AS macro_f1, avg(f1) >= 0.85 AS meets_target FROM metrics""")
def _(spark, d):
    return rounded(evaluate.meets_target(evaluate.overall_metrics(evaluate.class_metrics(confusion(spark, d)))))


ROC = """sides AS (SELECT long.class, p AS score, labelled.actual = long.class AS positive FROM long JOIN labelled USING (event_id) WHERE labelled.actual IS NOT NULL),
    counts AS (SELECT class, score, count_if(positive) AS pos, count_if(NOT positive) AS neg FROM sides GROUP BY 1, 2),
    points AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER (PARTITION BY class) AS np,
      sum(neg) OVER (PARTITION BY class) AS nn FROM counts WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


@query("d20_roc_points", f"""WITH {SCORED}, {ROC} SELECT class, round(score, 9) AS score, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps,
    round(CASE WHEN np > 0 THEN tps / CAST(np AS DOUBLE) END, 6) AS tpr, round(CASE WHEN nn > 0 THEN fps / CAST(nn AS DOUBLE) END, 6) AS fpr FROM points""")
def _(spark, d):
    points = evaluate.roc_points(evaluate.class_scores(probabilities(spark, d), "actual_label", CLASSES))
    return points.select(
        "class", F.round("score", 9).alias("score"), "tps", "fps", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr")
    )


@query("d20_auc", f"""WITH {SCORED}, {ROC}, a AS (SELECT class, CASE WHEN np > 0 AND nn > 0 THEN
      sum(neg * (tps - pos / 2.0)) / (CAST(np AS DOUBLE) * nn) END AS auc FROM points GROUP BY class, np, nn)
    SELECT class, round(auc, 6) AS auc, round(avg(auc) OVER (), 6) AS macro_auc FROM a""")
def _(spark, d):
    points = evaluate.roc_points(evaluate.class_scores(probabilities(spark, d), "actual_label", CLASSES))
    return rounded(evaluate.auc_by_class(points))


@query("d21_binary_metrics", f"""WITH {SCORED}, c AS (SELECT count_if(actual = 'Benign' AND c1 = 'Benign') AS tn,
      count_if(actual = 'Benign' AND c1 <> 'Benign') AS fp, count_if(actual <> 'Benign' AND c1 = 'Benign') AS fn,
      count_if(actual <> 'Benign' AND c1 <> 'Benign') AS tp FROM scored)
    SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
    round((tp+tn)/CAST(tp+tn+fp+fn AS DOUBLE), 6) AS accuracy, round(tp/CAST(tp+fp AS DOUBLE), 6) AS precision,
    round(tp/CAST(tp+fn AS DOUBLE), 6) AS recall, round(2*tp/CAST(2*tp+fp+fn AS DOUBLE), 6) AS f1,
    round(tn/CAST(tn+fp AS DOUBLE), 6) AS specificity, round(fp/CAST(fp+tn AS DOUBLE), 6) AS fpr, round(fn/CAST(fn+tp AS DOUBLE), 6) AS fnr FROM c""")
def _(spark, d):
    return rounded(evaluate.binary_metrics(scored(spark, d), "actual_label", "predicted_class"))


@query("d22_binary_threshold", f"""WITH {SCORED}, counts AS (SELECT 1.0::DOUBLE - p AS score, count_if(actual <> 'Benign') AS pos, count_if(actual = 'Benign') AS neg
      FROM long JOIN labelled USING (event_id) WHERE idx = 0 AND labelled.actual IS NOT NULL GROUP BY 1),
    points AS (SELECT *, sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr, sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr,
      sum(pos) OVER w AS tps, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM counts WINDOW w AS (ORDER BY score DESC)),
    best AS (SELECT * FROM points ORDER BY round(tpr - fpr, 12) DESC, score DESC LIMIT 1)
    SELECT round(score, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) AS youden_j,
      (SELECT round(sum(neg * (tps - pos / 2.0)) / (CAST(max(np) AS DOUBLE) * max(nn)), 6) FROM points) AS auc FROM best""")
def _(spark, d):
    scores = evaluate.attack_scores(probabilities(spark, d), "actual_label")
    points = evaluate.roc_points(scores)
    return rounded(
        evaluate.best_threshold(points).join(evaluate.auc_by_class(points).select("class", "auc"), "class").drop("class")
    )


@query("d23_error_pairs", f"""WITH {SCORED}, {CM} SELECT actual, predicted, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct_of_errors,
    row_number() OVER (ORDER BY n DESC, actual, predicted) AS rank FROM cm WHERE actual <> predicted QUALIFY rank <= 10""")
def _(spark, d):
    return rounded(evaluate.error_pairs(confusion(spark, d)))


@query("d23_error_summary", f"""WITH {SCORED} SELECT count(*) AS total, CAST(count_if(actual <> c1) AS BIGINT) AS errors,
    CAST(count_if(actual <> c1 AND c1 = 'Benign') AS BIGINT) AS missed_attacks, CAST(count_if(actual <> c1 AND actual = 'Benign') AS BIGINT) AS false_alarms,
    round(count_if(actual <> c1) / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM scored WHERE actual IS NOT NULL""")
def _(spark, d):
    return rounded(evaluate.error_summary(confusion(spark, d)))


@query("d23_errors_by_attack", f"""WITH {SCORED}, {CM} SELECT 'missed' AS kind, actual AS attack, n FROM cm WHERE actual <> 'Benign' AND predicted = 'Benign'
    UNION ALL SELECT 'false_alarm', predicted, n FROM cm WHERE actual = 'Benign' AND predicted <> 'Benign'""")
def _(spark, d):
    return evaluate.error_by_attack(confusion(spark, d))


@query("d24_labelled_batch_metrics", f"""WITH {SCORED}, {METRICS}, o AS (SELECT {OVERALL} FROM metrics) SELECT round(accuracy, 4) AS accuracy,
    round(weighted_precision, 4) AS precision, round(weighted_recall, 4) AS recall, round(weighted_f1, 4) AS f1 FROM o""")
def _(spark, d):
    return evaluate.labelled_batch_metrics(confusion(spark, d))


LEVELS = """count(*) AS total, CAST(count_if(level = 'RED') AS BIGINT) AS threats, CAST(count_if(level = 'YELLOW') AS BIGINT) AS suspicious,
    CAST(count_if(level = 'GREEN') AS BIGINT) AS clean"""


@query("d25_threat_totals", f"""WITH {SCORED} SELECT {LEVELS}, round(count_if(level = 'RED') * 100.0 / count(*), 2) AS threat_pct,
    round(count_if(level = 'YELLOW') * 100.0 / count(*), 2) AS suspicious_pct, round(count_if(level = 'GREEN') * 100.0 / count(*), 2) AS clean_pct FROM scored""")
def _(spark, d):
    return rollup.threat_totals(scored(spark, d))


PRECISION = """precisions AS (SELECT c1 AS class, count(*) AS predicted, count(actual) AS labelled, coalesce(count_if(c1 = actual), 0) AS correct FROM scored GROUP BY 1)"""


@query("d26_class_precision", f"""WITH {SCORED}, {PRECISION} SELECT class, predicted, labelled, CAST(correct AS BIGINT) AS correct,
    CASE WHEN labelled = 0 THEN 0 ELSE round(correct * 100.0 / labelled, 6) END AS precision_pct FROM precisions""")
def _(spark, d):
    return rounded(rollup.class_precision(scored(spark, d)))


@query("d26_batch_accuracy", f"""WITH {SCORED} SELECT count(*) AS total, CAST(coalesce(count_if(c1 = actual), 0) AS BIGINT) AS correct,
    round(count_if(c1 = actual) * 100.0 / count(*), 6) AS accuracy_pct FROM scored""")
def _(spark, d):
    return rounded(rollup.batch_accuracy(scored(spark, d)))


@query("d27_class_breakdown", f"""WITH {SCORED} SELECT c1 AS class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM scored GROUP BY 1""")
def _(spark, d):
    return rounded(rollup.class_breakdown(scored(spark, d)))


@query("d28_attack_breakdown", f"WITH {SCORED} SELECT c1 AS class, count(*) AS n FROM scored WHERE c1 <> 'Benign' GROUP BY 1")
def _(spark, d):
    return rollup.attack_breakdown(scored(spark, d))


@query("d28_replay_estimate", f"""WITH {SCORED} SELECT count(*) AS total, CAST(count_if(c1 = 'Benign') AS BIGINT) AS benign,
    CAST(count_if(c1 <> 'Benign') AS BIGINT) AS threats, CAST(round(count(*) / 5.0) AS BIGINT) AS estimated_seconds FROM scored""")
def _(spark, d):
    return rollup.replay_estimate(scored(spark, d), 5)


MINUTES = f"""minutes AS (SELECT strftime(ts, '%Y-%m-%d') AS session, strftime(ts, '%Y-%m-%d %H:%M') AS minute, {LEVELS},
    count_if(c1 = 'Benign') AS benign, count_if(c1 = 'DDoS') AS ddos, count_if(c1 = 'DoS') AS dos,
    CAST(coalesce(count_if(c1 = actual), 0) AS BIGINT) AS correct, count(actual) AS labelled FROM scored GROUP BY 1, 2)"""


def minutes(spark, d):
    rows = scored(spark, d).withColumn("session", F.date_format("ts", "yyyy-MM-dd"))
    return rollup.minute_rollup(rows, "ts", session=["session"], actual="actual_label").withColumn(
        "minute", F.date_format("minute", "yyyy-MM-dd HH:mm")
    )


@query("d29_minute_rollup", f"""WITH {SCORED}, {MINUTES} SELECT session, minute, total, threats, suspicious, clean, CAST(benign AS BIGINT) AS benign,
    CAST(ddos AS BIGINT) AS ddos, CAST(dos AS BIGINT) AS dos, correct, labelled, CASE WHEN labelled = 0 THEN 0 ELSE round(correct * 100.0 / labelled, 6) END AS accuracy_pct FROM minutes""")
def _(spark, d):
    def of(c):
        return F.coalesce(F.try_element_at("by_class", F.lit(c)), F.lit(0).cast("long")).alias(c.lower())

    return rounded(minutes(spark, d).select("*", of("Benign"), of("DDoS"), of("DoS")).drop("by_class"))


@query("d30_session_summary", f"""WITH {SCORED}, {MINUTES} SELECT session, minute, CAST(sum(total) AS BIGINT) AS total, CAST(sum(threats) AS BIGINT) AS threats,
    CAST(sum(suspicious) AS BIGINT) AS suspicious, CAST(sum(clean) AS BIGINT) AS clean, CAST(sum(correct) AS BIGINT) AS correct,
    CAST(sum(labelled) AS BIGINT) AS labelled, CASE WHEN sum(labelled) = 0 THEN 0 ELSE round(sum(correct) * 100.0 / sum(labelled), 6) END AS accuracy_pct, CAST(grouping(session, minute) AS BIGINT) AS level
    FROM minutes GROUP BY ROLLUP (session, minute)""")
def _(spark, d):
    return rounded(rollup.session_summary(minutes(spark, d), "session"))


@query("d31_binary_from_precision", f"""WITH {SCORED}, {PRECISION}, b AS (SELECT max(CASE WHEN class = 'Benign' THEN correct END) AS tn,
      max(CASE WHEN class = 'Benign' THEN predicted - correct END) AS fn, sum(correct) AS hits, sum(predicted) AS total FROM precisions)
    SELECT CAST(hits - tn AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(total - tn - fn - (hits - tn) AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM b""")
def _(spark, d):
    return rollup.binary_from_precision(rollup.class_precision(scored(spark, d)))


@query("d32_parameter_effect", f"""WITH {TRIALS}, g AS (SELECT max_depth AS value, avg(mean_score) AS mean, stddev_samp(mean_score) AS std, count(*) AS n FROM trials GROUP BY 1)
    SELECT value, round(mean, 6) AS mean, round(std, 6) AS std, n, row_number() OVER (ORDER BY mean DESC, value) = 1 AS is_best FROM g""")
def _(spark, d):
    return rounded(evaluate.parameter_effect(trials(spark, d), "max_depth", "mean_score"))


@query("d33_score_distribution", """SELECT round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
    round(max(x), 4) AS max, round(avg(x) - 1.96 * stddev_samp(x), 4) AS ci_low, round(avg(x) + 1.96 * stddev_samp(x), 4) AS ci_high
    FROM (SELECT o_totalprice AS x FROM orders)""")
def _(spark, d):
    return rounded(evaluate.score_distribution(table(spark, d, "orders"), "o_totalprice"), 4)


@query("d33_score_histogram", f"""WITH {SCORED}, e AS (SELECT min(q1) AS lo, max(q1) AS hi FROM scored)
    SELECT CAST(least(floor((q1 - lo) / ((hi - lo) / 20)), 19) + 1 AS INT) AS bin, count(*) AS n FROM scored, e GROUP BY 1""")
def _(spark, d):
    return evaluate.score_histogram(scored(spark, d), "confidence")


RANKED = """imp AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
    sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative FROM importances)"""


@query("d34_importance_table", f"WITH {IMPORTANCES}, {RANKED} SELECT feature, round(importance, 6) AS importance, rank, round(cumulative, 6) AS cumulative FROM imp")
def _(spark, d):
    return rounded(evaluate.importance_table(importances(spark, d)))


@query("d34_importance_summary", f"""WITH {IMPORTANCES}, {RANKED} SELECT round(sum(CASE WHEN rank <= 10 THEN importance END), 6) AS top10,
    round(sum(CASE WHEN rank <= 20 THEN importance END), 6) AS top20, CAST(count_if(cumulative <= 0.8) + 1 AS BIGINT) AS features_to_80pct, count(*) AS features FROM imp""")
def _(spark, d):
    return rounded(evaluate.importance_summary(evaluate.importance_table(importances(spark, d))))


PICK = """hashed AS (SELECT event_id, cls, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 15) AS BIGINT) AS h FROM mapped),
    sizes AS (SELECT cls, count(*) AS n FROM hashed GROUP BY 1),
    wanted AS (SELECT cls, n, {total} AS total, (n * {total}) // (SELECT sum(n) FROM sizes) AS q, (n * {total}) % (SELECT sum(n) FROM sizes) AS rest FROM sizes),
    quota AS (SELECT cls, n, q + CASE WHEN row_number() OVER (ORDER BY rest DESC, cls) <= total - sum(q) OVER () THEN 1 ELSE 0 END AS take FROM wanted),
    picks AS (SELECT event_id, cls, row_number() OVER (PARTITION BY cls ORDER BY h, event_id) <= take AS picked FROM hashed JOIN quota USING (cls))"""
TEST_ROWS = "CAST(ceil(0.2 * (SELECT sum(n) FROM sizes)) AS BIGINT)"


def consolidated(spark, d):
    return consolidate(flows(spark, d)).select("event_id", "Label", "k", "hr")


@query("e1_stratified_split", f"""WITH {FLOWS}, {MAPPED}, {PICK.format(total=TEST_ROWS)}
    SELECT event_id, cls AS "Label", CASE WHEN picked THEN 'test' ELSE 'train' END AS part FROM picks""")
def _(spark, d):
    train, test = sample.stratified_split(consolidated(spark, d), "Label", ["event_id"], portable=True)
    parts = [p.select("event_id", "Label", F.lit(n).alias("part")) for p, n in ((train, "train"), (test, "test"))]
    return parts[0].unionByName(parts[1])


@query("e2_stratified_sample", f"""WITH {FLOWS}, {MAPPED}, {PICK.format(total="CAST(2000 AS BIGINT)")} SELECT event_id, cls AS "Label" FROM picks WHERE picked""")
def _(spark, d):
    return sample.stratified_sample(consolidated(spark, d), "Label", ["event_id"], 2000, portable=True).select("event_id", "Label")


@query("d35_split_check", f"""WITH {FLOWS}, {MAPPED}, {PICK.format(total=TEST_ROWS)}, s AS (SELECT cls AS class,
      count_if(NOT picked) * 100.0 / (SELECT count_if(NOT picked) FROM picks) AS train_pct, count_if(picked) * 100.0 / (SELECT count_if(picked) FROM picks) AS test_pct
      FROM picks GROUP BY 1) SELECT class, round(train_pct, 6) AS train_pct, round(test_pct, 6) AS test_pct, round(abs(train_pct - test_pct), 6) AS diff,
      round(max(abs(train_pct - test_pct)) OVER (), 6) AS max_diff FROM s""")
def _(spark, d):
    train, test = sample.stratified_split(consolidated(spark, d), "Label", ["event_id"], portable=True)
    return rounded(profile.split_check(train, test, "Label"))


@query("d37_protocols", f"""WITH {FLOWS} SELECT DISTINCT CAST("Protocol" AS VARCHAR) AS protocol FROM flows""")
def _(spark, d):
    return encode.protocol_values(flows(spark, d))
