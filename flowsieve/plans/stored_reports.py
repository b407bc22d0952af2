"""Queries for stored text reports (J): folders rendered from scored flows, then read back."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.values import percent
from flowsieve.operators import evaluate, lookups, profile, reports, rollup, sample, stage_texts
from flowsieve.operators.balance import oversampling_targets
from flowsieve.plans.fixtures import CLASSES, FLOWS, MAPPED, SCORED, flows, probabilities, scored
from flowsieve.plans.profiles import COUNTS, IMPACT, INFINITE, METRICS, MISSING, ROC, SUMMARY, confusion
from flowsieve.plans.registry import query, rounded, table
from flowsieve.session import scratch_path

KIND = "CAST(day(ts) % 4 AS INT)"
REPORTED = f"""reported AS (SELECT *, CASE {KIND} WHEN 0 THEN 'simul_default_labeled_' || strftime(ts, '%Y-%m-%d') || '_00-00-00'
      WHEN 1 THEN 'batch_all_batch_3_' || strftime(ts, '%Y-%m-%d') || '_10-20-30'
      WHEN 2 THEN 'simul_all_labeled_' || strftime(ts, '%Y-%m-%d') || '_01-02-03'
      ELSE 'live_default_' || strftime(ts, '%Y-%m-%d') || '_05-06-07' END AS report,
    CASE {KIND} WHEN 1 THEN 'batch_results.txt' ELSE 'minute_' || printf('%02d', CAST(hour(ts) // 6 * 6 AS INT)) || '-00.txt' END AS file, {KIND} AS kind FROM scored)"""


def reported(spark, d):
    """Scored flows with a report folder for each day, of four kinds, and their table file."""
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.dayofmonth("ts") % 4

    def named(head, tail):
        return F.concat(F.lit(head), day, F.lit(tail))

    rows = scored(spark, d).withColumn("kind", kind)
    return rows.withColumns(
        {
            "report": F.when(kind == 0, named("simul_default_labeled_", "_00-00-00"))
            .when(kind == 1, named("batch_all_batch_3_", "_10-20-30"))
            .when(kind == 2, named("simul_all_labeled_", "_01-02-03"))
            .otherwise(named("live_default_", "_05-06-07")),
            "file": F.when(kind == 1, "batch_results.txt").otherwise(
                F.format_string("minute_%02d-00.txt", (F.floor(F.hour("ts") / 6) * 6).cast("int"))
            ),
            "Src IP": F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")),
        }
    )


@lru_cache(maxsize=8)
def _written(app: str, d: str) -> str:
    spark = SparkSession.active()
    path = scratch_path(spark, "reports")
    rows = reported(spark, d)
    lines = [
        reports.table_lines(rows.filter(F.col("kind").isin(*kinds)), "report", "file", "event_id", "ts", actual)
        for kinds, actual in (((0, 2), "actual_label"), ((1, 3), None))
    ]
    reports.write_lines(lines[0].unionByName(lines[1]), path)
    styles = {
        0: ("session_summary.txt", dict(labelled=True)),
        1: ("batch_summary.txt", dict(title="BATCH SUMMARY", minute_section=False)),
        2: ("session_summary.txt", dict(labelled=True, totals=False)),
    }
    # each style by itself: joined to one write, the sorts and groupings of all would hold their memory in one task
    for kind, (file, style) in styles.items():
        part = rows.filter(F.col("kind") == kind)
        minutes = rollup.minute_rollup(part, "ts", session=["report"], actual="actual_label")
        spans = part.groupBy("report").agg(
            (F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))).alias("seconds")
        )
        precision = part.groupBy("report", F.col("predicted_class").alias("class")).agg(
            F.count(F.lit(1)).alias("predicted"), F.count("actual_label").alias("labelled"),
            F.count_if(F.col("predicted_class") == F.col("actual_label")).alias("correct"),
        ).withColumn("precision_pct", percent(F.col("correct"), F.col("labelled")))
        texts = reports.summary_texts(minutes.join(spans, "report"), precision, seconds="seconds", **style)
        reports.write_texts(texts.withColumn("file", F.lit(file)), path)
    return path


def report_folder(spark, d) -> str:
    return _written(spark.sparkContext.applicationId, d)


NAMES = """named AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'simul_all_labeled_' || strftime(ts, '%Y-%m-%d_%H-%M-%S')
      WHEN 1 THEN 'batch_default_batch_3_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') WHEN 2 THEN 'training_' || strftime(ts, '%Y%m%d_%H%M%S') || '_default'
      WHEN 3 THEN 'batch_' || strftime(ts, '%Y%m%d_%H%M%S') ELSE 'notes-' || CAST(event_id AS VARCHAR) END AS name, ts FROM events)"""


@query("j1_folder_names", f"""WITH {NAMES} SELECT name, CASE event_id % 5 WHEN 0 THEN 'simul' WHEN 1 THEN 'batch' WHEN 2 THEN 'training' WHEN 3 THEN 'batch' ELSE 'unknown' END AS type,
    CASE event_id % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'default' WHEN 2 THEN 'default' END AS model,
    CASE WHEN event_id % 5 < 2 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 5 < 4 THEN strftime(ts, '%Y%m%d_%H%M%S') END AS date,
    CASE WHEN event_id % 5 < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN event_id % 5 < 4 THEN strftime(ts, '%Y%m%dT%H%M%S') END AS date_iso,
    event_id % 5 = 0 AS is_labeled FROM named""")
def _(spark, d):
    n = F.col("event_id") % 5
    long, short = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.date_format("ts", "yyyyMMdd_HHmmss")
    name = (
        F.when(n == 0, F.concat(F.lit("simul_all_labeled_"), long))
        .when(n == 1, F.concat(F.lit("batch_default_batch_3_"), long))
        .when(n == 2, F.concat(F.lit("training_"), short, F.lit("_default")))
        .when(n == 3, F.concat(F.lit("batch_"), short))
        .otherwise(F.concat(F.lit("notes-"), F.col("event_id").cast("string")))
    )
    rows = table(spark, d, "events").select(name.alias("name"))
    return rows.select("name", *reports.parse_folder_name("name"))


LEVELS = """CAST(count(*) AS BIGINT) AS flows, CAST(count_if(level = 'RED') AS BIGINT) AS threats, CAST(count_if(level = 'YELLOW') AS BIGINT) AS suspicious,
    CAST(count_if(level = 'GREEN') AS BIGINT) AS clean"""


@query("j2_summary_totals", f"""WITH {SCORED}, {REPORTED} SELECT report, {LEVELS} FROM reported WHERE kind IN (0, 1) GROUP BY report
    UNION ALL SELECT report, count(*), NULL, NULL, NULL FROM reported WHERE kind = 2 GROUP BY report""")
def _(spark, d):
    facts = reports.summary_facts(reports.read_summaries(spark, report_folder(spark, d)))
    return facts.select("report", *reports.TOTAL_LABELS)


def fraction(q):
    return f"round(round({q} * 100, 1) / 100, 6)"


@query("j3_table_rows", f"""WITH {SCORED}, {REPORTED} SELECT report, file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, '10.0.0.' || CAST(user_id AS VARCHAR) AS src_ip,
    '?' AS src_port, '?' AS dst_ip, '?' AS dst_port, '?' AS protocol, c1 AS class1, {fraction('q1')} AS conf1, c2 AS class2, {fraction('q2')} AS conf2,
    c3 AS class3, {fraction('q3')} AS conf3, CASE WHEN kind IN (0, 2) THEN actual END AS actual_label FROM reported""")
def _(spark, d):
    return reports.parse_table_rows(reports.read_lines(spark, report_folder(spark, d)))


@query("j4_counts_from_rows", f"""WITH {SCORED}, {REPORTED} SELECT report, count(*) AS row_flows, CAST(count_if(c1 <> 'Benign') AS BIGINT) AS row_threats
    FROM reported WHERE kind <> 1 GROUP BY report""")
def _(spark, d):
    return reports.counts_from_rows(reports.parse_table_rows(reports.read_lines(spark, report_folder(spark, d))))


CLASSES_SQL = """SELECT report, c1 AS class, CAST(coalesce(count_if(c1 = actual), 0) AS BIGINT) AS correct, count(*) AS predicted, CAST(coalesce(count_if(c1 <> actual), 0) AS BIGINT) AS wrong
    FROM reported WHERE kind IN (0, 2) GROUP BY 1, 2"""


@query("j5_class_precision_lines", f"WITH {SCORED}, {REPORTED} {CLASSES_SQL}")
def _(spark, d):
    return reports.class_lines(reports.read_summaries(spark, report_folder(spark, d)))


@query("j5_threats_from_classes", f"""WITH {SCORED}, {REPORTED} SELECT report, CAST(count_if(c1 <> 'Benign') AS BIGINT) AS class_threats FROM reported WHERE kind IN (0, 2) GROUP BY 1""")
def _(spark, d):
    return reports.threats_from_classes(reports.class_lines(reports.read_summaries(spark, report_folder(spark, d))))


@query("j6_minute_sums", f"""WITH {SCORED}, {REPORTED} SELECT report, CASE WHEN kind = 1 THEN NULL ELSE CAST(count_if(level = 'RED') AS BIGINT) END AS minute_threats,
    CASE WHEN kind = 1 THEN NULL ELSE CAST(count_if(level = 'YELLOW') AS BIGINT) END AS minute_suspicious,
    CASE WHEN kind = 1 THEN NULL ELSE CAST(count_if(level = 'GREEN') AS BIGINT) END AS minute_clean FROM reported WHERE kind < 3 GROUP BY report, kind""")
def _(spark, d):
    return reports.summary_facts(reports.read_summaries(spark, report_folder(spark, d))).select("report", *reports.MINUTE_LABELS)


INDEX_SQL = f"""SELECT report AS name, CASE kind WHEN 0 THEN 'simul' WHEN 1 THEN 'batch' WHEN 2 THEN 'simul' ELSE 'live' END AS type,
    CASE kind WHEN 0 THEN 'default' WHEN 3 THEN 'default' ELSE 'all' END AS model, strftime(min(ts), '%Y-%m-%d') AS date,
    strftime(min(ts), '%Y-%m-%dT') || CASE kind WHEN 0 THEN '00:00:00' WHEN 1 THEN '10:20:30' WHEN 2 THEN '01:02:03' ELSE '05:06:07' END AS date_iso,
    kind IN (0, 2) AS is_labeled, CASE WHEN kind IN (0, 2) THEN printf('%.2f', round(count_if(c1 = actual) * 100.0 / count(actual), 2)) END AS accuracy,
    count(*) AS flows, CAST(count_if(level = 'RED') AS BIGINT) AS threats, CASE WHEN kind = 3 THEN NULL ELSE CAST(count_if(level = 'YELLOW') AS BIGINT) END AS suspicious,
    CASE WHEN kind = 3 THEN NULL ELSE CAST(count_if(level = 'GREEN') AS BIGINT) END AS clean FROM reported GROUP BY report, kind"""


@query("j7_report_index", f"WITH {SCORED}, {REPORTED} {INDEX_SQL}")
def _(spark, d):
    return reports.report_index(spark, report_folder(spark, d)).drop("size")


@query("j7_report_page", f"""WITH {SCORED}, {REPORTED}, listed AS ({INDEX_SQL}) SELECT name, type, flows, threats FROM listed WHERE type = 'simul' ORDER BY name DESC LIMIT 5 OFFSET 2""")
def _(spark, d):
    rows = reports.report_index(spark, report_folder(spark, d)).filter(F.col("type") == "simul")
    return lookups.page(rows, [F.desc("name")], 5, 2).select("name", "type", "flows", "threats")


@query("j8_breakdown_lines", f"""WITH {SCORED}, {REPORTED} SELECT report, c1 AS name, count(*) AS count,
    round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY report), 1) AS pct FROM reported WHERE kind < 3 GROUP BY 1, 2""")
def _(spark, d):
    return reports.breakdown_lines(reports.read_summaries(spark, report_folder(spark, d)))


@query("j8_session_facts", f"""WITH {SCORED}, {REPORTED} SELECT report, CAST(CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS VARCHAR) || 's' AS duration,
    CASE WHEN kind IN (0, 2) THEN round(count_if(c1 = actual) * 100.0 / count(actual), 2) END AS accuracy_pct,
    CASE WHEN kind IN (0, 2) THEN CAST(coalesce(count_if(c1 = actual), 0) AS BIGINT) END AS accuracy_correct FROM reported WHERE kind < 3 GROUP BY report, kind""")
def _(spark, d):
    facts = reports.summary_facts(reports.read_summaries(spark, report_folder(spark, d)))
    return facts.select("report", "duration", "accuracy_pct", "accuracy_correct")


def day(c="ts"):
    return F.date_format(c, "yyyy-MM-dd")


def commas(c):
    return F.format_number(c, 0)


def stored(spark, texts, file):
    """Texts written as one file of each report, and read back."""
    path = scratch_path(spark, "stage-reports")
    reports.write_texts(texts.withColumn("file", F.lit(file)), path)
    return reports.read_texts(spark, path, file)


@query("j9_exploration_metrics", f"""WITH {FLOWS}, c AS (SELECT strftime(ts, '%Y-%m-%d') AS report, "Label" AS l, count(*) AS n FROM flows GROUP BY 1, 2)
    SELECT report, format('{{:,}}', CAST(sum(n) AS BIGINT)) AS total_rows, '11' AS total_columns, CAST(count(*) AS VARCHAR) AS original_classes,
    CAST(count(*) - 1 AS VARCHAR) AS consolidated_classes, printf('%.3f', round(1 - sum(CAST(n AS DOUBLE) * n) / (sum(n) * CAST(sum(n) AS DOUBLE)), 3)) AS gini_coefficient,
    'LOW' AS imbalance_severity, '0.5 GB' AS memory_usage FROM c GROUP BY report""")
def _(spark, d):
    counts = flows(spark, d).groupBy(day().alias("report"), "Label").agg(F.count(F.lit(1)).alias("n"))
    gini = 1 - F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), 2)
    rows = counts.groupBy("report").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), gini.alias("g"))
    text = F.concat_ws(
        "\n", F.lit("1. DATASET"), F.concat(F.lit("   Total Rows: "), commas("n")), F.lit("   Total Columns: 11\n   Memory Usage: 0.5 GB"),
        F.format_string("   Total Classes: %d", "c"), F.lit("   Imbalance Severity: LOW"), F.format_string("   Gini Coefficient: %.3f", F.round("g", 3)),
        F.format_string("   AFTER Consolidation\n     Classes: %d\n     Gini Coefficient: 0.1", F.col("c") - 1),
    )
    texts = rows.select("report", text.alias("text"))
    return reports.stage_metrics(stored(spark, texts, "exploration_results.txt"), "exploration")


@query("j9_preprocessing_metrics", """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS report, count(*) AS n, count_if(event_type = 'error') AS gone FROM events GROUP BY 1)
    SELECT report, format('{:,}', n * 1000) AS initial_rows, format('{:,}', (n - gone) * 1000) AS final_rows, format('{:,}', CAST(gone * 1000 AS BIGINT)) AS rows_removed,
    printf('%.3f', round(gone * 100.0 / n, 3)) AS data_loss_pct, format('{:,}', n * 800) AS training_samples, format('{:,}', n * 200) AS test_samples,
    format('{:,}', CAST(gone AS BIGINT)) AS smote_samples, '40' AS features_selected FROM c""")
def _(spark, d):
    e = table(spark, d, "events").groupBy(day().alias("report")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("gone")
    )
    n, gone = F.col("n"), F.col("gone")
    text = F.concat_ws(
        "\n", F.lit("Initial Dataset:"), F.concat(F.lit("  Rows:    "), commas(n * 1000)), F.lit("Final Clean Dataset:"),
        F.concat(F.lit("  Rows:    "), commas((n - gone) * 1000)),
        F.concat(F.lit("Total removed: "), commas(gone * 1000), F.format_string(" rows (%.3f%%)", F.round(gone * 100.0 / n, 3))),
        F.concat(F.lit("Test set:  "), commas(n * 200), F.lit(" samples")), F.concat(F.lit("Synthetic samples: "), commas(gone)),
        F.concat(F.lit("Samples after: "), commas(n * 800)), F.lit("Features selected: 40"),
    )
    texts = e.select("report", text.alias("text"))
    return reports.stage_metrics(stored(spark, texts, "preprocessing_results.txt"), "preprocessing")


@query("j9_training_metrics", """SELECT strftime(ts, '%Y-%m-%d') AS report, printf('%.4f', round(avg(value) / 1000, 4)) AS cv_f1_score, printf('%.1f minutes', round(max(value), 1)) AS tuning_time,
    printf('%.1f minutes', round(min(value), 1)) AS training_time, '9.5 minutes' AS total_time, CAST(count(*) AS VARCHAR) AS trees, '20.0' AS avg_depth, '40' AS features,
    '56.20%' AS top10_importance, 'Dst Port' AS top_feature, printf('%.4f', round(avg(value) / 1000, 4)) AS top_feature_importance FROM events GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").groupBy(day().alias("report")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.max("value").alias("hi"), F.min("value").alias("lo")
    )
    f1 = F.format_string("%.4f", F.round(F.col("m") / 1000, 4))
    text = F.concat_ws(
        "\n", F.format_string("Hyperparameter Tuning: %.1f minutes", F.round("hi", 1)), F.format_string("Final Model Training: %.1f minutes", F.round("lo", 1)),
        F.lit("Total Training Time: 9.5 minutes\nTraining Configuration\n  Samples: 100\n  Features: 40"), F.concat(F.lit("Macro F1-Score: "), f1),
        F.format_string("Number of Trees: %d\nAverage Tree Depth: 20.0", "n"),
        F.concat(F.lit("  Rank | Feature | Importance |\n  1  | Dst Port   |  "), f1, F.lit("  | 10%\n  2  | Other   |  0.1  | 20%")),
        F.lit("Top 10 features: 56.20% of total importance"),
    )
    texts = e.select("report", text.alias("text"))
    return reports.stage_metrics(stored(spark, texts, "training_results.txt"), "training")


def testing_texts(spark, d):
    """A testing report for each day, with the five classes of the scored flows."""
    s = scored(spark, d).select(day().alias("report"), "predicted_class", "actual_label", "confidence")
    per_class = s.groupBy("report", F.col("predicted_class").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg((F.col("predicted_class") == F.col("actual_label")).cast("int")), 4), F.lit(0.0)).alias("p")
    )
    line = F.format_string("%-20s %.4f     %.4f     %.4f     1.0000     ", "class", "p", "p", "p")
    rows = per_class.groupBy("report").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class", F.concat(line, commas("n")).alias("line")))), lambda r: r["line"]), "\n").alias("lines")
    )
    facts = s.groupBy("report").agg(
        F.round(F.avg((F.col("predicted_class") == F.col("actual_label")).cast("int")), 4).alias("a"), F.round(F.avg("confidence"), 4).alias("c"),
        F.count(F.lit(1)).alias("n"),
    )
    head = "Class                Precision  Recall     F1-Score   AUC        Support\n" + "-" * 80
    text = F.concat_ws(
        "\n", F.lit("2. INFERENCE PERFORMANCE"), F.concat(F.lit("Inference speed: "), commas("n"), F.lit(" samples/second")),
        F.format_string("Mean confidence: %.4f\n\n3. MULTICLASS EVALUATION", "c"), F.format_string("Accuracy:           %.4f (x)", "a"),
        F.lit("Macro F1-Score:     0.5000\n\nPer-Class Performance:\n" + head), "lines", F.lit("\n4. BINARY EVALUATION (Benign vs Attack)"),
        F.format_string("Accuracy:           %.4f", "c"),
        F.lit("Precision:          0.9998\nRecall (TPR):       0.9992\nF1-Score:           0.9995\nSpecificity (TNR):  1.0000\nBinary AUC:         1.0000\n"),
    )
    return facts.join(rows, "report").select("report", text.alias("text"))


@query("j9_testing_metrics", f"""WITH {SCORED} SELECT strftime(ts, '%Y-%m-%d') AS report, printf('%.4f', round(avg(CAST(c1 = actual AS INT)), 4)) AS accuracy, '0.5000' AS macro_f1,
    format('{{:,}}', count(*)) || ' samples/second' AS inference_speed, printf('%.4f', round(avg(q1), 4)) AS mean_confidence, printf('%.4f', round(avg(q1), 4)) AS binary_accuracy,
    '0.9998' AS binary_precision, '0.9992' AS binary_recall, '1.0000' AS binary_specificity, '1.0000' AS binary_auc, '0.9995' AS binary_f1 FROM scored GROUP BY 1""")
def _(spark, d):
    return reports.stage_metrics(stored(spark, testing_texts(spark, d), "testing_results.txt"), "testing")


@query("j9_testing_classes", f"""WITH {SCORED}, c AS (SELECT strftime(ts, '%Y-%m-%d') AS report, c1 AS class, count(*) AS n,
      printf('%.4f', coalesce(round(avg(CAST(c1 = actual AS INT)), 4), 0)) AS p FROM scored GROUP BY 1, 2)
    SELECT report, class, p AS precision, p AS recall, p AS f1, '1.0000' AS auc, format('{{:,}}', n) AS support FROM c""")
def _(spark, d):
    return reports.testing_classes(stored(spark, testing_texts(spark, d), "testing_results.txt"))


@query("j9_exploration_report", f"""WITH {FLOWS}, {MAPPED}, {IMPACT}, s AS ({SUMMARY})
    SELECT 'run' AS report, format('{{:,}}', rows) AS total_rows, '11' AS total_columns, CAST(classes AS VARCHAR) AS original_classes,
    (SELECT CAST(classes AS VARCHAR) FROM impact WHERE stage = 'after') AS consolidated_classes, printf('%.3f', round(gini_impurity, 3)) AS gini_coefficient,
    severity AS imbalance_severity, '2 parts' AS memory_usage FROM s""")
def _(spark, d):
    """A report written from the profile of the flows, and read back."""
    rows = flows(spark, d)
    text = stage_texts.exploration_text("run", profile.class_summary(rows), profile.consolidation_impact(rows), len(rows.columns), "2 parts")
    return reports.stage_metrics(stored(spark, text, "exploration_results.txt"), "exploration")


@query("j9_preprocessing_report", f"""WITH {FLOWS}, ruled AS (SELECT "Protocol", hr, value, "Label", "Label" = 'Label' OR {MISSING} OR {INFINITE} AS bad FROM flows),
    clean AS (SELECT count(*) AS n FROM (SELECT DISTINCT "Protocol", hr, value, "Label" FROM ruled WHERE NOT bad)), every AS (SELECT count(*) AS n FROM flows),
    {COUNTS}, second AS (SELECT n AS reference FROM (SELECT n, row_number() OVER (ORDER BY n DESC, class) AS rn FROM counts) WHERE rn = 2),
    made AS (SELECT CAST(sum(floor(n + (reference - n) / 2.0) - n) AS BIGINT) AS m FROM counts, second WHERE n < reference),
    held AS (SELECT CAST(ceil(0.2 * n) AS BIGINT) AS t FROM every)
    SELECT 'run' AS report, format('{{:,}}', e.n) AS initial_rows, format('{{:,}}', c.n) AS final_rows, format('{{:,}}', e.n - c.n) AS rows_removed,
    printf('%.3f', round((e.n - c.n) * 100.0 / e.n, 3)) AS data_loss_pct, format('{{:,}}', e.n - t + m) AS training_samples, format('{{:,}}', t) AS test_samples,
    format('{{:,}}', m) AS smote_samples, '4' AS features_selected FROM every e, clean c, held, made""")
def _(spark, d):
    """A report written from the cleaning steps, an exact split and the oversampling targets, and read back."""
    rows = flows(spark, d)
    steps = profile.cleaning_waterfall(rows.select("Flow ID", "Protocol", "hr", "value", "Label"))
    train, test = sample.stratified_split(rows, "Label", ["event_id"], 0.2)
    parts = train.agg(F.count(F.lit(1)).alias("train")).unionByName(test.agg(F.count(F.lit(1)).alias("test")), allowMissingColumns=True)
    made = oversampling_targets(rows, "Label").agg(F.sum("extra").alias("synthetic"))
    split = parts.agg(F.max("train").alias("train"), F.max("test").alias("test"))
    text = stage_texts.preprocessing_text("run", steps, split, made, 4)
    return reports.stage_metrics(stored(spark, text, "preprocessing_results.txt"), "preprocessing")


def testing_report(spark, d):
    """A report written from the metrics of the scored flows, as if scored in half a second."""
    s, p = scored(spark, d), probabilities(spark, d)
    text = stage_texts.testing_text(
        "run",
        evaluate.class_metrics(confusion(spark, d)),
        evaluate.auc_by_class(evaluate.roc_points(evaluate.class_scores(p, "actual_label", CLASSES))),
        evaluate.binary_metrics(s, "actual_label", "predicted_class"),
        evaluate.auc_by_class(evaluate.roc_points(evaluate.attack_scores(p, "actual_label"))),
        evaluate.confidence_summary(s),
        0.5,
    )
    return stored(spark, text, "testing_results.txt")


ROC_AREAS = ROC.replace("sides", "roc_sides").replace("counts", "roc_counts") + """,
    areas AS (SELECT class, CASE WHEN np > 0 AND nn > 0 THEN sum(neg * (tps - pos / 2.0)) / (CAST(np AS DOUBLE) * nn) END AS auc FROM points GROUP BY class, np, nn)"""
ATTACKS = """attack_counts AS (SELECT 1.0::DOUBLE - p AS score, count_if(actual <> 'Benign') AS pos, count_if(actual = 'Benign') AS neg
      FROM long JOIN labelled USING (event_id) WHERE idx = 0 AND labelled.actual IS NOT NULL GROUP BY 1),
    attack_points AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM attack_counts),
    attack_area AS (SELECT sum(neg * (tps - pos / 2.0)) / (CAST(max(np) AS DOUBLE) * max(nn)) AS auc FROM attack_points),
    sides_of AS (SELECT count_if(actual = 'Benign' AND c1 = 'Benign') AS tn, count_if(actual = 'Benign' AND c1 <> 'Benign') AS fp,
      count_if(actual <> 'Benign' AND c1 = 'Benign') AS fn, count_if(actual <> 'Benign' AND c1 <> 'Benign') AS tp FROM scored)"""


@query("j9_testing_report", f"""WITH {SCORED}, {METRICS}, {ATTACKS}, o AS (SELECT sum(correct) / CAST(sum(support) AS DOUBLE) AS a, avg(f1) AS f, sum(support) AS n FROM metrics)
    SELECT 'run' AS report, printf('%.4f', round(a, 4)) AS accuracy, printf('%.4f', round(f, 4)) AS macro_f1, format('{{:,}}', CAST(n * 2 AS BIGINT)) || ' samples/second' AS inference_speed,
    (SELECT printf('%.4f', round(avg(q1), 4)) FROM scored) AS mean_confidence, printf('%.4f', round((tp+tn)/CAST(tp+tn+fp+fn AS DOUBLE), 4)) AS binary_accuracy,
    printf('%.4f', round(tp/CAST(tp+fp AS DOUBLE), 4)) AS binary_precision, printf('%.4f', round(tp/CAST(tp+fn AS DOUBLE), 4)) AS binary_recall,
    printf('%.4f', round(tn/CAST(tn+fp AS DOUBLE), 4)) AS binary_specificity, printf('%.4f', round(auc, 4)) AS binary_auc,
    printf('%.4f', round(2*tp/CAST(2*tp+fp+fn AS DOUBLE), 4)) AS binary_f1 FROM o, sides_of, attack_area""")
def _(spark, d):
    return reports.stage_metrics(testing_report(spark, d), "testing")


@query("j9_testing_report_classes", f"""WITH {SCORED}, {METRICS}, {ROC_AREAS} SELECT 'run' AS report, class, printf('%.4f', round(precision, 4)) AS precision,
    printf('%.4f', round(recall, 4)) AS recall, printf('%.4f', round(f1, 4)) AS f1, printf('%.4f', round(coalesce(auc, 0), 4)) AS auc,
    format('{{:,}}', CAST(support AS BIGINT)) AS support FROM metrics LEFT JOIN areas USING (class)""")
def _(spark, d):
    return reports.testing_classes(testing_report(spark, d))


@query("j10_metric_lines", """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS report, count(*) AS n FROM events GROUP BY 1)
    SELECT report, 'total_flows' AS key, CAST(n AS VARCHAR) AS value FROM c UNION ALL SELECT report, 'accuracy', 'a=b' FROM c""")
def _(spark, d):
    e = table(spark, d, "events").groupBy(day().alias("report")).agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string("head\n  total_flows = %d\nunknown=1\n accuracy=a=b\n", "n")
    return reports.metric_lines(stored(spark, e.select("report", text.alias("text")), "metrics.txt"))
