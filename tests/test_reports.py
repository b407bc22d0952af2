"""Report texts: parsing of hand-made files with every fallback."""

import os

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import reports

SUMMARY = """
====================
  Session Mode:      SIMUL
  Actual Duration:   95s

  FULL SESSION SUMMARY
  --------------------

  Total Flows Classified: 1,250
  Threats Detected:       300
  Suspicious Flows:       0
  Clean Flows:            950

  Classification Breakdown:
    Benign              :    950 ( 76.0%)
    Brute Force         :    300 ( 24.0%)
"""

LABELLED = """
  Minute 1: 10:00 (10:00:01 - 10:00:59)
    Flows:      30
    Threats:    10
    Suspicious: 2
    Clean:      18

  Minute 2: 10:01 (10:01:00 - 10:01:30)
    Flows:      10
    Threats:    4
    Suspicious: 0
    Clean:      6

  Total Flows Classified: 40
  Accuracy:               85.00% (34/40)

  Per-Class Precision (of predicted, how many correct):
    Benign              :  92.31% (24/26)  |  Predicted:     26
    DoS                 :  71.43% (10/14)  |  Predicted:     14
"""

MINUTES = [
    "=" * 40,
    "  Minute Report",
    "",
    *reports.table_header(True),
    "2024-01-01 10:00:01 | 1.2.3.4            | 1234     | 5.6.7.8            | 80       | 6        | DoS            | 0.5%     | Benign         | 49.0%    | -              | 0.0%     | DoS           ",
    "2024-01-01 10:00:02 | 1.2.3.4            | 1234     | 5.6.7.8            | 80       | 6        | Benign         | 100.0%   | DoS            | 0.0%     | -              | 0.0%     | -             ",
    "not a row | of | the table",
    "-" * 40,
    "  Total Flows:    2  |  Threats: 1",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("reports")
    files = {
        "simul_default_2024-03-05_17-23-17/session_summary.txt": SUMMARY,
        "batch_all_labeled_batch_2_2024-03-06_00-39-56/batch_summary.txt": LABELLED,
        "live_all_2024-03-07_01-00-00/minute_10-00.txt": "\n".join(MINUTES),
        "training_20240101_120000_default/notes.txt": "accuracy=0.9\n",
    }
    for name, text in files.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_index_with_all_fallbacks(spark, folder):
    rows = {r.type: r for r in reports.report_index(spark, folder).collect()}
    s, b, l, t = rows["simul"], rows["batch"], rows["live"], rows["training"]
    assert (s.model, s.flows, s.threats, s.suspicious, s.clean, s.accuracy, s.is_labeled) == ("default", 1250, 300, 0, 950, None, False)
    assert (b.model, b.flows, b.threats, b.suspicious, b.clean, b.accuracy, b.is_labeled) == ("all", 40, 14, 2, 24, "85.00", True)
    assert (l.flows, l.threats, l.suspicious, l.clean) == (2, 1, None, None)
    assert (t.model, t.date, t.date_iso, t.flows) == ("default", "20240101_120000", "20240101T120000", None)
    assert (s.date, s.date_iso) == ("2024-03-05", "2024-03-05T17:23:17")
    assert s.size == len(SUMMARY)


def test_table_rows(spark, folder):
    rows = reports.parse_table_rows(reports.read_lines(spark, folder)).orderBy("timestamp").collect()
    assert len(rows) == 2
    assert (rows[0].class1, rows[0].conf1, rows[0].conf2, rows[0].actual_label) == ("DoS", 0.005, 0.49, "DoS")
    assert (rows[1].conf1, rows[1].actual_label, rows[1].dst_port) == (1.0, None, "80")


def test_breakdown_and_its_fallback(spark, folder):
    rows = {(r.report[:5], r.name): (r["count"], r.pct) for r in reports.breakdown_lines(reports.read_summaries(spark, folder)).collect()}
    assert rows == {
        ("simul", "Benign"): (950, 76.0),
        ("simul", "Brute Force"): (300, 24.0),
        ("batch", "Benign"): (26, 65.0),
        ("batch", "DoS"): (14, 35.0),
    }


def test_session_facts(spark, folder):
    rows = {r.report[:5]: r for r in reports.summary_facts(reports.read_summaries(spark, folder)).collect()}
    assert rows["simul"].duration == "95s" and rows["simul"].accuracy_pct is None
    assert (rows["batch"].accuracy_pct, rows["batch"].accuracy_correct) == (85.0, 34)


def test_empty_text_has_no_values(spark):
    df = spark.createDataFrame([("r", ""), ("n", None)], "report string, text string")
    facts = reports.summary_facts(df).collect()
    assert len(facts) == 2 and all(v is None for r in facts for v in list(r)[1:])
    assert reports.breakdown_lines(df).count() == 0 and reports.class_lines(df).count() == 0
    for stage in reports.STAGE_FIELDS:
        assert all(v is None for r in reports.stage_metrics(df, stage).collect() for v in list(r)[1:])


def test_capped_percent(spark):
    df = spark.createDataFrame([(1.0,), (0.9999,), (0.99985,), (0.5,)], "x double")
    assert [r[0] for r in df.select(reports.capped_percent_text(F.col("x"))).collect()] == ["99.99%", "99.99%", "99.99%", "50.00%"]


def test_long_reports_are_written_in_order(spark, tmp_path):
    lines = spark.range(2000).select(F.lit("r").alias("report"), F.lit("f.txt").alias("file"), F.col("id").cast("double").alias("seq"), F.col("id").cast("string").alias("line"))
    reports.write_lines(lines.repartition(7), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "report=r" / "file=f.txt").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [str(i) for i in range(2000)]
