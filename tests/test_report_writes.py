"""The summaries of stored reports are written style by style."""

from flowsieve.operators import reports
from flowsieve.plans import stored_reports

SF = "/root/testdata/sf0.001"


def test_a_write_holds_the_sorts_of_one_style(spark, monkeypatch):
    written, whole = [], reports.write_texts
    monkeypatch.setattr(reports, "write_texts", lambda texts, path: written.append(texts) or whole(texts, path))
    stored_reports._written.cache_clear()
    path = stored_reports._written(spark.sparkContext.applicationId, SF)
    stored_reports._written.cache_clear()
    files = [{r.file for r in texts.select("file").distinct().collect()} for texts in written]
    assert files == [{"session_summary.txt"}, {"batch_summary.txt"}, {"session_summary.txt"}]
    assert reports.read_summaries(spark, path).count() == sum(texts.select("report").distinct().count() for texts in written)
