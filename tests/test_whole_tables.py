"""What is learnt from a table is learnt from all of its rows, whatever their number."""

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import learn
from flowsieve.plans import training

TINY = learn.ForestParams(n_estimators=1, max_depth=1)


def fitted_rows(monkeypatch):
    """A list that takes the number of rows that each forest is given."""
    given, fit = [], learn.fit_forest
    monkeypatch.setattr(learn, "fit_forest", lambda df, *a, **k: given.append(df.count()) or fit(df, *a, **k))
    return given


@pytest.mark.parametrize("rows", [1_000, 5_000_001])
def test_importances_come_from_all_rows(spark, monkeypatch, rows):
    given = fitted_rows(monkeypatch)
    table = spark.range(rows).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 6).alias("x"))
    importances, chosen = learn.select_by_importance(table, ["x"], "y", ["id"], TINY, smallest=1, largest=1)
    assert given == [rows] and chosen == ["x"] and [r.feature for r in importances.collect()] == ["x"]


def test_both_forests_of_a_scorer_grow_on_all_rows(spark, monkeypatch):
    given = fitted_rows(monkeypatch)
    table = spark.range(5_000_001).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 6).alias("x"))
    training.train_scorer(training.Prepared(table, table, ["a", "b"], [], ["x"], []), "id", TINY, TINY, smallest=1, largest=1)
    assert given == [5_000_001] * 2
