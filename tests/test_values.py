"""NULL, NaN, infinity, ties, empty tables, single classes."""

import math

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import threat
from flowsieve.operators import clean, encode, evaluate, profile, rollup
from flowsieve.operators.balance import oversampling_targets
from flowsieve.schema import detect_label_last, require_header
from flowsieve.sources.csv_flows import coerce_numeric, field_count, scan_csv_dir

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 1.0, "a"), (2, None, "b"), (3, NAN, "c"), (4, INF, "d"), (5, -INF, None), (6, 1.0, "a")]
    return spark.createDataFrame(rows, "id int, v double, s string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_missing_rows_cover_null_and_nan_but_not_infinity(odd):
    assert ids(clean.drop_missing_rows(odd)) == [1, 4, 6]


def test_infinite_rows_keep_null_and_nan(odd):
    assert ids(clean.drop_infinite_rows(odd)) == [1, 2, 3, 6]


def test_zero_fill(odd):
    got = {r.id: r.v for r in clean.zero_fill(odd, ["v"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}


def test_deduplicate_counts_equal_nan_once(spark):
    df = spark.createDataFrame([(NAN,), (NAN,), (None,), (None,), (1.0,)], "v double")
    assert clean.deduplicate(df).count() == 3
    assert profile.duplicate_profile(df).first().duplicates == 2


def test_empty_table_profiles(spark):
    empty = spark.createDataFrame([], "id int, v double, Label string")
    assert profile.missing_totals(empty).first().cells_pct == 0.0
    assert profile.duplicate_profile(empty).first().rows == 0
    assert profile.class_distribution(empty).count() == 0
    assert rollup.threat_totals(empty.withColumn("threat_level", F.lit("RED"))).first().threat_pct == 0.0


def test_zero_variance_scale_is_one(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    params = encode.fit_scaler(df, ["v"])
    assert params.first().scale == 1.0
    assert [r.v for r in encode.apply_scaler(df, params).collect()] == [0.0, 0.0]


def test_top_classes_break_ties_by_index(spark):
    df = spark.createDataFrame([([0.4, 0.2, 0.4],)], "p array<double>")
    top = df.select(threat.top_classes(F.col("p"), ["x", "y", "z"]).alias("t")).first().t
    assert [t["class"] for t in top] == ["x", "z", "y"]


@pytest.mark.parametrize(
    "top, level",
    [
        ([("Benign", 0.9), ("DoS", 0.1)], "GREEN"),
        ([("Benign", 0.7), ("DoS", 0.25)], "YELLOW"),
        ([("Benign", 0.75), ("DoS", 0.2499)], "GREEN"),
        ([("DoS", 0.6), ("Benign", 0.4)], "RED"),
        ([("Benign", 1.0)], "GREEN"),
    ],
)
def test_threat_level(spark, top, level):
    df = spark.createDataFrame([(top,)], "t array<struct<class: string, conf: double>>")
    assert df.select(threat.threat_level(F.col("t"))).first()[0] == level


def test_pad_top(spark):
    df = spark.createDataFrame([([("A", 1.0)],)], "t array<struct<class: string, conf: double>>")
    assert [tuple(x) for x in df.select(threat.pad_top(F.col("t"))).first()[0]] == [("A", 1.0), ("-", 0.0), ("-", 0.0)]


def test_coercion_needs_more_than_half(spark):
    df = spark.createDataFrame([("1", "1"), ("x", "2"), ("2", "nan"), ("y", "z")], "half string, most string")
    assert dict(coerce_numeric(df).dtypes) == {"half": "string", "most": "string"}
    df = df.union(spark.createDataFrame([("3", "3")], df.schema))
    out = coerce_numeric(df)
    assert dict(out.dtypes) == {"half": "double", "most": "double"}
    assert not any(r.most is not None and math.isnan(r.most) for r in out.collect())


def test_field_count_honours_quotes(spark):
    df = spark.createDataFrame([('a,"b,c",d',), ("",), ('"x""y,z",1',)], "s string")
    assert [r[0] for r in df.select(field_count(F.col("s"))).collect()] == [3, 1, 2]


def test_unlisted_and_null_labels_survive_consolidation(spark):
    df = spark.createDataFrame([("Bot",), ("New",), (None,)], "Label string")
    assert [r.Label for r in clean.consolidate(df).collect()] == ["Botnet", "New", None]
    assert clean.drop_classes(df).count() == 3


def test_single_class_has_no_oversampling_target(spark):
    df = spark.createDataFrame([("a",)] * 3, "Label string")
    assert oversampling_targets(df, "Label").count() == 0


def test_metrics_of_a_never_predicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    m = {r["class"]: r for r in evaluate.class_metrics(evaluate.confusion_counts(df, "t", "p")).collect()}
    assert (m["b"].precision, m["b"].recall, m["b"].f1, m["b"].support) == (0.0, 0.0, 0.0, 1)


def test_many_categories_are_all_found(spark):
    """There is no cap on the values of a category."""
    rows = spark.range(1_200).withColumnRenamed("id", "c")
    assert encode.few_values(rows, "c") == list(range(1_200))


def test_header_helpers():
    assert detect_label_last(["x", " LABEL ", "z"]) == " LABEL "
    assert detect_label_last(["x", "z"]) == "z"
    with pytest.raises(ValueError):
        require_header(["1", "2.5"])
    require_header(["1", "x"])


def test_csv_folder_jobs_do_not_follow_the_files(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / f"f{n}"
        folder.mkdir()
        for i in range(n):
            head, row = ("a,Label", f"{i},x") if i % 2 else ("Label,a", f"x,{i}")
            (folder / f"part +{i} %.csv").write_text(f"\n{head}\n{row}\n")
        (folder / "empty.csv").write_text("")
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        parsed = scan_csv_dir(spark, str(folder))
        made = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted(tuple(r) for r in parsed.good.select("Label", F.col("a").cast("int")).collect()) == [("x", i) for i in range(n)]
        return made

    assert jobs(4) == jobs(24)
