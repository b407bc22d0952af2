"""Class distribution, missing and infinite values, duplicates, moments: one scan for each profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.bands import imbalance_severity
from flowsieve.functions.values import all_rows, any_inf, any_missing, is_inf, is_missing, percent, ratio, total_of
from flowsieve.operators.clean import consolidate, drop_identifiers
from flowsieve.operators.running import exact_quantiles
from flowsieve.schema import (
    DROP_CLASS,
    RAW_LABEL_CLASS,
    TRAINING_DROP,
    floating_columns,
    numeric_columns,
)



def class_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(F.col(f"`{label}`").alias("class")).agg(all_rows().alias("n"))


def class_sizes(df: DataFrame, label: str = "Label") -> dict:
    """Rows of each class as metadata: one entry for each class."""
    return {r["class"]: r["n"] for r in class_counts(df, label).collect()}


def class_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    """Count, share and imbalance ratio of each class; the windows run over the class counts."""
    everything = W.partitionBy()
    return class_counts(df, label).select(
        "class",
        "n",
        percent(F.col("n"), F.sum("n").over(everything)).alias("pct"),
        ratio(F.max("n").over(everything), F.col("n")).alias("imbalance_ratio"),
        (percent(F.col("n"), F.sum("n").over(everything)) < 1.0).alias("below_one_percent"),
    )


def class_summary(df: DataFrame, label: str = "Label") -> DataFrame:
    """Totals of the class distribution in one row; ties go to the smaller class name."""
    total = F.sum("n")
    return (
        class_counts(df, label)
        .agg(
            total.alias("rows"),
            all_rows().alias("classes"),
            F.min(F.struct((-F.col("n")).alias("o"), "class"))["class"].alias("majority_class"),
            F.min(F.struct(F.col("n").alias("o"), "class"))["class"].alias("minority_class"),
            ratio(F.max("n"), F.min("n")).alias("max_imbalance_ratio"),
            (1 - F.sum(F.col("n").cast("double") * F.col("n")) / (total.cast("double") * total)).alias("gini_impurity"),
            F.median("n").alias("median_class_size"),
        )
        .withColumn("severity", imbalance_severity(F.col("max_imbalance_ratio")))
    )


def _flag_profile(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    row = df.agg(
        all_rows().alias("rows"),
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.count_if(f).alias("n")) for c, f in flags.items()]
        ).alias("cols"),
    )
    return row.select("rows", F.inline("cols"))


def _flag_totals(df: DataFrame, flags: dict[str, Column], width: int) -> DataFrame:
    per_column = [F.count_if(f) for f in flags.values()]
    row = df.agg(
        all_rows().alias("rows"),
        F.count_if(total_of(list(flags.values())) > 0).alias("rows_affected"),
        F.array(*per_column, F.lit(0).cast("long")).alias("n"),
    )

    def columns_over(threshold: float) -> Column:
        return F.size(F.filter("n", lambda x: percent(x, F.col("rows")) > threshold))

    cells = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return row.select(
        "rows",
        "rows_affected",
        cells.alias("cells"),
        percent(cells, F.col("rows") * width).alias("cells_pct"),
        columns_over(0.0).alias("columns_affected"),
        percent(columns_over(0.0), F.lit(width)).alias("columns_pct"),
        columns_over(1.0).alias("columns_over_1pct"),
        columns_over(10.0).alias("columns_over_10pct"),
    )


def _flag_histogram(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    counted = df.select(total_of(list(flags.values())).alias("per_row"))
    return (
        counted.groupBy("per_row")
        .agg(all_rows().alias("rows"))
        .withColumn("pct", percent(F.col("rows"), F.sum("rows").over(W.partitionBy())))
    )


def _missing_flags(df: DataFrame) -> dict[str, Column]:
    return {c: is_missing(df, c) for c in df.columns}


def _inf_flags(df: DataFrame) -> dict[str, Column]:
    return {c: is_inf(c) for c in floating_columns(df)}


def missing_by_column(df: DataFrame) -> DataFrame:
    return _flag_profile(df, _missing_flags(df)).withColumn("pct", percent(F.col("n"), F.col("rows")))


def missing_totals(df: DataFrame) -> DataFrame:
    return _flag_totals(df, _missing_flags(df), len(df.columns))


def missing_per_row(df: DataFrame) -> DataFrame:
    return _flag_histogram(df, _missing_flags(df))


def infinite_by_column(df: DataFrame) -> DataFrame:
    return _flag_profile(df, _inf_flags(df)).withColumn("pct", percent(F.col("n"), F.col("rows")))


def infinite_totals(df: DataFrame) -> DataFrame:
    """Like missing_totals, over the numeric columns; the share of columns is over all columns."""
    return _flag_totals(df, _inf_flags(df), len(df.columns))


def infinite_per_row(df: DataFrame) -> DataFrame:
    return _flag_histogram(df, _inf_flags(df))


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier equal row. Copies collapse map-side, so a hot row costs one group."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(all_rows().alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("pct", percent(F.col("duplicates"), F.col("rows")))


def column_availability(df: DataFrame) -> DataFrame:
    """NULL and non-NULL share of each column with its type, worst first."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return (
        missing_by_column(df)
        .select(
            "column",
            types[F.col("column")].alias("dtype"),
            (F.col("rows") - F.col("n")).alias("non_null"),
            percent(F.col("rows") - F.col("n"), F.col("rows")).alias("non_null_pct"),
            F.col("n").alias("nulls"),
            F.col("pct").alias("null_pct"),
            (F.col("pct") > 10).alias("high_missing"),
        )
        .orderBy(F.desc("null_pct"), "column")
    )


def initial_statistics(df: DataFrame) -> DataFrame:
    """Size, column kinds and the NULL, infinite and duplicate cells of a table in one row.

    Grouping equal rows first gives the duplicates; the other sums are weighted by the copies, so one
    scan and one shuffle serve all of them.
    """
    cells = len(df.columns)
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(all_rows().alias("copies__"))
    weighted = groups.agg(
        F.sum("copies__").alias("rows"),
        F.sum(total_of(list(_missing_flags(df).values())) * F.col("copies__")).alias("missing_cells"),
        F.sum(total_of(list(_inf_flags(df).values())) * F.col("copies__")).alias("infinite_cells"),
        F.sum(F.col("copies__") - 1).alias("duplicates"),
    )
    numeric = len(numeric_columns(df))
    return weighted.select(
        "rows",
        F.lit(cells).alias("columns"),
        F.lit(numeric).alias("numeric_columns"),
        F.lit(len([f for f in df.schema if isinstance(f.dataType, T.StringType)])).alias("text_columns"),
        "missing_cells",
        percent(F.col("missing_cells"), F.col("rows") * cells).alias("missing_pct"),
        "infinite_cells",
        percent(F.col("infinite_cells"), F.col("rows") * cells).alias("infinite_pct"),
        "duplicates",
        percent(F.col("duplicates"), F.col("rows")).alias("duplicate_pct"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """Columns of each type and their cells that are neither NULL nor NaN; one scan."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count_if(~is_missing(df, c)).alias("filled")) for c, t in df.dtypes
    ]
    rows = df.agg(F.array(*cells).alias("p")).select(F.inline("p"))
    return rows.groupBy("dtype").agg(all_rows().alias("columns"), F.sum("filled").alias("filled_cells"))


WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def storage_by_column(df: DataFrame) -> DataFrame:
    """Bytes of each column: the width of its type, or the UTF-8 length of its texts; one pass."""

    def size(name: str, t: str) -> Column:
        if t == "string":
            return F.coalesce(F.sum(F.octet_length(F.col(f"`{name}`"))), F.lit(0)).cast("long")
        return F.count(F.lit(1)) * F.lit(WIDTHS.get(t, 8))

    row = df.agg(
        all_rows().alias("rows"),
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), size(c, t).alias("bytes"))
                for c, t in df.dtypes
            ]
        ).alias("cols"),
    )
    return row.select("rows", F.inline("cols"))


def storage_by_type(df: DataFrame) -> DataFrame:
    return (
        storage_by_column(df)
        .groupBy("dtype")
        .agg(
            all_rows().alias("columns"),
            F.sum("bytes").alias("bytes"),
            ratio(F.sum("bytes"), F.max("rows")).alias("bytes_per_row"),
        )
    )


def storage_top(df: DataFrame, n: int = 10) -> DataFrame:
    return storage_by_column(df).orderBy(F.desc("bytes"), "column").limit(n)


def describe(df: DataFrame, features: list[str], exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Moments and quartiles of each feature, in one pass.

    Deviation, skewness and kurtosis carry the sample (bias-corrected) form. Quartiles come from a
    mergeable sketch by default; ``exact`` ranks the distinct values of each feature instead.
    """

    quartiles = [0.25, 0.5, 0.75]

    def entry(name: str) -> Column:
        raw = F.col(f"`{name}`").cast("double")
        c = F.when(~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf"))), raw)
        n = F.count(c).cast("double")
        q = F.percentile_approx(c, quartiles, accuracy)
        g1, g2 = F.skewness(c), F.kurtosis(c)
        return F.struct(
            F.lit(name).alias("feature"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            *([] if exact else [q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75")]),
            F.max(c).alias("max"),
            F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        )

    moments = df.agg(F.array(*[entry(f) for f in features]).alias("d")).select(F.inline("d"))
    if not exact:
        return moments
    ranked = exact_quantiles(df, features, quartiles).groupBy(F.col("name").alias("feature")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in zip(quartiles, ("q25", "median", "q75"))]
    )
    return moments.join(ranked, "feature", "left")


def consolidation_impact(
    df: DataFrame, label: str = "Label", mapping: dict[str, str] = RAW_LABEL_CLASS
) -> DataFrame:
    """Class counts and impurity before and after consolidation, from one count over raw labels."""
    raw = class_counts(df, label)
    stages = raw.select(
        F.explode(F.array(F.lit("before"), F.lit("after"))).alias("stage"), F.col("class").alias(label), "n"
    )
    mapped = consolidate(stages, label, mapping).select("stage", F.col(label).alias("mapped"), "n")
    before = raw.select(F.lit("before").alias("stage"), "class", "n")
    after = (
        mapped.filter((F.col("stage") == "after") & ~F.col("mapped").eqNullSafe(F.lit(DROP_CLASS)))
        .groupBy("stage", F.col("mapped").alias("class"))
        .agg(F.sum("n").alias("n"))
    )
    return (
        before.unionByName(after)
        .groupBy("stage")
        .agg(
            F.sum("n").alias("rows"),
            all_rows().alias("classes"),
            ratio(F.max("n"), F.min("n")).alias("max_imbalance_ratio"),
            (1 - F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), 2)).alias(
                "gini_impurity"
            ),
        )
    )


def consolidation_change(impact: DataFrame) -> DataFrame:
    """Rows and classes removed and the relative drop of the impurity."""

    def at(stage: str, c: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(c)))

    before, after = at("before", "gini_impurity"), at("after", "gini_impurity")
    return impact.agg(
        (at("before", "rows") - at("after", "rows")).alias("rows_removed"),
        (at("before", "classes") - at("after", "classes")).alias("classes_removed"),
        F.when(before > 0, (before - after) / before * 100).otherwise(0.0).alias("improvement_pct"),
    )


def cleaning_waterfall(df: DataFrame, label: str = "Label", drop: tuple[str, ...] = TRAINING_DROP) -> DataFrame:
    """Rows removed by each cleaning rule: repeated headers, missing, infinite, duplicates.

    Equal rows share their rule, so grouping them first costs one shuffle and yields the duplicates too.
    """
    rows = drop_identifiers(df, drop)
    rule = (
        F.when(F.col(f"`{label}`").eqNullSafe(F.lit("Label")), "header")
        .when(any_missing(rows), "missing")
        .when(any_inf(rows), "infinite")
        .otherwise("clean")
    )
    groups = (
        rows.withColumn("rule__", rule)
        .groupBy("rule__", *[F.col(f"`{c}`") for c in rows.columns])
        .agg(all_rows().alias("copies__"))
    )
    copies, clean = F.col("copies__"), F.col("rule__") == "clean"
    total = F.sum("copies__")

    def removed(name: str) -> Column:
        return F.sum(F.when(F.col("rule__") == name, copies).otherwise(0))

    duplicates = F.sum(F.when(clean, copies - 1).otherwise(0))
    row = groups.agg(
        total.alias("initial_rows"),
        F.array(
            F.struct(F.lit(1).alias("step"), F.lit("header").alias("rule"), removed("header").alias("removed")),
            F.struct(F.lit(2).alias("step"), F.lit("missing").alias("rule"), removed("missing").alias("removed")),
            F.struct(F.lit(3).alias("step"), F.lit("infinite").alias("rule"), removed("infinite").alias("removed")),
            F.struct(F.lit(4).alias("step"), F.lit("duplicate").alias("rule"), duplicates.alias("removed")),
        ).alias("steps"),
    )
    steps = row.select("initial_rows", F.inline("steps"))
    so_far = F.sum("removed").over(W.orderBy("step"))
    return steps.select(
        "step",
        "rule",
        "removed",
        percent(F.col("removed"), F.col("initial_rows")).alias("removed_pct"),
        (F.col("initial_rows") - so_far).alias("remaining"),
    )


def expected_clean_size(df: DataFrame) -> DataFrame:
    """Rough forecast: rows minus rows with missing, with infinite and with duplicate values."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(all_rows().alias("copies__"))
    removed = (
        any_missing(df).cast("int") * F.col("copies__")
        + any_inf(df).cast("int") * F.col("copies__")
        + (F.col("copies__") - 1)
    )
    return groups.agg(F.sum("copies__").alias("rows"), F.sum(removed).alias("to_remove")).select(
        "rows",
        "to_remove",
        percent(F.col("to_remove"), F.col("rows")).alias("to_remove_pct"),
        (F.col("rows") - F.col("to_remove")).alias("expected_rows"),
    )


def split_check(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Share of each class in both parts and its absolute difference."""
    both = train.select(F.lit("train").alias("part"), F.col(f"`{label}`").alias("class")).unionByName(
        test.select(F.lit("test").alias("part"), F.col(f"`{label}`").alias("class"))
    )
    counts = both.groupBy("class").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"),
        F.count_if(F.col("part") == "test").alias("test_rows"),
    )
    everything = W.partitionBy()
    shares = counts.select(
        "class",
        percent(F.col("train_rows"), F.sum("train_rows").over(everything)).alias("train_pct"),
        percent(F.col("test_rows"), F.sum("test_rows").over(everything)).alias("test_pct"),
    )
    diff = F.abs(F.col("train_pct") - F.col("test_pct"))
    return shares.withColumn("diff", diff).withColumn("max_diff", F.max("diff").over(everything))


