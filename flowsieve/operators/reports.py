"""Text reports: rendering rows and summaries, and reading folders of them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions import threat
from flowsieve.functions.values import percent

# The report table's columns and widths.
TABLE_COLUMNS = (
    ("Timestamp", 19),
    ("Src IP", 18),
    ("Src Port", 8),
    ("Dst IP", 18),
    ("Dst Port", 8),
    ("Protocol", 8),
    ("Class 1", 14),
    ("Conf 1", 8),
    ("Class 2", 14),
    ("Conf 2", 8),
    ("Class 3", 14),
    ("Conf 3", 8),
)
LABEL_COLUMN = ("Actual Label", 14)
TABLE_WIDTH = 160


def pad(c: Column, width: int) -> Column:
    """Left-justified to a width; longer text is kept whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def confidence_text(c: Column) -> Column:
    return F.format_string("%.1f%%", F.round(c * 100, 1))


def capped_percent_text(share: Column) -> Column:
    """Two digits; what would read as 100 % shows as 99.99 %."""
    p = share * 100
    return F.when(p >= 99.99, "99.99%").otherwise(F.format_string("%.2f%%", F.round(p, 2)))


def report_row(df: DataFrame, ts: str, actual: str | None = None, top: str = "top3") -> Column:
    """One fixed-width table line of a scored flow; '?' for identifiers the table lacks."""

    def identifier(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("?")) if name in df.columns else F.lit("?")

    full = threat.pad_top(F.col(top))
    cells = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss")]
    cells += [identifier(name) for name, _ in TABLE_COLUMNS[1:6]]
    for n in (1, 2, 3):
        cells += [threat.nth_class(full, n), confidence_text(threat.nth_conf(full, n))]
    widths = [w for _, w in TABLE_COLUMNS]
    if actual:
        cells.append(F.coalesce(F.col(actual), F.lit("?")))
        widths.append(LABEL_COLUMN[1])
    return F.concat_ws(" | ", *[pad(c, w) for c, w in zip(cells, widths)])


def table_header(labelled: bool) -> list[str]:
    cols = [*TABLE_COLUMNS, *([LABEL_COLUMN] if labelled else [])]
    return [" | ".join(n.ljust(w) for n, w in cols), "-+-".join("-" * w for _, w in cols)]


def table_lines(
    scored: DataFrame, report: str, file: str, order: str, ts: str, actual: str | None = None
) -> DataFrame:
    """(report, file, seq, line): the table header and a line for each flow of every report file."""
    body = scored.select(report, file, F.col(order).cast("double").alias("seq"), report_row(scored, ts, actual).alias("line"))
    heads = F.array(
        *[F.struct(F.lit(float(i - 10**18)).alias("seq"), F.lit(t).alias("line")) for i, t in enumerate(table_header(bool(actual)))]
    )
    files = scored.select(report, file).distinct().select(report, file, F.inline(heads))
    return files.unionByName(body)


def write_lines(lines: DataFrame, path: str, report: str = "report", file: str = "file") -> None:
    """Lines below report=<name>/file=<name>/, in order.

    A range shuffle on (report, file, seq) spreads a long report over several part files whose names sort
    in line order.
    """
    ordered = lines.repartitionByRange(report, file, "seq").sortWithinPartitions(report, file, "seq")
    ordered.select(report, file, "line").write.mode("append").partitionBy(report, file).text(path)


def write_texts(texts: DataFrame, path: str, report: str = "report", file: str = "file", text: str = "text") -> None:
    """One whole text for each report file."""
    texts.select(report, file, text).write.mode("append").partitionBy(report, file).text(path)


def _rule(c: str, n: int) -> str:
    return c * n


def summary_texts(
    minutes: DataFrame,
    precision: DataFrame,
    report: str = "report",
    title: str = "SESSION SUMMARY",
    labelled: bool = False,
    totals: bool = True,
    minute_section: bool = True,
    seconds: str | None = None,
) -> DataFrame:
    """(report, text): session summaries from a minute rollup and per-class counts of each report.

    The wording is fixed text of the report format. A text grows with the minutes of its session, not with its flows.
    """
    m = F.col("m")
    block = F.format_string(
        "  Minute %s: %s\n    File:       minute_%s.txt\n    Flows:      %d\n    Threats:    %d\n    Suspicious: %d\n    Clean:      %d\n",
        m["no"].cast("string"), F.date_format(m["minute"], "HH:mm"), F.date_format(m["minute"], "HH-mm"),
        m["total"], m["threats"], m["suspicious"], m["clean"],
    )
    order = W.partitionBy(report).orderBy("minute")
    blocks = (
        minutes.withColumn("no", F.row_number().over(order))
        .select(report, F.struct("no", "minute", "total", "threats", "suspicious", "clean").alias("m"))
        .select(report, m["no"].alias("no"), block.alias("block"), m)
        .groupBy(report)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "block"))), lambda b: b["block"]), "\n").alias("blocks"),
            *[F.sum(F.col("m")[c]).alias(c) for c in ("total", "threats", "suspicious", "clean")],
        )
    )
    of_class = W.partitionBy(report)
    share = percent(F.col("predicted"), F.sum("predicted").over(of_class))
    rows = precision.select(
        report, "class", "predicted", "correct", "labelled",
        F.format_string("    %-20s: %6.2f%% (%d/%d)  |  Predicted: %6d", "class", F.round("precision_pct", 2), "correct", "labelled", "predicted").alias("hit_line"),
        F.format_string("    %-20s: %6d (%5.1f%%)", "class", "predicted", F.round(share, 1)).alias("share_line"),
    )
    per_class = rows.groupBy(report).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class", "hit_line"))), lambda r: r["hit_line"]), "\n").alias("hit_lines"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct((-F.col("predicted")).alias("o"), "class", "share_line"))), lambda r: r["share_line"]), "\n"
        ).alias("share_lines"),
        F.sum("correct").alias("hits"),
        F.sum("labelled").alias("labelled"),
    )
    joined = blocks.join(per_class, report)
    if seconds:
        joined = joined.join(minutes.groupBy(report).agg(F.max(seconds).alias("seconds__")), report)
    wide, dash = _rule("=", 100), "  " + _rule("-", 96)
    parts = [F.lit(f"{wide}\n  FLOW CLASSIFICATION - {title}\n{wide}\n")]
    parts.append(F.format_string("  Report Folder:     %s", F.col(report)))
    if seconds:
        parts.append(F.format_string("  Actual Duration:   %ds", F.col("seconds__")))
    if minute_section:
        parts += [F.lit(f"\n  MINUTE-BY-MINUTE BREAKDOWN\n{dash}\n"), F.col("blocks"), F.lit(dash)]
    parts += [F.lit(f"\n  FULL SESSION SUMMARY\n{dash}\n"), F.format_string("  Total Flows Classified: %d", F.col("total"))]
    if totals:
        for name, c in (("Threats Detected:", "threats"), ("Suspicious Flows:", "suspicious"), ("Clean Flows:", "clean")):
            parts.append(F.format_string(f"  {name:24s}%d", F.col(c)))
    if labelled:
        accuracy = F.round(percent(F.col("hits"), F.col("labelled")), 2)
        parts.append(F.format_string("\n  Accuracy:               %.2f%% (%d/%d)\n", accuracy, F.col("hits"), F.col("labelled")))
        parts += [F.lit("  Per-Class Precision (of predicted, how many correct):"), F.col("hit_lines")]
    parts += [F.lit("\n  Classification Breakdown:"), F.col("share_lines"), F.lit("\n" + wide)]
    return joined.select(report, F.concat_ws("\n", *parts).alias("text"))


# Labels as the stored reports print them, and what of the text after the label is kept.
TYPE_PREFIXES = ("simulation", "training", "batch", "live", "simul")
MODELS = ("default", "all")
SUMMARY_FILES = ("session_summary.txt", "batch_summary.txt")
METRIC_KEYS = ("accuracy", "f1_score", "model_variant", "total_flows", "threat_percentage", "model_accuracy")
TOTAL_LABELS = {
    "flows": "Total Flows Classified",
    "threats": "Threats Detected",
    "suspicious": "Suspicious Flows",
    "clean": "Clean Flows",
}
MINUTE_LABELS = {"minute_threats": "Threats", "minute_suspicious": "Suspicious", "minute_clean": "Clean"}
BREAKDOWN_SECTION = "Classification Breakdown"
CLASS_SECTION = "Per-Class Performance"
#: stage: (column, section that must have begun, label, part of the value)
STAGE_FIELDS = {
    "exploration": (
        ("total_rows", None, "Total Rows", "word"),
        ("total_columns", None, "Total Columns", "word"),
        ("original_classes", None, "Total Classes", "word"),
        ("consolidated_classes", "AFTER Consolidation", "Classes", "word"),
        ("gini_coefficient", None, "Gini Coefficient", "word"),
        ("imbalance_severity", None, "Imbalance Severity", "word"),
        ("memory_usage", None, "Memory Usage", "two words"),
    ),
    "preprocessing": (
        ("initial_rows", "Initial Dataset", "Rows", "word"),
        ("final_rows", "Final Clean Dataset", "Rows", "word"),
        ("rows_removed", None, "Total removed", "word"),
        ("data_loss_pct", None, "Total removed", "percent in brackets"),
        ("training_samples", None, "Samples after", "word"),
        ("test_samples", None, "Test set", "word"),
        ("smote_samples", None, "Synthetic samples", "word"),
        ("features_selected", None, "Features selected", "word"),
    ),
    "training": (
        ("cv_f1_score", None, "Macro F1-Score", "word"),
        ("tuning_time", None, "Hyperparameter Tuning", "two words"),
        ("training_time", None, "Final Model Training", "two words"),
        ("total_time", None, "Total Training Time", "two words"),
        ("trees", None, "Number of Trees", "word"),
        ("avg_depth", None, "Average Tree Depth", "word"),
        ("features", "Training Configuration", "Features", "word"),
        ("top10_importance", None, "Top 10 features", "word"),
    ),
    "testing": (
        ("accuracy", None, "Accuracy", "word"),
        ("macro_f1", None, "Macro F1-Score", "word"),
        ("inference_speed", None, "Inference speed", "all"),
        ("mean_confidence", None, "Mean confidence", "word"),
        ("binary_accuracy", "4. BINARY", "Accuracy", "word"),
        ("binary_precision", "4. BINARY", "Precision", "word"),
        ("binary_recall", "4. BINARY", "Recall (TPR)", "word"),
        ("binary_specificity", "4. BINARY", "Specificity (TNR)", "word"),
        ("binary_auc", "4. BINARY", "Binary AUC", "word"),
        ("binary_f1", "4. BINARY", "F1-Score", "word"),
    ),
}


def entries(texts: DataFrame, sections: Sequence[str] = (), text: str = "text") -> DataFrame:
    """(report, no, line, label, rest, in_0, in_1, ...): the lines of each text, cut at their first colon.

    ``in_<i>`` tells whether the i-th section's heading came before the line. A text without lines is one empty line.
    """
    lines = texts.select("report", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("no", "raw"))
    line = lines.select("report", "no", F.trim("raw").alias("line"))
    at = F.instr("line", ":")
    cut = line.withColumns(
        {
            "label": F.when(at > 0, F.trim(F.substring("line", F.lit(1), at - 1))),
            "rest": F.when(at > 0, F.trim(F.substring("line", at + 1, F.length("line")))),
        }
    )
    before = W.partitionBy("report").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    begun = {f"in_{i}": F.coalesce(F.max(F.contains("line", F.lit(s))).over(before), F.lit(False)) for i, s in enumerate(sections)}
    return cut.withColumns(begun) if begun else cut


def _word(rest: Column) -> Column:
    return F.get(F.split(rest, r"\s+"), F.lit(0))


def _brackets(rest: Column) -> Column:
    """What stands in the last brackets; NULL without any."""
    return F.when(F.contains(rest, F.lit("(")), F.substring_index(F.substring_index(rest, "(", -1), ")", 1))


def _part(rest: Column, part: str) -> Column:
    if part == "word":
        return _word(rest)
    if part == "two words":
        return F.array_join(F.slice(F.split(rest, r"\s+"), 1, 2), " ")
    if part == "percent in brackets":
        return F.replace(_brackets(rest), F.lit("%"), F.lit(""))
    return rest


def _number(rest: Column) -> Column:
    return F.replace(_word(rest), F.lit(","), F.lit("")).try_cast("long")


def _first(value: Column, where: Column) -> Column:
    """The value of the first line, in order, for which the condition holds."""
    return F.min_by(F.when(where, value), F.when(where & value.isNotNull(), F.col("no")))


def name_from_path(path: Column, part: str) -> Column:
    """Report or file name from ``.../<report>/<file>`` or ``.../report=<report>/file=<file>/part-...``."""
    keyed = F.url_decode(F.regexp_extract(path, rf"/{part}=([^/]+)/", 1))
    plain = F.element_at(F.split(path, "/"), -2 if part == "report" else -1)
    return F.when(keyed != "", keyed).otherwise(F.url_decode(plain))


def _files(spark, folder: str, whole: bool) -> DataFrame:
    path = F.col("_metadata.file_path")
    return (
        spark.read.text(folder, wholetext=whole, recursiveFileLookup=True)
        .select(
            name_from_path(path, "report").alias("report"),
            name_from_path(path, "file").alias("file"),
            F.col("_metadata.file_size").alias("bytes"),
            path.alias("path"),
            "value",
        )
    )


def read_summaries(spark, folder: str) -> DataFrame:
    """(report, text): the session summary of each report, else its batch summary."""
    texts = _files(spark, folder, True).filter(F.col("file").isin(*SUMMARY_FILES))
    first = F.min_by("value", F.col("file") != SUMMARY_FILES[0])
    return texts.groupBy("report").agg(first.alias("text"))


def is_minute_file(file: Column) -> Column:
    """minute_HH-mm.txt"""
    time = F.replace(F.replace(file, F.lit("minute_"), F.lit("")), F.lit(".txt"), F.lit(""))
    return file.startswith("minute_") & file.endswith(".txt") & (F.length(time) == 5) & F.try_to_timestamp(time, F.lit("HH-mm")).isNotNull()


def read_lines(spark, folder: str) -> DataFrame:
    """(report, file, line) of minute and batch result files; line by line, so long files are split."""
    tables = is_minute_file(F.col("file")) | (F.col("file") == "batch_results.txt")
    return _files(spark, folder, False).filter(tables).select("report", "file", F.col("value").alias("line"))


def report_sizes(spark, folder: str) -> DataFrame:
    """Bytes of each report's files, from the listing alone."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    )
    return files.groupBy(name_from_path(F.col("path"), "report").alias("report")).agg(F.sum("length").alias("size"))


def parse_folder_name(name: str) -> list[Column]:
    """type, model, date, date_iso and is_labeled of a report folder name, older forms included.

    The present form is ``type_model[_more]_yyyy-MM-dd_HH-mm-ss``; older names carry a date, or a date and a time
    without separators, somewhere.
    """
    lower = F.lower(F.col(name))
    parts = F.split(F.col(name), "_")
    last, day = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    digits = lambda c, n: (F.length(c) == n) & F.translate(c, "0123456789", "").eqNullSafe(F.lit(""))
    is_day = lambda c: (F.length(c) == 10) & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()
    is_time = (F.length(last) == 8) & F.try_to_timestamp(last, F.lit("HH-mm-ss")).isNotNull()
    known = (F.size(parts) >= 4) & F.get(parts, F.lit(1)).isin(*MODELS) & is_day(day) & is_time
    known = F.coalesce(known, F.lit(False))
    prefix = F.lit("unknown")
    for p in reversed(TYPE_PREFIXES):
        prefix = F.when(lower.startswith(p), p).otherwise(prefix)
    model = F.when(lower.contains("_default"), "default").when(lower.contains("_all"), "all")
    following = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    dated = F.transform(
        following,
        lambda x: F.when(is_day(x["a"]), x["a"])
        .when(digits(x["a"], 8) & digits(x["b"], 6), F.concat(x["a"], F.lit("_"), x["b"]))
        .when(digits(F.substring_index(x["a"], "-", 1), 8) & digits(F.substring_index(x["a"], "-", -1), 6), x["a"]),
    )
    date = F.get(F.array_compact(dated), F.lit(0))
    iso = F.concat(day, F.lit("T"), F.replace(last, F.lit("-"), F.lit(":")))
    return [
        F.when(known, F.get(parts, F.lit(0))).otherwise(prefix).alias("type"),
        F.when(known, F.get(parts, F.lit(1))).otherwise(model).alias("model"),
        F.when(known, day).otherwise(date).alias("date"),
        F.when(known, iso).otherwise(F.replace(date, F.lit("_"), F.lit("T"))).alias("date_iso"),
        lower.contains("labeled").alias("is_labeled"),
    ]


def summary_facts(summaries: DataFrame, text: str = "text") -> DataFrame:
    """One row for each summary: totals, sums over its minutes, duration and accuracy; NULL for what it lacks."""
    label, rest = F.col("label"), F.col("rest")
    accurate = (label == "Accuracy") & F.contains(rest, F.lit("%"))
    counted = accurate & F.contains(rest, F.lit("/"))
    accuracy = F.replace(_word(rest), F.lit("%"), F.lit(""))
    return entries(summaries, text=text).groupBy("report").agg(
        *[_first(_number(rest), label == known).alias(c) for c, known in TOTAL_LABELS.items()],
        *[F.sum(F.when(label == known, _number(rest))).alias(c) for c, known in MINUTE_LABELS.items()],
        _first(_word(rest), label == "Actual Duration").alias("duration"),
        _first(accuracy, accurate).alias("accuracy_text"),
        _first(accuracy.try_cast("double"), counted).alias("accuracy_pct"),
        _first(F.substring_index(_brackets(rest), "/", 1).try_cast("long"), counted).alias("accuracy_correct"),
    )


def class_lines(summaries: DataFrame, text: str = "text") -> DataFrame:
    """(report, class, correct, predicted, wrong) from the per-class precision lines.

    Such a line is ``class: share (correct/labelled) | Predicted: number``.
    """
    halves = F.split("rest", r"\|")
    tail = F.trim(F.get(halves, F.lit(1)))
    rows = entries(summaries, text=text).filter((F.size(halves) == 2) & tail.startswith("Predicted:"))
    counts = F.split(_brackets(F.get(halves, F.lit(0))), "/")
    correct, labelled = (F.get(counts, F.lit(i)).try_cast("long") for i in (0, 1))
    predicted = _number(F.trim(F.substring_index(tail, ":", -1)))
    rows = rows.select("report", F.col("label").alias("class"), correct.alias("correct"), predicted.alias("predicted"), (labelled - correct).alias("wrong"))
    return rows.filter("wrong IS NOT NULL AND predicted IS NOT NULL")


def threats_from_classes(classes: DataFrame) -> DataFrame:
    attack = F.lower("class") != "benign"
    return classes.groupBy("report").agg(F.sum(F.when(attack, F.col("predicted")).otherwise(0)).alias("class_threats"))


def breakdown_lines(summaries: DataFrame, text: str = "text") -> DataFrame:
    """(report, name, count, pct) from the class breakdown; summaries without one use their per-class lines.

    A line of the breakdown is ``class: number (share%)``.
    """
    inside = _brackets(F.col("rest"))
    lines = entries(summaries, [BREAKDOWN_SECTION], text).filter(F.col("in_0") & inside.endswith("%"))
    direct = lines.select(
        "report", F.col("label").alias("name"), _number(F.col("rest")).alias("count"),
        F.trim(F.replace(inside, F.lit("%"), F.lit(""))).try_cast("double").alias("pct"),
    ).filter("count IS NOT NULL AND pct IS NOT NULL")
    listed = direct.select("report").distinct()
    of_report = F.sum("predicted").over(W.partitionBy("report"))
    flows = summary_facts(summaries, text).select("report", "flows")
    derived = class_lines(summaries, text).join(listed, "report", "left_anti").join(flows, "report").select(
        "report", F.col("class").alias("name"), F.col("predicted").alias("count"),
        F.round(percent(F.col("predicted"), F.coalesce("flows", of_report)), 1).alias("pct"),
    )
    return direct.unionByName(derived)


def parse_table_rows(lines: DataFrame) -> DataFrame:
    """Thirteen columns of the table lines; confidences become fractions, other lines drop out.

    A data line has at least twelve cells and is neither the heading nor a rule. Each line is judged by
    itself, so a file of any length is read in parallel.
    """
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    head = F.ltrim("line")
    rows = lines.withColumn("cells", cells).filter(
        (F.size("cells") >= 12) & ~head.startswith("-") & ~head.startswith("=") & ~F.col("line").contains("Timestamp")
    )

    def cell(i: int) -> Column:
        return F.get("cells", F.lit(i))

    def confidence(i: int) -> Column:
        return F.round(F.trim(F.replace(cell(i), F.lit("%"), F.lit(""))).try_cast("double") / 100, 6)

    names = ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "class1", "conf1", "class2", "conf2", "class3", "conf3")
    label = F.when(~cell(12).isin("", "-", "?"), cell(12))
    return rows.select(
        "report", "file",
        *[(confidence(i) if n.startswith("conf") else cell(i)).alias(n) for i, n in enumerate(names)],
        label.alias("actual_label"),
    )


def counts_from_rows(rows: DataFrame) -> DataFrame:
    """Flows and threats of a report from its minute files."""
    minutes = rows.filter(is_minute_file(F.col("file")))
    return minutes.groupBy("report").agg(
        F.count(F.lit(1)).alias("row_flows"), F.count_if(F.col("class1") != "Benign").alias("row_threats")
    )


def metric_lines(summaries: DataFrame, text: str = "text") -> DataFrame:
    """(report, key, value) of the known key=value lines."""
    line = summaries.select("report", F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").contains("="))
    key, at = F.trim(F.split("line", "=", 2)[0]), F.instr("line", "=")
    return line.select(
        "report", key.alias("key"), F.trim(F.substring("line", at + 1, F.length("line"))).alias("value")
    ).filter(F.col("key").isin(*METRIC_KEYS))


def stage_metrics(texts: DataFrame, stage: str, text: str = "text") -> DataFrame:
    """One row of metrics for each exploration, preprocessing, training or testing report.

    Training reports also give the first row of their table of features.
    """
    fields = STAGE_FIELDS[stage]
    sections = list(dict.fromkeys(s for _, s, _, _ in fields if s))
    found = [
        _first(_part(F.col("rest"), part), (F.col("label") == label) & (F.col(f"in_{sections.index(s)}") if s else F.lit(True))).alias(c)
        for c, s, label, part in fields
    ]
    if stage == "training":
        cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
        top = (F.size(cells) >= 4) & (F.get(cells, F.lit(0)) == "1")
        found += [_first(F.get(cells, F.lit(i)), top).alias(c) for i, c in ((1, "top_feature"), (2, "top_feature_importance"))]
    return entries(texts, sections, text).groupBy("report").agg(*found)


def testing_classes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Per-class rows of testing reports: a name and five numbers, from the section's heading to the next empty line."""
    names = ("precision", "recall", "f1", "auc", "support")
    words = F.split("line", r"\s+")
    n = F.size(words)
    order = W.partitionBy("report").orderBy("no")
    inside = entries(texts, [CLASS_SECTION], text).withColumn("over", F.max(F.col("in_0") & (F.col("line") == "")).over(order))
    numbers = F.slice(words, n - 4, F.lit(5))
    numeric = F.forall(numbers, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double").isNotNull())
    rows = inside.filter(F.col("in_0") & ~F.col("over") & (n >= 6)).filter(numeric)
    return rows.select(
        "report", F.array_join(F.slice(words, F.lit(1), n - 5), " ").alias("class"), *[F.get(numbers, F.lit(i)).alias(c) for i, c in enumerate(names)]
    )


def read_texts(spark, folder: str, file: str) -> DataFrame:
    """(report, text): one named file of each report."""
    return _files(spark, folder, True).filter(F.col("file") == file).select("report", F.col("value").alias("text"))


def report_index(spark, folder: str) -> DataFrame:
    """One row for each report folder: name parts, totals with their fallbacks, accuracy and size.

    Labelled summaries without totals take threats from their per-class lines and the rest from their
    minute section; reports without a summary are counted from their minute rows.
    """
    sizes = report_sizes(spark, folder)
    summaries = read_summaries(spark, folder)
    facts = summary_facts(summaries).withColumn("has_summary", F.lit(True))
    classes = threats_from_classes(class_lines(summaries))
    counted = counts_from_rows(parse_table_rows(read_lines(spark, folder)))
    rows = sizes.select("report", "size", *parse_folder_name("report"))
    for part in (facts, classes, counted):
        rows = rows.join(part, "report", "left")
    labelled, bare = F.col("is_labeled"), F.col("has_summary").isNull()
    use_rows = labelled | bare
    return rows.select(
        F.col("report").alias("name"), "type", "model", "date", "date_iso", "is_labeled",
        F.when(labelled, F.col("accuracy_text")).alias("accuracy"),
        F.coalesce("flows", F.when(use_rows, F.col("row_flows"))).alias("flows"),
        F.coalesce(
            "threats",
            F.when(labelled, F.coalesce("class_threats", "row_threats", "minute_threats")),
            F.when(bare, F.col("row_threats")),
        ).alias("threats"),
        F.coalesce("suspicious", F.when(labelled, F.col("minute_suspicious"))).alias("suspicious"),
        F.coalesce("clean", F.when(labelled, F.col("minute_clean"))).alias("clean"),
        "size",
    )
