"""Queries for scans, sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import learn
from flowsieve.plans.fixtures import FLOWS, IMPORTANCES, MAPPED, SCORED, flows, importances, scored
from flowsieve.plans.profiles import PICK, TEST_ROWS, consolidated
from flowsieve.plans.registry import query, rounded, table
from flowsieve.plans.streams import line_files
from flowsieve.plans.training import SMALL, SPLIT, TWINS, small_prepared, small_scorer, twice
from flowsieve.operators.sample import stratified_split
from flowsieve.session import scratch_path
from flowsieve.sources import csv_flows, tables


def csv_folder(spark, d):
    """Events in CSV files of two column orders, one of them without ``props`` and with spaces in names."""
    e = table(spark, d, "events").drop("ts")
    path = scratch_path(spark, "csv")
    odd = F.col("event_id") % 2 == 1
    e.filter(~odd).drop("props").write.option("header", "true").csv(f"{path}/a")
    e.filter(odd).select("value", "props", "event_type", "user_id", "event_id").write.option("header", "true").csv(f"{path}/b")
    return path


@query("a1_scan_csv_dir", """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, round(value, 6) AS value,
    CASE WHEN event_id % 2 = 1 THEN props END AS props FROM events""")
def _(spark, d):
    rows = csv_flows.scan_csv_dir(spark, csv_folder(spark, d)).good
    return rounded(rows.withColumn("value", F.col("value").cast("double")))


@query("a2_tolerant_parse", """SELECT event_id, CASE event_id % 50 WHEN 7 THEN NULL WHEN 11 THEN 'many' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value
    FROM events WHERE event_id % 50 <> 9""")
def _(spark, d):
    parsed = csv_flows.scan_csv_dir(spark, line_files(spark, d))
    return parsed.good.select(F.col("event_id").cast("long").alias("event_id"), "value")


@query("a2_rejected_lines", """SELECT CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || ',' || event_type || ',1.5,surplus' AS line, 4 AS expected_fields
    FROM events WHERE event_id % 50 = 9""")
def _(spark, d):
    return csv_flows.scan_csv_dir(spark, line_files(spark, d)).rejected


def broken_csv(spark, d):
    """Events in CSV files whose notes hold line breaks, quotes and commas; quotes are doubled."""
    n = F.col("event_id")
    note = F.when(n % 3 == 0, F.concat(F.lit("seen\nby "), F.col("user_id"), F.lit(', "twice"\n\nand "again"'))).when(
        n % 3 == 1, F.concat(F.lit('5" disk, '), n)
    )
    path = scratch_path(spark, "broken")
    writer = table(spark, d, "events").select("event_id", note.alias("note"), "event_type").write
    writer.option("header", "true").option("escape", '"').option("maxRecordsPerFile", 2000).csv(path)
    return path


@query("a2_quoted_breaks", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('seen', chr(10), 'by ', user_id, ', "twice"', chr(10), chr(10), 'and "again"')
    WHEN 1 THEN concat('5" disk, ', event_id) END AS note, event_type FROM events""")
def _(spark, d):
    rows = csv_flows.scan_csv_dir(spark, broken_csv(spark, d), escape='"').good
    return rows.withColumn("event_id", F.col("event_id").cast("long"))


def mixed_texts(spark, d):
    """Text columns of which all, 60 % and 40 % of the rows are numbers."""
    n = F.col("event_id")
    number = F.col("value").cast("string")
    return table(spark, d, "events").select(
        "event_id", number.alias("full"), F.when(n % 5 < 3, number).otherwise("x").alias("most"),
        F.when(n % 5 < 2, number).otherwise("x").alias("few"), F.col("user_id").cast("string").alias("Src Port"),
    )


@query("a3_coerce_numeric", """SELECT event_id, round(value, 6) AS full, CASE WHEN event_id % 5 < 3 THEN round(value, 6) END AS most,
    event_id % 5 >= 2 AS few_is_x, CAST(user_id AS VARCHAR) AS "Src Port" FROM events""")
def _(spark, d):
    rows = csv_flows.coerce_numeric(mixed_texts(spark, d))
    return rounded(rows.select("event_id", "full", "most", (F.col("few") == "x").alias("few_is_x"), "Src Port"))


@query("a5_drop_header_rows", f"""WITH {FLOWS} SELECT event_id, "Label" FROM flows WHERE "Label" <> 'Label'""")
def _(spark, d):
    return csv_flows.drop_header_rows(flows(spark, d)).select("event_id", "Label")


@query("a6_role_identifiers", f"""WITH {FLOWS} SELECT event_id, "Flow ID", "Src IP", "Dst Port", "Protocol" FROM flows""")
def _(spark, d):
    return tables.split_roles(flows(spark, d), ["event_id"]).identifiers


@query("a6_role_features", f"""WITH {FLOWS} SELECT event_id, user_id, "Dst Port", "Protocol", k, hr FROM flows""")
def _(spark, d):
    return tables.split_roles(flows(spark, d).drop("ts", "value"), ["event_id"]).features


@query("a6_role_labels", f"""WITH {FLOWS} SELECT event_id, "Label" FROM flows""")
def _(spark, d):
    return tables.split_roles(flows(spark, d), ["event_id"]).labels


@query("a9_dataset_round_trip", f"""WITH {FLOWS} SELECT event_id, k, "Label", 'Label' AS label_column FROM flows""")
def _(spark, d):
    path = scratch_path(spark, "dataset")
    tables.save_dataset(flows(spark, d).select("event_id", "k", "Label"), path, {"label": "Label", "protocol": None})
    rows, info = tables.load_dataset(spark, path)
    return rows.withColumn("label_column", F.lit(info["label"]))


@query("a10_split_round_trip", f"""WITH {FLOWS}, {MAPPED}, {PICK.format(total=TEST_ROWS)} SELECT event_id, cls AS "Label", CASE WHEN picked THEN 'test' ELSE 'train' END AS part FROM picks""")
def _(spark, d):
    path = scratch_path(spark, "split")
    train, test = stratified_split(consolidated(spark, d), "Label", ["event_id"], portable=True)
    tables.write_split(train, test, path, "Label")
    back = [p.select("event_id", "Label", F.lit(n).alias("part")) for p, n in zip(tables.read_split(spark, path), ("train", "test"))]
    return back[0].unionByName(back[1])


@query("a11_importance_csv", f"""WITH {IMPORTANCES} SELECT feature, round(importance, 6) AS importance FROM importances""")
def _(spark, d):
    path = scratch_path(spark, "importances")
    learn.write_importances(importances(spark, d), path)
    return rounded(learn.read_importances(spark, path))


def reloaded_scores(spark, d):
    """The scores of a scorer, and those of the scorer read back from its files."""
    path = scratch_path(spark, "scorer")
    scorer = small_scorer(spark, d)
    learn.save_scorer(spark, scorer, path)
    columns = ["event_id", "predicted_class", "threat_level", F.round("confidence", 9).alias("confidence")]
    return [s.score(flows(spark, d).drop("ts")).select(*columns) for s in (scorer, learn.load_scorer(spark, path))]


@query("a12_scorer_round_trip")
def _(spark, d):
    first, second = reloaded_scores(spark, d)
    return first.join(second.select("event_id", *[F.col(c).alias(f"reloaded_{c}") for c in second.columns[1:]]), "event_id")


@query("a12_scorer_invariants", "SELECT event_id, true AS same_after_reload FROM events")
def _(spark, d):
    first, second = reloaded_scores(spark, d)
    return twice(first.unionByName(second), "event_id", "same_after_reload")


@query("a13_training_metadata", f"""WITH {FLOWS}, {MAPPED}, {SPLIT}, {TWINS} SELECT 'RandomForestClassifier' AS model_type, string_agg(cls, ',' ORDER BY cls) AS classes,
    CAST(count(*) AS INT) AS n_classes, CAST(8 - (SELECT CAST(gone AS INT) FROM twins) AS BIGINT) AS n_features, 3 AS n_iterations, 2 AS cv_folds, CAST(sum(n - test) AS BIGINT) AS n_samples, CAST(10 AS BIGINT) AS n_estimators FROM split""")
def _(spark, d):
    p = small_prepared(spark, d, balance=False)
    model = learn.fit_forest(p.train, p.features, "y", SMALL)
    record = learn.training_metadata(
        spark, p.classes, {"n_estimators": 10}, 0.0, p.train.count(), learn.forest_shape(spark, model),
        learn.forest_importances(spark, model, p.features), iterations=3, folds=2,
    )
    path = scratch_path(spark, "metadata")
    record.write.json(path)
    row = spark.read.schema(record.schema).json(path)
    return row.select(
        "model_type", F.array_join("class_names", ",").alias("classes"), "n_classes", "n_features", "search.n_iterations", "search.cv_folds",
        "final_training.n_samples", "final_training.n_estimators",
    )


@query("a14_preview", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20""")
def _(spark, d):
    return tables.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("a14_inspect", """SELECT (SELECT count(*) FROM documents) AS rows, position, "column", dtype, nulls FROM (
    SELECT 0 AS position, 'doc_id' AS "column", 'bigint' AS dtype, count_if(doc_id IS NULL) AS nulls FROM documents
    UNION ALL SELECT 1, 'text', 'string', count_if(text IS NULL) FROM documents UNION ALL SELECT 2, 'lang', 'string', count_if(lang IS NULL) FROM documents
    UNION ALL SELECT 3, 'source', 'string', count_if(source IS NULL) FROM documents UNION ALL SELECT 4, 'n_chars', 'bigint', count_if(n_chars IS NULL) FROM documents)""")
def _(spark, d):
    return tables.inspect(table(spark, d, "documents"))


@query("a14_file_shapes", """SELECT event_type AS file, count(*) AS rows, 3 AS cols FROM events GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "shapes")
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    e.write.partitionBy("event_type").option("header", "true").csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "event_type=([^/]+)/", 1)
    rows = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path).select("*", folder.alias("file"))
    return csv_flows.file_shapes(rows, "file")


@query("a15_export_csv", f"""WITH {SCORED} SELECT event_id, c1 AS predicted_class, round(q1, 6) AS confidence FROM scored""")
def _(spark, d):
    path = scratch_path(spark, "export-csv")
    rows = rounded(scored(spark, d).select("event_id", "predicted_class", "confidence"))
    tables.export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


@query("a15_export_json", f"""WITH {SCORED} SELECT event_id, c1 AS predicted_class, round(q1, 6) AS confidence FROM scored""")
def _(spark, d):
    path = scratch_path(spark, "export-json")
    rows = rounded(scored(spark, d).select("event_id", "predicted_class", "confidence"))
    tables.export_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def estimate_and_count(spark, d):
    path = scratch_path(spark, "estimate")
    table(spark, d, "events").drop("ts").write.option("header", "true").csv(path)
    guess = csv_flows.estimate_rows(spark, path).agg(F.sum("estimated_rows").alias("estimated_rows"))
    rows = spark.read.option("header", "true").csv(path).agg(F.count(F.lit(1)).alias("rows"))
    both = guess.unionByName(rows, allowMissingColumns=True)
    return both.agg(F.max("estimated_rows").alias("estimated_rows"), F.max("rows").alias("rows"))


@query("a18_estimated_rows")
def _(spark, d):
    return estimate_and_count(spark, d)


@query("a18_estimate_invariants", "SELECT count(*) AS rows, true AS within_5_percent FROM events")
def _(spark, d):
    apart = F.abs(F.col("estimated_rows") - F.col("rows"))
    return estimate_and_count(spark, d).select("rows", (apart <= 0.05 * F.col("rows")).alias("within_5_percent"))


@query("a19_seeded_shuffle", """SELECT doc_id, lang, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 15) AS BIGINT) AS shuffle_key FROM documents""")
def _(spark, d):
    return tables.seeded_shuffle(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], portable=True)
