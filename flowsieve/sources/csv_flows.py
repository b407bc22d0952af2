"""Flow CSV folders: union by name, tolerant parsing, dataset-wide numeric coercion."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.schema import (
    LABEL_COLUMN_CANDIDATES,
    NEVER_COERCED,
    PROTOCOL_COLUMN_CANDIDATES,
    detect_column,
    require_header,
)
from flowsieve.sources import records

RAW_LINE = "_raw_line"


@dataclass(frozen=True)
class ParsedFlows:
    """Rows that fit the header (short ones padded with NULL) and lines with too many fields."""

    good: DataFrame
    rejected: DataFrame


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Path and length of each file; the content column is pruned, so no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.option("header", "true").csv(path).columns)


def field_count(line: Column, escape: str = "\\") -> Column:
    """Number of comma-separated fields of a line, commas inside quotes not counted."""
    quoted = r'"([^"]|"")*"' if escape == '"' else r'"([^"\\]|\\.|"")*"'
    return F.size(F.split(F.regexp_replace(line, f"(?s){quoted}", ""), ","))


def _reader(spark: SparkSession, names: tuple[str, ...], mode: str):
    fields = [T.StructField(n, T.StringType()) for n in names]
    return (
        spark.read.schema(T.StructType([*fields, T.StructField(RAW_LINE, T.StringType())]))
        .option("header", "true")
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", RAW_LINE)
        .option("columnPruning", "false")
    )


def first_lines(spark: SparkSession, folder: str, pattern: str = "*.csv", escape: str = "\\") -> DataFrame:
    """(path, line, broken): the first line of each file that is not empty, and whether a quoted field goes on over a line end.

    One job for all files.
    """
    lines = records.text_lines(spark, folder, pattern).withColumn("value", F.regexp_replace("value", "\r$", ""))
    first = F.min_by("value", F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("no")))
    found = lines.groupBy("path").agg(first.alias("line"), F.bool_or(records.opens(F.col("value"), escape)).alias("broken"))
    return found.filter("line IS NOT NULL")


def scan_csv_dir(spark: SparkSession, folder: str, escape: str = "\\") -> ParsedFlows:
    """Every ``*.csv`` below a folder, unioned by column name, all columns as text.

    Files are grouped by their header line, because one read of files with different column orders
    would map them by position. Only file names and header lines reach the driver, from one job for all files;
    a header is parsed once, however many files have it. Files without a line are left out. Files with a quoted field
    that goes on over a line end are put together from their lines first (``csv_records``), so they stay split like the
    others. ``escape`` stands before a quote inside quotes: a backslash, or a quote for files that double them.
    """
    by_line: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for r in first_lines(spark, folder, escape=escape).collect():
        by_line[r["line"], r["broken"]].append(r["path"])
    if not by_line:
        raise FileNotFoundError(f"no CSV files in {folder}")
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    headers: dict[str, tuple[str, ...]] = {}
    for (line, broken), paths in by_line.items():
        if line not in headers:
            headers[line] = read_header(spark, min(paths))
            require_header(list(headers[line]))
        groups[headers[line], broken] += sorted(paths)

    good, rejected = None, None
    for (header, broken), members in groups.items():
        if broken:
            texts = records.csv_records(spark, members, escape).select("record")
            rows = _parsed(texts, header, escape)
        else:
            texts = spark.read.text(members).select(F.col("value").alias("record"))
            rows = _reader(spark, header, "PERMISSIVE").option("escape", escape).csv(members)
        too_long = F.coalesce(field_count(F.col(RAW_LINE), escape) > len(header), F.lit(False))
        part = rows.filter(~too_long).select(*[F.col(f"`{c}`").alias(c.strip()) for c in header])
        bad = texts.filter(field_count(F.col("record"), escape) > len(header)).select(
            F.col("record").alias("line"), F.lit(len(header)).alias("expected_fields")
        )
        good = part if good is None else good.unionByName(part, allowMissingColumns=True)
        rejected = bad if rejected is None else rejected.unionByName(bad)
    return ParsedFlows(good, rejected)


def _parsed(texts: DataFrame, header: tuple[str, ...], escape: str) -> DataFrame:
    """Whole records as rows of the header's columns and the raw record of those that do not fit."""
    names = [*header, RAW_LINE]
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW_LINE, "escape": escape, "columnPruning": "false"}
    return texts.select(F.from_csv("record", schema, options).alias("r")).select(*[F.col("r")[n].alias(n) for n in names])


def coerce_numeric(
    df: DataFrame, exclude: tuple[str, ...] = NEVER_COERCED, min_ratio: float = 0.5
) -> DataFrame:
    """Cast a text column to DOUBLE where more than ``min_ratio`` of all its rows parse as numbers.

    The decision is made once for the whole table, from one aggregate over all columns; a cast column
    holds NULL, never NaN, where a value does not parse.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not texts:
        return df

    def number(name: str) -> Column:
        n = F.trim(F.col(f"`{name}`")).try_cast("double")
        return F.when(~F.isnan(n), n)

    shares = df.agg(
        *[F.try_divide(F.count(number(c)), F.count(F.lit(1))).alias(f"r{i}") for i, c in enumerate(texts)]
    ).first()
    numeric = {c for i, c in enumerate(texts) if (shares[f"r{i}"] or 0.0) > min_ratio}
    return df.select(
        *[number(c).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns]
    )


def drop_header_rows(df: DataFrame, label: str = "Label") -> DataFrame:
    """Remove header lines that were repeated inside the data."""
    return df.filter(~F.col(f"`{label}`").eqNullSafe(F.lit("Label")))


def load_flows(spark: SparkSession, folder: str) -> tuple[DataFrame, str, str | None]:
    """Scan, coerce and clean of header rows; also the detected label and protocol columns."""
    df = coerce_numeric(scan_csv_dir(spark, folder).good)
    label = detect_column(df.columns, LABEL_COLUMN_CANDIDATES, required=True)
    return drop_header_rows(df, label), label, detect_column(df.columns, PROTOCOL_COLUMN_CANDIDATES)


def estimate_rows(spark: SparkSession, folder: str, sample_lines: int = 200) -> DataFrame:
    """(path, estimated_rows) from file lengths and the mean length of the first file's first lines."""
    files = list_files(spark, folder)
    first = files.orderBy("path").first()
    lines = spark.read.text(first.path).limit(sample_lines + 1).select(F.octet_length("value") + 1).collect()
    header, rows = lines[0][0] if lines else 0, [r[0] for r in lines[1:]]
    if not rows:
        return files.select("path", F.lit(0).cast("long").alias("estimated_rows"))
    mean = sum(rows) / len(rows)
    return files.select("path", F.floor((F.col("length") - header) / F.lit(mean)).alias("estimated_rows"))


def file_shapes(rows: DataFrame, path_column: str = "path") -> DataFrame:
    """Row and column count of each input file."""
    width = len([c for c in rows.columns if c != path_column])
    return rows.groupBy(path_column).agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(width))
