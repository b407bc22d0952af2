"""Flow files as streams: labelled replay with malformed rows left out or kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.clean import nest_identifiers
from flowsieve.schema import IDENTIFIERS, is_numeric


MALFORMED = "malformed"


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    files_per_trigger: int = 1000,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Parquet files of a folder, oldest first; a micro-batch takes so many files, or so many bytes if given."""
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option(*limit).parquet(folder)


def replay_csv(
    spark: SparkSession,
    folder: str,
    header: list[str],
    label: str | None = "Label",
    identifiers: tuple[str, ...] = IDENTIFIERS,
    files_per_trigger: int = 1000,
    keep_malformed: bool = False,
) -> DataFrame:
    """Rows of labelled CSV files as a stream of text columns.

    Names and labels are trimmed, the label becomes ``actual_label`` and the identifiers are nested beside their flat
    columns. Lines whose field count differs from the header are left out; with ``keep_malformed`` they stay, whole in
    the column ``malformed``, which is NULL for the others.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, MALFORMED)])
    rows = (
        spark.readStream.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", "false")
        .option("enforceSchema", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )
    whole = F.col(MALFORMED).isNull()
    rows = rows.filter(F.lit(True) if keep_malformed else whole)
    rows = rows.select(*[F.col(f"`{c}`").alias(c.strip()) for c in header], *([MALFORMED] if keep_malformed else []))
    if label and label in rows.columns:
        rows = rows.withColumn("actual_label", F.trim(F.col(f"`{label}`"))).drop(label)
    return nest_identifiers(rows, identifiers)


def split_reason(df: DataFrame, types: dict[str, T.DataType]) -> Column:
    """Why a row of text columns cannot be used: the first required column that does not parse, else NULL."""
    reason = F.lit(None).cast("string")
    for name, t in reversed(list(types.items())):
        c = F.col(f"`{name}`")
        if is_numeric(t) or isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            reason = F.when(c.isNull(), f"{name}: missing").when(
                c.try_cast(t).isNull(), F.concat(F.lit(f"{name}: not readable: "), c)
            ).otherwise(reason)
    return reason


def typed_or_rejected(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Typed columns, ``status`` (good or rejected), ``reason`` and the raw row of rejected ones.

    One projection for batch and stream: a bad row never fails a batch, and no row is lost. A line with the wrong number
    of fields, kept by ``replay_csv`` in the column ``malformed``, is rejected whole: which of its fields is which is
    not known.
    """
    broken = F.col(MALFORMED).isNotNull() if MALFORMED in df.columns else F.lit(False)
    reason = F.when(broken, "wrong number of fields").otherwise(split_reason(df, types))
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != MALFORMED]))
    if MALFORMED in df.columns:
        raw = F.coalesce(MALFORMED, raw)
    typed = [F.when(~broken, F.col(f"`{c}`").try_cast(t)).alias(c) for c, t in types.items()]
    others = [F.when(~broken, F.col(f"`{c}`")).alias(c) for c in df.columns if c not in types and c != MALFORMED]
    return df.select(
        *typed,
        *others,
        F.when(reason.isNull(), "good").otherwise("rejected").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), raw).alias("raw"),
    )
