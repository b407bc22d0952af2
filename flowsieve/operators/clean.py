"""Row repair: drops, de-duplication, renames, unit changes and alignment to a trained feature list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.values import any_inf, any_missing, finite_or_zero
from flowsieve.schema import (
    DROP_CLASS,
    LIVE_FIELD_COLUMN,
    RAW_LABEL_CLASS,
    SECONDS_FIELDS,
    TRAINING_DROP,
    FIVE_CLASSES,
    FlowSchema,
    Variant,
)


def drop_identifiers(df: DataFrame, names: tuple[str, ...] = TRAINING_DROP) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Rows with a NULL or NaN in any column go; infinities stay."""
    return df.filter(~any_missing(df))


def drop_infinite_rows(df: DataFrame) -> DataFrame:
    return df.filter(~any_inf(df))


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; copies collapse before the shuffle (partial aggregation)."""
    return df.dropDuplicates()


def standardise_port_protocol(
    df: DataFrame, port: str = "Dst Port", protocol: str = "Protocol"
) -> DataFrame:
    """Port as a number, rows without a readable one dropped; protocol as text."""
    out = df
    if port in df.columns:
        out = out.withColumn(port, F.col(f"`{port}`").try_cast("double")).filter(F.col(f"`{port}`").isNotNull())
    if protocol in df.columns:
        out = out.withColumn(protocol, F.col(f"`{protocol}`").cast("string"))
    return out


def consolidate(df: DataFrame, label: str = "Label", mapping: dict[str, str] = RAW_LABEL_CLASS) -> DataFrame:
    """Raw label to class; labels outside the mapping keep their name.

    The mapping is a literal of a few dozen entries, so this is a projection and not a join.
    """
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    c = F.col(f"`{label}`")
    return df.withColumn(label, F.coalesce(F.try_element_at(F.create_map(*entries), c), c))


def drop_classes(df: DataFrame, label: str = "Label", variant: Variant = FIVE_CLASSES) -> DataFrame:
    """After consolidation: rows of the drop class and of the classes the variant leaves out."""
    return df.filter(~F.coalesce(F.col(f"`{label}`").isin(DROP_CLASS, *variant.dropped), F.lit(False)))


def zero_fill(df: DataFrame, names: list[str]) -> DataFrame:
    """Text, NULL, NaN and infinities of the named columns become 0."""
    return df.withColumns({c: finite_or_zero(F.col(f"`{c}`")) for c in names})


def rename_live_fields(df: DataFrame, mapping: dict[str, str] = LIVE_FIELD_COLUMN) -> DataFrame:
    """Live field names to training names; fields outside the mapping are dropped."""
    return df.select(*[F.col(k).alias(v) for k, v in mapping.items() if k in df.columns])


def seconds_to_micros(df: DataFrame, names: tuple[str, ...] = SECONDS_FIELDS) -> DataFrame:
    """Seconds to microseconds; a text value that is no number is left as it is."""
    changes = {}
    for c, t in df.dtypes:
        if c in names:
            scaled = F.col(c).try_cast("double") * F.lit(1e6)
            changes[c] = F.coalesce(scaled.cast("string"), F.col(c)) if t == "string" else scaled
    return df.withColumns(changes) if changes else df


def add_flow_id(
    df: DataFrame, parts: tuple[str, ...] = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
) -> DataFrame:
    """'src-dst-sport-dport-proto' with '?' for what is missing."""
    text = [
        F.coalesce(F.col(c).cast("string"), F.lit("?")) if c in df.columns else F.lit("?") for c in parts
    ]
    return df.withColumn("Flow ID", F.concat_ws("-", *text))


def nest_identifiers(df: DataFrame, names: tuple[str, ...] = FlowSchema().identifiers) -> DataFrame:
    present = [c for c in names if c in df.columns]
    return df.withColumn("identifiers", F.struct(*[F.col(f"`{c}`") for c in present]))


def align_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """The trained features in their order; absent ones are 0.0, further columns are dropped."""
    cols = [
        F.col(f"`{f}`").cast("double").alias(f) if f in df.columns else F.lit(0.0).alias(f) for f in features
    ]
    return df.select(*[F.col(f"`{k}`") for k in keep], *cols)


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    return [f for f in features if f not in df.columns]


def select_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *features]])


def clean_training(
    df: DataFrame, schema: FlowSchema = FlowSchema(), variant: Variant = FIVE_CLASSES
) -> DataFrame:
    """All cleaning steps in training order; the identifiers go first, since they decide what is equal."""
    label = schema.label
    rows = drop_identifiers(df, schema.drop)
    rows = rows.filter(~F.col(f"`{label}`").eqNullSafe(F.lit("Label")))
    rows = deduplicate(drop_infinite_rows(drop_missing_rows(rows)))
    return drop_classes(consolidate(standardise_port_protocol(rows), label), label, variant)
