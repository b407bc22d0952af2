"""Role views, previews, stage tables, exports and the seeded shuffle."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.hashing import seeded_hash
from flowsieve.functions.values import is_missing
from flowsieve.schema import IDENTIFIERS


@dataclass(frozen=True)
class Roles:
    identifiers: DataFrame
    features: DataFrame
    labels: DataFrame | None


def split_roles(
    df: DataFrame,
    key: list[str],
    label: str = "Label",
    identifiers: tuple[str, ...] = IDENTIFIERS,
    also_features: tuple[str, ...] = ("Dst Port", "Protocol"),
) -> Roles:
    """Three views of a batch table that share its row key.

    Destination port and protocol are identifiers and features at once: the model is trained on both.
    """
    ids = [c for c in identifiers if c in df.columns and c not in key]
    hidden = {c for c in ids if c not in also_features} | {label, *key}
    feats = [c for c in df.columns if c not in hidden]

    def view(names: list[str]) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in [*key, *names]])

    return Roles(view(ids), view(feats), view([label]) if label in df.columns else None)


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows by an explicit order."""
    return df.orderBy(*order).limit(n)


def inspect(df: DataFrame) -> DataFrame:
    """One row per column: position, type, NULL or NaN count, and the table's row count; one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("column"),
                    F.lit(t).alias("dtype"),
                    F.count_if(is_missing(df, c)).alias("nulls"),
                )
                for i, (c, t) in enumerate(df.dtypes)
            ]
        ).alias("cols"),
    )
    return row.select("rows", F.inline("cols"))


def save_dataset(df: DataFrame, path: str, info: dict) -> None:
    """Stage table as Parquet with a one-row JSON file of column roles and statistics."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(info),)], "info string").write.mode("overwrite").text(f"{path}/info")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    info = json.loads(spark.read.text(f"{path}/info").first().value)
    return spark.read.parquet(f"{path}/rows"), info


def write_split(train: DataFrame, test: DataFrame, path: str, label: str) -> None:
    """Model-ready tables, the label as the last column."""
    for name, part in (("train", train), ("test", test)):
        cols = [c for c in part.columns if c != label]
        part.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{label}`")).write.mode("overwrite").parquet(
            f"{path}/{name}"
        )


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test")


def save_bucketed(df: DataFrame, path: str, key: list[str], buckets: int) -> DataFrame:
    """A stage table whose rows lie in buckets by the hash of their key, sorted by it; as it is read back.

    Two such tables of the same number of buckets are joined or grouped by the key without an exchange, as often as they
    are used. Take so many buckets that one fits a task: they do not change with the session's settings.
    """
    spark, spec = df.sparkSession, {"key": list(key), "buckets": buckets}
    writer = df.repartition(buckets, *key).write.mode("overwrite").format("parquet").option("path", f"{path}/rows")
    writer.bucketBy(buckets, *key).sortBy(*key).saveAsTable(_table_name(path))
    spark.createDataFrame([(json.dumps(spec),)], "spec string").write.mode("overwrite").text(f"{path}/spec")
    return spark.table(_table_name(path))


def load_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``save_bucketed``, in this session or another one."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        spec = json.loads(spark.read.text(f"{path}/spec").first().value)
        rows = spark.read.parquet(f"{path}/rows")
        key = ", ".join(f"`{k}`" for k in spec["key"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        where = f"{path}/rows".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {spec['buckets']} BUCKETS LOCATION '{where}'"
        )
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def seeded_shuffle(df: DataFrame, key: list[str], seed: int = 42, portable: bool = False) -> DataFrame:
    """The whole table in a pseudo-random order: a range-partitioned sort on the hashed row key."""
    mixed = df.withColumn("shuffle_key", seeded_hash(key, seed, portable))
    return mixed.orderBy("shuffle_key", *key)
