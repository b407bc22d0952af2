"""Exact stratified splits and samples without sorting a class."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.hashing import HASH_BITS, seeded_hash
from flowsieve.operators.profile import class_sizes
from flowsieve.session import materialise

MAX_BITS = 16
RANK_ROWS = 100_000


def stratified_quota(counts: dict, total: int) -> dict:
    """Rows to draw from each class so that they sum to ``total``: largest remainder, ties by class."""
    rows = sum(counts.values())
    if not rows:
        return {}
    exact = {c: divmod(n * total, rows) for c, n in counts.items()}
    quota = {c: q for c, (q, _) in exact.items()}
    short = total - sum(quota.values())
    for c in sorted(exact, key=lambda c: (-exact[c][1], str(c)))[:short]:
        quota[c] += 1
    return quota


def mark_stratified(
    df: DataFrame,
    label: str,
    key: list[str],
    take: float | int | dict,
    seed: int = 42,
    portable: bool = False,
    flag: str = "picked",
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Adds a boolean column: exactly ``take`` rows (a share, a number, or a number for each class).

    Rows are picked in the order of a seeded hash of their unique key. A large class is never ranked:
    its hashes are counted in up to 2^16 buckets, whole buckets below the cut are in, above it are out,
    and only the bucket that holds the cut is looked at again, until it is small enough
    (``rank_rows``) to be ranked. The table itself is never shuffled; what is known of each class is joined to it.
    """
    keys = [f"k{i}" for i in range(len(key))]
    order = F.struct(
        seeded_hash(key, seed, portable).alias("h"), *[F.col(f"`{k}`").alias(n) for k, n in zip(key, keys)]
    )
    rows = df.select(F.col(f"`{label}`").alias("c"), order.alias("o")).select("c", "o.*")
    counts = class_sizes(rows, "c")
    if isinstance(take, dict):
        quota = {c: min(n, counts.get(c, 0)) for c, n in take.items()}
    else:
        total = ceil(take * sum(counts.values())) if isinstance(take, float) else take
        quota = stratified_quota(counts, min(total, sum(counts.values())))

    def known(facts: DataFrame) -> DataFrame:
        """What is known of each class; for a large table written, so that Spark sees how small it is and moves no rows."""
        return materialise(facts, "sample-cuts") if sum(counts.values()) > rank_rows else facts

    # Per class: the bucket that holds the last picked row, rows still to pick in it, rows it holds.
    cuts = {c: (0, n, counts[c]) for c, n in quota.items() if n > 0}
    kind = rows.schema["c"].dataType
    width = HASH_BITS
    while cuts and max(held for _, _, held in cuts.values()) > rank_rows and width > 0:
        bits = min(MAX_BITS, width, (max(held for _, _, held in cuts.values()) // rank_rows).bit_length() + 1)
        inside = _inside(rows, known(_cut_table(df, cuts, kind)), width)
        width -= bits
        buckets = inside.groupBy("c", "left", F.shiftright("h", width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        cuts = _cut_buckets(buckets, cuts)
    rank = F.row_number().over(W.partitionBy("c").orderBy("h", *keys))
    inside = _inside(rows, known(_cut_table(df, cuts, kind)), width)
    last = inside.withColumn("rank", rank).filter(F.col("rank") == F.col("left")).select("c", "h", *keys).collect() if cuts else []

    # The last picked row of each class, as a table that Spark broadcasts by its own size rule.
    bound = T.StructType([T.StructField("c__", kind), T.StructField("h", T.LongType()), *[T.StructField(k, rows.schema[k].dataType) for k in keys]])
    bounds = df.sparkSession.createDataFrame([tuple(r) for r in last], bound).select("c__", F.struct("h", *keys).alias("bound__"))
    joined = df.join(known(bounds), F.col(f"`{label}`").eqNullSafe(F.col("c__")), "left")
    return joined.withColumn(flag, F.coalesce(order <= F.col("bound__"), F.lit(False))).drop("c__", "bound__")


def _cut_table(df: DataFrame, cuts: dict, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("k", kind), T.StructField("bucket", T.LongType()), T.StructField("left", T.LongType())])
    return df.sparkSession.createDataFrame([(c, b, n) for c, (b, n, _) in cuts.items()], schema)


def _inside(rows: DataFrame, cuts: DataFrame, width: int) -> DataFrame:
    """The rows in the buckets that hold a cut, with the number of rows still to pick there."""
    same = rows["c"].eqNullSafe(cuts["k"]) & (F.shiftright(rows["h"], width) == cuts["bucket"])
    return rows.join(cuts, same).drop("k", "bucket")


def _cut_buckets(buckets: DataFrame, cuts: dict) -> dict:
    """The bucket that holds the last picked row of each class; the window runs over bucket counts."""
    upto = F.sum("n").over(W.partitionBy("c").orderBy("b"))
    need = F.col("left")
    reached = buckets.withColumn("upto", upto).filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
    return {r["c"]: (r["b"], cuts[r["c"]][1] - (r["upto"] - r["n"]), r["n"]) for r in reached.collect()}


def stratified_split(
    df: DataFrame, label: str, key: list[str], test_size: float = 0.2, seed: int = 42, portable: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(test_size x rows) test rows, each class within one row of its share."""
    marked = mark_stratified(df, label, key, float(test_size), seed, portable)
    return marked.filter(~F.col("picked")).drop("picked"), marked.filter("picked").drop("picked")


def stratified_sample(
    df: DataFrame, label: str, key: list[str], take: float | int, seed: int = 42, portable: bool = False
) -> DataFrame:
    return mark_stratified(df, label, key, take, seed, portable).filter("picked").drop("picked")
