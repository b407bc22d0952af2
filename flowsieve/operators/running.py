"""Running sums and exact quantiles of large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.values import any_of, ordered_bits
from flowsieve.session import materialise

BLOCK_ROWS = 1_000_000
#: Bits by which a bucket is refined in a pass, and the values of a bucket that are ranked at last.
BUCKET_BITS = 10
RANK_ROWS = 100_000
#: Of the sketches: one over the relative error of a rank, and how far around a quantile they are asked.
ACCURACY, MARGIN = 2000, 0.001


def running_sums(
    df: DataFrame, part: list[str], order: str, sums: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``run_<c>``: the sum of c over the rows of the same part up to and including this one.

    ``order`` is distinct within a part. A window over a part would sort all its rows in one task; here Spark's range
    partitioning deals (part, order) to blocks of about ``block_rows`` rows, however large a part is. Sums run inside
    a block, and the totals of a part's earlier blocks are added; that table has a row for each part and block. The
    dealt rows are read twice, so they are written to the shared folder.
    """
    rows = df.count()
    dealt = df.repartitionByRange(rows // block_rows + 1, *part, order).withColumn("b__", F.spark_partition_id())
    dealt = materialise(dealt, "running")
    inside = W.partitionBy(*part, "b__").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*part).orderBy("b__").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*part, "b__")
        .agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
        .select(*part, "b__", *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums])
    )
    renamed = offsets.select(*[F.col(c).alias(f"{c}__") for c in (*part, "b__")], *[f"before_{c}" for c in sums])
    local = dealt.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums})
    same = [local[c].eqNullSafe(renamed[f"{c}__"]) for c in (*part, "b__")]
    joined = local.join(renamed, same)
    return joined.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"before_{c}") for c in sums}).drop(
        "b__", *[f"{c}__" for c in (*part, "b__")], *[f"before_{c}" for c in sums]
    )


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], rank_rows: int = RANK_ROWS
) -> DataFrame:
    """(name, p, value): linearly interpolated quantiles of the finite values of each column.

    Spark's own sketches give a narrow range of values around each quantile, in the pass that counts the values. A second
    pass counts what lies below and inside each range, which proves it right or, if a sketch was wrong, leaves it open.
    Only values inside the ranges are looked at again and ranked, equal values counted first; a range of one value is
    not. If a range still holds more than ``rank_rows`` values, those inside are written to the shared folder and cut in
    buckets by leading bits of integers of the same order, until the bucket of each asked rank is small or one value. What goes to the driver is a few counts for each column and probability.
    A column without values is absent.
    """
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    finite = {c: F.when(F.abs(v) < F.lit(float("inf")), v) for c, v in value.items()}
    spread = sorted({min(1.0, max(0.0, p + d * MARGIN)) for p in probabilities for d in (-1, 1)})
    seen = df.agg(*[x for v in finite.values() for x in (F.count(v), F.percentile_approx(v, spread, ACCURACY))]).head() if columns else []
    asked, ranges = {}, {}
    for c, n, marks in zip(columns, seen[::2], seen[1::2]):
        sketch = dict(zip(spread, marks or []))
        for p in probabilities if n else []:
            low, part = divmod(p * (n - 1), 1)
            asked[c, p] = (int(low), min(int(low) + 1, n - 1), part)
            ranges.setdefault(c, set()).add((sketch[max(0.0, p - MARGIN)], sketch[min(1.0, p + MARGIN)]))
    slots = [(c, lo, hi) for c, found in ranges.items() for lo, hi in _merged(sorted(found))]
    counts = [x for c, lo, hi in slots for x in (F.count_if(finite[c] < lo), F.count_if(finite[c].between(lo, hi)))]
    counted = df.agg(*counts).head() if slots else []
    inside, place = {}, {}
    for i, (c, lo, hi) in enumerate(slots):
        below, held = counted[2 * i], counted[2 * i + 1]
        inside[i] = (F.when(finite[c].between(lo, hi), finite[c]), held)
        for (d, p), (first, second, _) in asked.items():
            if d == c and below <= first and second < below + held:
                place[c, p] = (i, below)
    for at, c in enumerate(columns):
        missed = [p for d, p in asked if d == c and (c, p) not in place]
        if missed:
            inside[len(slots) + at] = (finite[c], seen[2 * at])
            place |= {(c, p): (len(slots) + at, 0) for p in missed}
    wanted = {i: {r - place[k][1] for k, (a, b, _) in asked.items() if place[k][0] == i for r in (a, b)} for i in inside}
    # a range of one value needs no ranking, however many rows hold it
    single = {i: lo for i, (_, lo, hi) in enumerate(slots) if lo == hi and i in wanted}
    found = {(i, r): v for i, v in single.items() for r in wanted[i]}
    found |= _ranked_values(df, inside, {i: r for i, r in wanted.items() if r and i not in single}, rank_rows)
    rows = []
    for (c, p), (a, b, part) in asked.items():
        i, below = place[c, p]
        low, high = found[i, a - below], found[i, b - below]
        rows.append((c, float(p), low + part * (high - low)))
    schema = T.StructType().add("name", T.StringType()).add("p", T.DoubleType()).add("value", T.DoubleType())
    return df.sparkSession.createDataFrame(rows, schema)


def _merged(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Ranges in ascending order, those that overlap as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _ranked_values(
    df: DataFrame, inside: dict[int, tuple[Column, int]], wanted: dict[int, set[int]], rank_rows: int
) -> dict[tuple[int, int], float]:
    """The value at each wanted rank of each column expression, of which the number of values is known."""
    # For each rank of a slot: leading bits of its bucket, rank inside, values inside.
    at = {(i, r): (0, r, inside[i][1]) for i, ranks in wanted.items() for r in ranks}
    found: dict[tuple[int, int], float] = {}
    known: int | None = None  # bits that the buckets leave open
    out = []
    for i in wanted:
        v = inside[i][0]
        out.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("slot"), ordered_bits(v).alias("code"), v.alias("value"))))
    rows = df.select(F.explode(F.array_compact(F.array(*out))).alias("e")).select("e.*") if out else None

    def left() -> bool:
        return max((held for _, _, held in at.values()), default=0) > rank_rows

    if left():
        # read once for every BUCKET_BITS; the table itself is not read again
        rows = materialise(rows, "quantile-ranges")

    def entries() -> DataFrame:
        """The values in the buckets of the wanted ranks."""
        buckets = {i: {b for (d, _), (b, _, _) in at.items() if d == i} for i, _ in at}
        held = [(F.col("slot") == i) & (F.lit(True) if known is None else F.shiftright("code", known).isin(*b)) for i, b in buckets.items()]
        return rows.filter(any_of(held))

    for width in (52, *range(52 - BUCKET_BITS, 0, -BUCKET_BITS), 0):
        if not left():
            break
        ends = (F.min("code").alias("first"), F.max("code").alias("last"), F.min("value").alias("value"))
        counted = entries().groupBy("slot", F.shiftright("code", width).alias("b")).agg(F.count(F.lit(1)).alias("n"), *ends).collect()
        for (i, r), (bucket, rank, _) in list(at.items()):
            for x in sorted((x for x in counted if x["slot"] == i), key=lambda x: x["b"]):
                if known is not None and x["b"] >> (known - width) != bucket:
                    continue
                if rank < x["n"]:
                    at[i, r] = (x["b"], rank, x["n"])
                    if x["first"] == x["last"]:  # copies of one value, however many
                        found[i, r] = x["value"]
                        del at[i, r]
                    break
                rank -= x["n"]
        known = width
    if at:
        order = W.partitionBy("slot", "b").orderBy("code")
        ranked = (
            entries()
            .groupBy("slot", (F.lit(0).cast("long") if known is None else F.shiftright("code", known)).alias("b"), "code")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
            .withColumn("upto", F.sum("n").over(order))
        )
        hits = any_of(
            [
                (F.col("slot") == i) & (F.col("b") == b) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
                for (i, _), (b, rank, _) in at.items()
            ]
        )
        for r in ranked.filter(hits).collect():
            for (i, rank_of), (b, rank, _) in at.items():
                if i == r["slot"] and b == r["b"] and r["upto"] - r["n"] <= rank < r["upto"]:
                    found[i, rank_of] = r["value"]
    return found
